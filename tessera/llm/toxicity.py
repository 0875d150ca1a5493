"""Toxicity by a weighted finite-state grammar: transducers for insults, threats, targets, negation and reported speech, composed over clauses."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.neardup import shingle_sets
from tessera.llm.sampling import FILES, held_out, training_sample
from tessera.llm.wordhash import mix
from tessera.runtime import materialize, python_workers, slices

#: Closed-class words of the grammar (fixed values): English, German, French, Spanish.
TARGETS = {"you", "your", "yours", "u", "they", "them", "he", "she", "him", "her", "du", "dich", "dir", "dein", "ihr", "euch", "sie", "tu", "te", "toi", "ton", "vous", "votre", "ils", "tú", "ti", "usted", "ustedes", "vosotros", "ellos"}
NEGATIONS = {"not", "no", "never", "nor", "isn't", "aren't", "nicht", "kein", "keine", "nie", "pas", "ne", "jamais", "ni", "nunca", "tampoco"}
REPORTS = {"said", "says", "wrote", "writes", "called", "calls", "quoted", "reported", "sagte", "sagt", "schrieb", "nannte", "dit", "écrit", "appelé", "dijo", "dice", "escribió", "llamó"}
THREATS = {"kill", "murder", "hurt", "destroy", "strangle", "töten", "umbringen", "schlagen", "tuer", "frapper", "matar", "golpear"}
WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
SENTENCES = re.compile(r"[.!?;\n]+")
#: Signs and conjunction-like dashes that part the clauses of a sentence.
CLAUSES = re.compile(r"[:,\"\u201c\u201d\u201e\u00ab\u00bb()]+|\s[-\u2013\u2014]\s")
KINDS = ("plain", "targeted", "negated", "reported")
SHORTEST, LONGEST = 4, 8


class Transducer:
    """A deterministic machine over word symbols; a missing arc stays in its state. Final states give an output."""

    def __init__(self, arcs: dict[tuple[int, str], int], outputs: dict[int, str]):
        self.arcs, self.outputs = arcs, outputs

    def step(self, state: int, symbol: str) -> int:
        return self.arcs.get((state, symbol), state)


#: T target, N negation, R report, I insult, H threat, O other.
TARGET = Transducer({(0, "T"): 1}, {1: "targeted"})
#: A negation reaches the head within its clause if it comes before it.
NEGATION = Transducer({(0, "N"): 1, (0, "I"): 2, (0, "H"): 2, (1, "I"): 3, (1, "H"): 3}, {3: "negated"})
REPORT = Transducer({(0, "R"): 1}, {1: "reported"})
HEAD = Transducer({(0, "I"): 1, (0, "H"): 2, (1, "H"): 2, (2, "I"): 2}, {1: "insult", 2: "threat"})
#: Over the clauses of a sentence: h holds a head, r a report verb and two words more at most, s a report verb and more, b head and report, n is a negation alone, o anything else.
#: Speech goes on to the end of the sentence ("He said: you are ..."),
SPEECH = Transducer({(0, "r"): 1, (0, "s"): 1, (0, "b"): 1}, {1: "reported"})
#: and, read from the end, a report or a negation reaches back to the clause before it ("..., he said", "..., not").
BACK = Transducer({(0, "r"): 1, (0, "n"): 2, (1, "o"): 0, (1, "s"): 0, (1, "n"): 2, (2, "o"): 0, (2, "s"): 0, (2, "h"): 0, (2, "b"): 0, (2, "r"): 1}, {1: "reported", 2: "negated"})


class Composition:
    """The product of transducers, run on one reading of a clause."""

    def __init__(self, *parts: Transducer):
        self.parts = parts
        self.arcs: dict[tuple[tuple[int, ...], str], tuple[int, ...]] = {}

    def read(self, symbols: list[str]) -> set[str]:
        state = (0,) * len(self.parts)
        for s in symbols:
            key = (state, s)
            if key not in self.arcs:
                self.arcs[key] = tuple(p.step(x, s) for p, x in zip(self.parts, state, strict=True))
            state = self.arcs[key]
        return {p.outputs[x] for p, x in zip(self.parts, state, strict=True) if x in p.outputs}


def sentence_marks(clauses: str) -> list[set[str]]:
    """What SPEECH and BACK say of each clause from the clauses around it."""
    out: list[set[str]] = [set() for _ in clauses]
    for machine, order in ((SPEECH, range(len(clauses))), (BACK, range(len(clauses) - 1, -1, -1))):
        state = 0
        for i in order:
            if state in machine.outputs:
                out[i].add(machine.outputs[state])
            state = machine.step(state, clauses[i])
    return out


def _grams(text: str) -> set[str]:
    """Words (closed by $) and their prefixes."""
    out: set[str] = set()
    for w in {m.group() for m in WORDS.finditer(text.lower())}:
        out.add(w + "$")
        out.update(w[:k] for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return out


def _count_grams(batches):
    for batch in slices(batches):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts[y].update(_grams(text))
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][g] for g in names], pa.int64()), pa.array([counts[0][g] for g in names], pa.int64())], ["gram", "p", "n"])


def _families(batches):
    """A min-hash of each text's three-word shingles: copies and most near copies share it."""
    for batch in slices(batches):
        near = [int(mix(x).min().view(np.int64)) if len(x) else 0 for x in shingle_sets(batch.column("text"), 3)]
        yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("text"), pa.array(near, pa.int64())], ["y", "text", "near"])


def learn_lexicon(sample: DataFrame, most: int = 3000) -> list[tuple[str, float]]:
    """Stems and words that mark positive rows: (gram, log odds).

    A gram counts if its likelihood ratio beats what the number of grams tried
    lets chance give, and at least 15 : 1 odds; a family of near copies counts once.  Of a chain of prefixes with the same
    support only the longest stays, and a gram whose prefix is as pure is left out.
    """
    sample = materialize(sample.mapInArrow(_families, "y int, text string, near long").dropDuplicates(["y", "near"]).drop("near"), "families", FILES)
    by_label = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    p_all, n_all = by_label.get(1, 0), by_label.get(0, 0)
    if not p_all or not n_all:
        return []
    counts = sample.mapInArrow(_count_grams, "gram string, p long, n long").groupBy("gram").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    share = p_all / (p_all + n_all)
    seen = F.col("p") + F.col("n")
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    g2 = 2 * (term(F.col("p"), seen * share) + term(F.col("n"), seen * (1 - share)))
    odds = F.log((F.col("p") + 0.5) / (p_all + 1)) - F.log((F.col("n") + 0.5) / (n_all + 1))
    counts = materialize(counts.where(seen >= 4), "grams", FILES)
    least = 2 * math.log(max(2, counts.count())) + 2
    found = counts.where(F.col("p") >= 3).withColumn("g2", g2).withColumn("odds", odds).where((F.col("g2") >= least) & (F.col("odds") >= math.log(15)))
    rows = found.orderBy(F.desc("g2"), "gram").limit(most).collect()
    support = {r["gram"]: (r["p"], r["odds"]) for r in rows}
    kept = []
    for gram, (p, odds_) in sorted(support.items()):
        word = gram.rstrip("$")
        shorter = [word[:k] for k in range(SHORTEST, len(word) + (gram != word)) if word[:k] in support]
        if any(support[s][0] > 1.02 * p and support[s][1] >= odds_ - 0.7 for s in shorter):
            continue  # a shorter stem covers more and is as pure
        same = [g for g in support if g != gram and g.rstrip("$").startswith(word) and len(g) > len(gram) and support[g][0] >= 0.98 * p]
        if gram == word and same:
            continue  # a longer one says the same
        kept.append((gram, float(odds_)))
    return kept


class Grammar:
    """The lexicon as an Aho-Corasick transducer, composed with the clause machines."""

    def __init__(self, lexicon: list[tuple[str, float]]):
        import ahocorasick

        self.machine = Composition(TARGET, NEGATION, REPORT, HEAD)
        entries: dict[str, tuple[str, bool, float]] = {w: ("H", True, 1.0) for w in THREATS}
        for gram, odds in lexicon:
            word = gram.rstrip("$")
            closed = gram != word
            if word not in entries or not closed:
                entries[word] = ("I", closed, odds)
        self.found = ahocorasick.Automaton()
        for word, (symbol, closed, weight) in entries.items():
            self.found.add_word(word, (len(word), symbol, closed, weight))
        self.found.make_automaton()

    def heads(self, low: str) -> dict[int, tuple[str, float]]:
        """Symbol and weight by the start of each word that the lexicon knows."""
        out: dict[int, tuple[str, float]] = {}
        for last, (n, symbol, closed, weight) in self.found.iter(low):
            at = last - n + 1
            if at and low[at - 1].isalpha():
                continue
            if closed and last + 1 < len(low) and low[last + 1].isalpha():
                continue
            if at not in out or out[at][1] < weight:
                out[at] = (symbol, weight)
        return out

    def sentence(self, low: str, begin: int, end: int, heads: dict[int, tuple[str, float]], starts: list[int]):
        """(outputs, weights of insults) for each clause of the sentence that holds a head: its own reading and what the clauses around it say."""
        told, kinds, found, i = [], [], [], 0
        for stop in [*(m.start() for m in CLAUSES.finditer(low, begin, end)), end]:
            symbols = []
            for m in WORDS.finditer(low, begin, stop):
                w = m.group()
                symbols.append(heads[m.start()][0] if m.start() in heads else "T" if w in TARGETS else "N" if w in NEGATIONS else "R" if w in REPORTS else "O")
            here = []
            while i < len(starts) and starts[i] < stop:
                here.append(starts[i])
                i += 1
            begin = stop
            if not symbols:
                continue
            report = "R" in symbols
            kinds.append("b" if here and report else "h" if here else ("r" if len(symbols) <= 3 else "s") if report else "n" if symbols[0] == "N" and len(symbols) <= 3 else "o")
            told.append(self.machine.read(symbols))
            found.append([heads[x][1] for x in here if heads[x][0] == "I"] if here else None)
        return [(a | b, w) for a, b, w in zip(told, sentence_marks("".join(kinds)), found, strict=True) if w is not None]

    def features(self, text: str) -> list[float]:
        """By kind of matched clause the log of its summed weights, threats, clauses, and the share of words that are heads."""
        low = text.lower()
        heads = self.heads(low)
        if not heads:
            return [0.0] * (len(KINDS) + 3)
        sums = dict.fromkeys(KINDS, 0.0)
        threats = clauses = 0
        starts = sorted(heads)
        i, begin = 0, 0
        for end in [*(m.start() for m in SENTENCES.finditer(low)), len(low)]:
            if i < len(starts) and starts[i] < end:
                upto = i
                while upto < len(starts) and starts[upto] < end:
                    upto += 1
                for told, insults in self.sentence(low, begin, end, heads, starts[i:upto]):
                    kind = "reported" if "reported" in told else "negated" if "negated" in told else "targeted" if "targeted" in told else "plain"
                    sums[kind] += sum(insults)
                    threats += "threat" in told and "targeted" in told and kind != "reported"
                    clauses += bool(insults)
                i = upto
            begin = end
            if i == len(starts):
                break
        n = sum(sums.values())
        return [math.log1p(sums[k]) for k in KINDS] + [math.log1p(threats), float(clauses > 0), math.log1p(n) - 0.5 * math.log1p(len(low) / 100)]


def _features(grammar_of):
    def run(batches):
        grammar = Grammar(grammar_of.value)
        for batch in slices(batches):
            rows = [grammar.features(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(rows, pa.list_(pa.float64()))], ["y", "x"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last coefficient is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty * weight.sum() / 100)
    ridge[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _score(model):
    def run(batches):
        lexicon, w = model.value
        grammar = Grammar(lexicon)
        for batch in slices(batches):
            x = np.array([grammar.features(t or "") for t in batch.column("text").to_pylist()]).reshape(len(batch), len(KINDS) + 3)
            z = np.clip(x @ w[:-1] + w[-1], -30, 30) if len(batch) else np.zeros(0)
            clauses = (x[:, -2] > 0) if len(batch) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(1 / (1 + np.exp(-z)), 6)), pa.array(clauses)], ["doc_id", "score", "matched"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, positives: int = 1500, negatives: int = 3000, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, matched for each row of docs (doc_id, text), learnt from labels (doc_id, toxic).

    The insult lexicon (words and stems) and the weights of the clause kinds are
    learnt from at most `positives` + `negatives` labelled rows whose crc32 mod 3
    isn't 1, weighed to the share of positives among all such rows.  A clause is
    insulting, threatening, targeted, negated or reported by its own words and by
    the clauses around it in the sentence.  Scoring is one
    narrow pass: an Aho-Corasick transducer finds lexicon words, and only clauses
    that hold one are read by the composed machines.  Whole texts are scored; null
    or empty texts get the score of a text without matches.  Without labels the
    score is that of the prior, 0.5.
    """
    spark = docs.sparkSession
    python_workers(spark)
    sample, share = training_sample(docs, labels, "toxic", 3, 1, positives, negatives)
    lexicon = learn_lexicon(sample)
    rows = sample.mapInArrow(_features(spark.sparkContext.broadcast(lexicon)), "y int, x array<double>").collect()  # positives + negatives rows at most
    x, y = np.array([r["x"] for r in rows]).reshape(len(rows), len(KINDS) + 3), np.array([r["y"] for r in rows])
    if len(set(y.tolist())) == 2:
        weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
        w = fit_logistic(x, y, weight)
    else:
        w = np.zeros(len(KINDS) + 4)
    model = spark.sparkContext.broadcast((lexicon, w))
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(source.dtypes)["doc_id"]
    scored = source.mapInArrow(_score(model), f"doc_id {kind}, score double, matched boolean")
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "matched")
