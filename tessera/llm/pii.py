"""Personal data by bootstrapped contextual extraction: seeds induce lexical patterns, a pattern-instance graph is scored in rounds, and strong patterns find further identifiers."""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.skew import hot_join, weighed
from tessera.runtime import discard, materialize, python_workers, slices

KINDS = ("email", "ip", "card", "phone", "found")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"[^\s,;:()<>\"']+")
_SIGN = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\W\d_]+")
_LABEL = re.compile(r"([^\W\d_]+)\s*([:=#])[\s\"'(<]*$")
#: Characters of a token that can be an identifier.
SHORTEST, LONGEST = 6, 64


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, sorted; time is linear in the text."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:  # the leftmost match at an @ begins where the run of local characters does
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, 0, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            done = max(done, 0)
            at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() and c.isascii() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def tokens(text: str):
    """(start, end) of identifier-like tokens: runs without white space or brackets that hold a digit or @, of SHORTEST to LONGEST characters without closing stops. One pass, whatever the runs' lengths."""
    for m in _RUN.finditer(text):
        s, e = m.span()
        while e > s and text[e - 1] in ".!?":
            e -= 1
        if SHORTEST <= e - s <= LONGEST and _SIGN.search(text, s, e):
            yield s, e


def shape(value: str) -> str:
    """Digits as 0, runs of letters as a."""
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]", "0", value.lower()))[:LONGEST]


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span: two words before it, a word on each side, a label with its sign, and the word before with the span's shape."""
    before = text[max(0, start - 60) : start].lower()
    left, right = _WORD.findall(before)[-2:], _WORD.findall(text[end : end + 40].lower())[:1]
    out = []
    if len(left) == 2:
        out.append("L " + " ".join(left))
    if left and right:
        out.append(f"B {left[-1]} _ {right[0]}")
    if label := _LABEL.search(before):
        out.append(f"K {label[1]}{label[2]}")
    if left:
        out.append(f"S {left[-1]} {shape(text[start:end])}")
    return out


def _key(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value) - (1 << 63)


def _scan(batches):
    for batch in slices(batches):
        spans, found, keys = [], [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            keys.append(_key(text))
            base = base_spans(text)
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            rows, i = [], 0
            for s, _, e in base:
                rows.append({"start": s, "end": e, "seed": True, "value": _key(text[s:e]), "patterns": [_key(p) for p in contexts(text, s, e)]})
            for s, e in tokens(text):
                while i < len(base) and base[i][2] <= s:
                    i += 1
                if not any(b[0] < e and s < b[2] for b in base[i : i + 8]):
                    rows.append({"start": s, "end": e, "seed": False, "value": _key(text[s:e]), "patterns": [_key(p) for p in contexts(text, s, e)]})
            found.append(rows)
        span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        hit = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("seed", pa.bool_()), ("value", pa.int64()), ("patterns", pa.list_(pa.int64()))]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array(spans, span), pa.array(found, hit)], ["doc_id", "k", "base", "hits"])


def bootstrap(hits: DataFrame, rounds: int = 4, support: int = 5, confidence: float = 0.8) -> DataFrame:
    """(value) of unseen identifiers, from hits (value, seed, patterns).

    Edges join a pattern with the distinct values that it surrounds.  A pattern is
    trusted once `support` distinct values of it are known and they are `confidence`
    of all its values; known are the seeds and, from the second round on, the values
    that some other trusted pattern surrounds, so no pattern feeds on what it found
    itself, and found values help further patterns.  Rounds end when no pattern is
    new; a value that a trusted pattern surrounds is found.

    Each round is a partial aggregation by pattern and one by value, each joined back
    to the edges with hot patterns and hot values dealt out, and written to the
    shared folder.  Patterns with fewer than `support` values can never be trusted
    and are left out at once.  No hits give no values.
    """
    edges = hits.select("value", "seed", F.explode("patterns").alias("pattern")).groupBy("value", "pattern").agg(F.max("seed").alias("seed"))
    edges = materialize(edges, "edges")
    many = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.count_if(~F.col("seed")).alias("open"), F.count("*").alias("c")).where((F.col("n") >= support) & (F.col("open") > 0)).drop("open")
    many, sizes = weighed(many, "c", "patterns")
    graph = materialize(hot_join(edges, many, ["pattern"], "c", known=sizes).withColumn("good", F.lit(0)).withColumn("on", F.lit(False)), "graph")
    discard(edges, many)
    trusted = 0
    for _ in range(rounds):
        known = F.col("seed") | (F.col("good") > F.col("on").cast("int"))
        patterns = graph.groupBy("pattern").agg(F.count_if(known).alias("known"), F.max("n").alias("n"), F.max("on").alias("was"), F.count("*").alias("c"))
        patterns = patterns.select("pattern", (F.col("was") | ((F.col("known") >= support) & (F.col("known") >= confidence * F.col("n")))).alias("now"), "c")
        patterns, sizes = weighed(patterns, "c", "patterns")
        count = patterns.where("now").count()
        if count == trusted:
            discard(patterns)
            break
        trusted = count
        marked = materialize(hot_join(graph.drop("on", "good"), patterns, ["pattern"], "c", known=sizes).withColumnRenamed("now", "on"), "marked")
        values, sizes = weighed(marked.groupBy("value").agg(F.count_if("on").cast("int").alias("good"), F.count("*").alias("c")), "c", "values")
        after = materialize(hot_join(marked, values, ["value"], "c", known=sizes).select("value", "pattern", "seed", "n", "good", "on"), "graph")
        discard(graph, patterns, marked, values)
        graph = after
    return graph.where(~F.col("seed") & (F.col("good") > 0)).select("value").distinct()


def extract_pii(docs: DataFrame, rounds: int = 4, support: int = 5, confidence: float = 0.8) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found for each row of docs (doc_id, text).

    Base spans are leftmost non-overlapping matches of each kind, failing ones
    dropped.  They seed the bootstrap over the contexts of all identifier-like tokens
    (a digit or @, 6 to 64 characters) of the corpus; tokens that trusted patterns
    surround are added as kind `found` where they overlap no base span.

    One pass over whole texts, linear in their length; the graph holds only contexts
    of such tokens and is aggregated by pattern and value, never collected.  Null
    texts are empty, repeated rows get equal results, an empty table an empty result.
    """
    spark = docs.sparkSession
    python_workers(spark)
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(source.dtypes)["doc_id"]
    hit = "array<struct<start:bigint,end:bigint,seed:boolean,value:bigint,patterns:array<bigint>>>"
    rows = materialize(source.mapInArrow(_scan, f"doc_id {kind}, k long, base array<struct<start:bigint,kind:int,end:bigint>>, hits {hit}"), "pii")
    each = rows.where(F.size("hits") > 0).dropDuplicates(["doc_id", "k"]).select("doc_id", "k", F.explode("hits").alias("h")).select("doc_id", "k", "h.*")
    each = materialize(each, "hits")
    found = materialize(bootstrap(each, rounds, support, confidence), "found")
    open_ = each.where(~F.col("seed"))
    times, sizes = weighed(open_.groupBy("value").agg(F.count("*").alias("c")).join(found.hint("merge"), "value"), "c", "times")
    extra = hot_join(open_, times, ["value"], "c", known=sizes).groupBy(F.col("doc_id").alias("d"), F.col("k").alias("q"))
    extra = materialize(extra.agg(F.collect_list(F.struct("start", F.lit(KINDS.index("found")).alias("kind"), "end")).alias("extra")), "extra")
    discard(each, found, times)
    out = rows.select("doc_id", "k", "base").join(extra, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k") == F.col("q")), "left")
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    both = F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "extra")))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return out.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(both).alias("spans"),
        F.coalesce(F.size("extra"), F.lit(0)).cast("long").alias("n_found"),
    )
