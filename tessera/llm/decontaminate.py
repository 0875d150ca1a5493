"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.wordhash import alnum_words, text_buffer, words
from tessera.runtime import discard, materialize, python_workers, slices

_U = np.uint64
#: Words of test items in one automaton; further items go to further automata, one pass each.
BLOCK_WORDS = 200_000
_RANGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_HIT = pa.struct([("n_words", pa.int64()), ("marks", _RANGES), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("cuts", _RANGES)])
_HIT_SQL = "struct<n_words:bigint,marks:array<struct<a:bigint,b:bigint>>,items:array<string>,longest:bigint,cuts:array<struct<a:bigint,b:bigint>>>"


class SuffixAutomaton:
    """All substrings of a set of id sequences, with the items that hold each window."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[int]] = []
        for _, ids in items:
            at, path = 0, []
            for c in ids:
                at = self._extend(at, c)
                path.append(at)
            ends.append(path)
        #: By state: (window length, names) of the windows that this state stands for.
        self.own: dict[int, list[tuple[int, set[str]]]] = {}
        for (name, ids), path in zip(items, ends, strict=True):
            size = min(window, len(ids))
            for i in range(size - 1, len(ids)):
                state = path[i]
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                held = self.own.setdefault(state, [])
                for n, names in held:
                    if n == size:
                        names.add(name)
                        break
                else:
                    held.append((size, {name}))
        #: By state: the nearest state on the suffix links, itself left out, that stands for a window.
        self.up = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            link = self.link[state]
            self.up[state] = link if link in self.own else self.up[link]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def stream(self, ids: list[int]) -> tuple[list[tuple[int, int]], set[str], int]:
        """(hit ranges of word positions, names, longest match) along a sequence: the state follows the longest suffix that any item holds."""
        nxt, link, length, own, up = self.next, self.link, self.length, self.own, self.up
        state = run = longest = 0
        hits: list[tuple[int, int]] = []
        names: set[str] = set()
        for i, c in enumerate(ids):
            while state and c not in nxt[state]:
                state = link[state]
                run = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                run += 1
            else:
                state = run = 0
                continue
            longest = max(longest, run)
            best, at = 0, state
            if at not in own:
                at = up[at]
            while at > 0:
                for n, who in own[at]:
                    if n <= run:
                        best = max(best, n)
                        names |= who
                at = up[at]
            if best:
                lo = i + 1 - best
                while hits and lo <= hits[-1][1]:
                    lo = min(lo, hits.pop()[0])
                hits.append((lo, i + 1))
        return hits, names, longest


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cuts(data: np.ndarray, base: int, start: np.ndarray, end: np.ndarray, w0: int, merged: list[tuple[int, int]]) -> list[dict]:
    """Ranges of word positions as ranges of code points."""
    out, at, seen = [], base, 0
    for x, y in merged:
        p, q = int(start[w0 + x]), int(end[w0 + y - 1])
        # bytes that don't go on with a character begin one
        seen += int(np.count_nonzero((data[at:p] & 0xC0) != 0x80))
        size = int(np.count_nonzero((data[p:q] & 0xC0) != 0x80))
        out.append({"a": seen, "b": seen + size})
        seen, at = seen + size, q
    return out


def _matches(batch: pa.RecordBatch, block: tuple):
    """(words of the batch's texts, by row: hit ranges, names, longest match)."""
    vocabulary, pairs, shortest, automaton = block
    data, offsets = text_buffer(batch.column("text"))
    found_words = words(data, offsets, alnum_words())
    _, _, hashes, first = found_words
    found: dict[int, list] = {}
    if len(vocabulary):
        at = np.searchsorted(vocabulary, hashes)
        at[at == len(vocabulary)] = 0
        ids = np.where(vocabulary[at] == hashes, at + 1, 0)
        # word i can go on to word i + 1 inside an item
        text_of = np.repeat(np.arange(len(batch)), np.diff(first))
        joined = ids[:-1] * (len(vocabulary) + 1) + ids[1:]
        near = np.searchsorted(pairs, joined)
        near[near == len(pairs)] = 0
        follows = (pairs[near] == joined) & (text_of[:-1] == text_of[1:]) if len(pairs) else np.zeros(max(0, len(ids) - 1), bool)
        known = ids > 0
        begins = known.copy()
        begins[1:] &= ~follows
        ends = known.copy()
        ends[:-1] &= ~follows
        lo, hi = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        long_ = hi - lo >= shortest
        for a, b in zip(lo[long_].tolist(), hi[long_].tolist(), strict=True):
            hits, names, longest = automaton.stream(ids[a:b].tolist())
            row, begin = found.setdefault(int(text_of[a]), [[], set(), 0]), a - int(first[text_of[a]])
            row[2] = max(row[2], longest)
            row[0] += [(x + begin, y + begin) for x, y in hits]
            row[1] |= names
    return data, offsets, found_words, found


def _hits(batch: pa.RecordBatch, data, offsets, found_words, found) -> pa.Array:
    start, end, _, first = found_words
    rows = []
    for i in range(len(batch)):
        marks, names, longest = found.get(i, ((), (), 0))
        merged = _merge(marks)
        rows.append({
            "n_words": int(first[i + 1] - first[i]), "marks": [{"a": x, "b": y} for x, y in merged], "items": sorted(names), "longest": longest,
            "cuts": _cuts(data, int(offsets[i]), start, end, int(first[i]), merged),
        })
    return pa.array(rows, _HIT)


def _scan(held, carry: list[str], name: str):
    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], _hits(batch, *_matches(batch, held.value))], [*carry, name])

    return run


def _scan_part(held):
    """Only texts with a match, by key, for one of several blocks."""

    def run(batches):
        for batch in slices(batches):
            _, _, _, found = _matches(batch, held.value)
            at = [i for i, row in found.items() if row[0] or row[2]]
            marks = [[{"a": x, "b": y} for x, y in _merge(found[i][0])] for i in at]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(at, pa.int64())), pa.array(marks, _RANGES), pa.array([sorted(found[i][1]) for i in at], pa.list_(pa.string())), pa.array([found[i][2] for i in at], pa.int64())],
                ["key", "marks", "items", "longest"],
            )

    return run


def _scan_merged(carry: list[str], name: str):
    """Hits from what the blocks found in each text."""

    def run(batches):
        for batch in slices(batches):
            data, offsets = text_buffer(batch.column("text"))
            found = {}
            for i, parts in enumerate(batch.column("parts").to_pylist()):
                if parts:
                    found[i] = ([(m["a"], m["b"]) for p in parts for m in p["marks"]], {x for p in parts for x in p["items"]}, max(p["longest"] for p in parts))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], _hits(batch, data, offsets, words(data, offsets, alnum_words()), found)], [*carry, name])

    return run


def _block(items: list[tuple[str, np.ndarray]], window: int, shortest: int) -> tuple:
    vocabulary = np.unique(np.concatenate([h for _, h in items]))
    coded = [(name, (np.searchsorted(vocabulary, h) + 1)) for name, h in items]
    pairs = np.unique(np.concatenate([c[:-1] * (len(vocabulary) + 1) + c[1:] for _, c in coded]))
    return vocabulary, pairs, shortest, SuffixAutomaton([(n, c.tolist()) for n, c in coded], window)


def benchmark_blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[tuple]:
    """Automata over the items (item_id, text), each over block_words words at most or one item, one after the other: the driver holds one partition of items and one block."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]++"))
    # no shorter run of words can hold a window of any block's items
    shortest = min(window, items.agg(F.min(F.when(n > 0, n))).first()[0] or window)
    held, size = [], 0
    for row in items.toLocalIterator():
        data, offsets = text_buffer(pa.array([row["text"]], pa.string()))
        _, _, h, _ = words(data, offsets, alnum_words())
        if not len(h):
            continue
        if size and size + len(h) > block_words:
            yield _block(held, window, shortest)
            held, size = [], 0
        held.append((row["name"], h))
        size += len(h)
    if held:
        yield _block(held, window, shortest)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 13, carry: tuple[str, ...] = ("doc_id",), name: str = "hit", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns `carry` of docs (doc_id, text), and in the struct `name` where the text holds windows of the test items (item_id, text).

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z
    lower-cased.  A window is `window` consecutive words of one item, or the whole
    item if that is shorter; a word inside any occurrence is hit.  The struct has
    n_words, marks (hit ranges of word positions), items (names of items with
    occurring windows, sorted as strings), longest (words of the longest match with
    any item, 0 if it has fewer than the shortest window) and cuts (hit ranges in code points, end exclusive).

    Up to block_words words of items make one automaton and one narrow pass over
    whole texts, without a shuffle: words that no item holds, and word pairs that no
    item holds, end a run before the automaton sees it.  Further items make further
    automata, built one at a time; each makes a pass over the texts that writes only
    its matches, by the text's hash, and these are merged by text in the end, so no
    benchmark is too large and the driver holds one block.  Null or empty texts have
    no words; items without words are left out; a null item_id counts as an empty
    name; an empty benchmark or table hits nothing.
    """
    spark = docs.sparkSession
    python_workers(spark)
    kinds = dict(docs.dtypes)
    fields = ", ".join([*[f"`{c}` {kinds[c]}" for c in carry], f"`{name}` {_HIT_SQL}"])
    blocks = benchmark_blocks(benchmark, window, block_words)
    one = next(blocks, (np.zeros(0, _U), np.zeros(0, np.int64), window, None))
    two = next(blocks, None)
    text = F.col("text").cast("string").alias("text")
    if two is None:
        columns = [F.col(f"`{c}`") for c in carry if c != "text"]
        return docs.select(*columns, text).mapInArrow(_scan(spark.sparkContext.broadcast(one), list(carry), name), fields)
    key = F.concat(F.md5(F.coalesce(text, F.lit(""))), F.xxhash64(text).cast("string"))
    keyed, parts = docs.select(key.alias("key"), text), []
    while one is not None:
        held = spark.sparkContext.broadcast(one)
        parts.append(materialize(keyed.mapInArrow(_scan_part(held), "key string, marks array<struct<a:bigint,b:bigint>>, items array<string>, longest bigint").dropDuplicates(["key"]), "block"))
        held.destroy()
        one, two = two, next(blocks, None) if two is not None else None
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = materialize(every.groupBy("key").agg(F.collect_list(F.struct("marks", "items", "longest")).alias("parts")), "blocks")  # one entry for each block at most
    discard(*parts)
    if "parts" in carry:
        raise ValueError("a carried column can't be named parts")
    row = F.struct(*[F.col(f"`{c}`") for c in carry if c != "text"], text).alias("row")
    joined = docs.select(row, key.alias("key")).join(merged, "key", "left").select("row.*", "parts")
    return joined.mapInArrow(_scan_merged(list(carry), name), fields)


def n_hit(name: str = "hit"):
    return F.aggregate(f"{name}.marks", F.lit(0).cast("long"), lambda n, m: n + m["b"] - m["a"])


def contaminated(percent: int = 5, name: str = "hit"):
    """A document is contaminated if at least percent of its words, and at least one, are hit."""
    return (n_hit(name) > 0) & (100 * n_hit(name) >= percent * F.col(f"{name}.n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5, mode: str = "drop", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without contamination, all columns kept: mode "drop" leaves contaminated documents out, "cut" cuts the hit spans out of their texts.

    Documents under the coverage limit stay as they are.  Rows with null or empty
    texts stay; columns may have any names; an empty table or benchmark changes nothing.
    """
    if mode not in ("drop", "cut"):
        raise ValueError(f"mode {mode!r} is neither 'drop' nor 'cut'")
    names = docs.columns
    # columns go by number inside, so that no name can clash
    inner = {c: "text" if c == "text" else f"c{i}" for i, c in enumerate(names)}
    hits = benchmark_hits(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()]), benchmark, window, tuple(inner.values()), "hit", block_words)
    if mode == "drop":
        hits = hits.where(~contaminated(percent))
    else:
        step = F.aggregate(
            "hit.cuts",
            F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")),
            lambda s, c: F.struct(F.concat(s["done"], F.col("text").substr((s["at"] + 1).cast("int"), (c["a"] - s["at"]).cast("int"))).alias("done"), c["b"].alias("at")),
            lambda s: F.concat(s["done"], F.col("text").substr((s["at"] + 1).cast("int"), F.lit(2147483647))),
        )
        hits = hits.withColumn("text", F.when(contaminated(percent), step).otherwise(F.col("text")))
    return hits.select(*[F.col(n).alias(c) for c, n in inner.items()])


def benchmark_digest(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match (words; 0 where nothing is hit) of each document."""
    hits = benchmark_hits(docs, benchmark, window, block_words=block_words)
    return hits.select(
        "doc_id", "hit.n_words", n_hit().alias("n_hit"), F.size("hit.items").cast("long").alias("n_items"), F.sha2(F.array_join("hit.items", ","), 256).alias("items_sha256"),
        contaminated(percent).alias("contaminated"), F.when(n_hit() > 0, F.col("hit.longest")).otherwise(0).alias("longest_match"),
    )
