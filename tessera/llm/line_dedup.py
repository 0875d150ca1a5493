"""Line dedup by a deletion-neighbourhood join on words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.wordhash import mix, space_words, text_buffer, words
from tessera.operators.ordering import positions
from tessera.operators.skew import hot_join, weighed
from tessera.runtime import discard, materialize, python_workers, slices

_U = np.uint64
_STEP = _U(0x9FB21C651E98DF25)
_POWER = int(_STEP) | 1


_tables: list[np.ndarray] = []


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    if not _tables or len(_tables[0]) < n:
        size = max(n, 1 << 16)
        both = np.full(size, _U(_POWER)), np.full(size, _U(pow(_POWER, -1, 1 << 64)))
        for t in both:
            t[0] = _U(1)
        _tables[:] = [np.multiply.accumulate(t) for t in both]
    return _tables[int(inverse)][:n]


class _Lines:
    """The lines with a word of a batch of texts, as ranges [lo, hi) of its words; keys of ranges come from one prefix sum."""

    def __init__(self, column: pa.Array):
        data, offsets = text_buffer(column)
        start, _, self.hashes, first = words(data, offsets, space_words())
        breaks = np.flatnonzero(data == 10)
        before = np.searchsorted(breaks, start)
        text_of = np.repeat(np.arange(len(column)), np.diff(first))
        new = np.ones(len(start), bool)
        new[1:] = (before[1:] != before[:-1]) | (text_of[1:] != text_of[:-1])
        self.lo = np.flatnonzero(new)
        self.hi = np.append(self.lo[1:], len(start)).astype(np.int64) if len(self.lo) else self.lo
        self.row = text_of[self.lo]
        self.line = before[self.lo] - np.searchsorted(breaks, offsets)[self.row]
        n = len(start)
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(self.hashes * _powers(n), dtype=_U)])
        self.down = _powers(n + 1, True)

    def keys(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes of the word sequences in the ranges."""
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo] + (hi - lo).astype(_U)).view(np.int64)


def _line_rows(batches):
    for batch in slices(batches):
        t = _Lines(batch.column("text"))
        n = t.hi - t.lo
        long_, short = n // 2, (n - 1) // 2
        halves, valid = [], []
        for p, wanted in ((long_, long_ > 0), (short, (short > 0) & (short != long_))):
            halves += [t.keys(t.lo, t.lo + p), (mix(t.keys(t.hi - p, t.hi).view(_U) + _U(1))).view(np.int64)]
            valid += [wanted, wanted]
        valid = np.array(valid).T.reshape(len(n), 4)
        flat = np.array(halves).T.reshape(len(n), 4)[valid]
        ends = np.concatenate([[0], np.cumsum(valid.sum(axis=1))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(t.row, pa.int64())), pa.array(t.line.astype(np.int64)), pa.array(t.keys(t.lo, t.hi)), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(ends, pa.array(flat, pa.int64()))],
            ["doc_id", "line", "lh", "n", "halves"],
        )


def _word_rows(batches):
    """The words of the wanted lines of each document, with the lines' numbers and which halves they share."""
    for batch in slices(batches):
        wanted = [{w["lh"]: w for w in row} for row in batch.column("wanted").to_pylist()]
        t = _Lines(batch.column("text"))
        found, bodies = [], []
        for i, k, lo, hi in zip(t.row.tolist(), t.keys(t.lo, t.hi).tolist(), t.lo.tolist(), t.hi.tolist(), strict=True):
            if w := wanted[i].pop(k, None):
                found.append(w)
                bodies.append(t.hashes[lo:hi].tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array([w["num"] for w in found], pa.int64()), pa.array([w["lh"] for w in found], pa.int64()), pa.array([w["head"] for w in found], pa.bool_()), pa.array([w["tail"] for w in found], pa.bool_()), pa.array(bodies, pa.binary())],
            ["num", "lh", "head", "tail", "body"],
        )


#: Places of a row of variants that stand for the line itself, and for a pair that a task found by itself.
WHOLE, PAIR = -1, -2


def _variants(batches):
    """(v, pos, num): each line itself, and its variants with one word deleted, one for each position that can differ from a line with which it shares a half.

    Of the lines of a batch with one variant only the earliest goes on; the others
    have it as a partner already (pos PAIR, v the partner's number).
    """
    for batch in batches:
        value, place, number = [], [], []
        rows = zip(batch.column("num").to_pylist(), batch.column("lh").to_pylist(), batch.column("head").to_pylist(), batch.column("tail").to_pylist(), batch.column("body"), strict=True)
        inverse = _U(pow(_POWER, -1, 1 << 64))
        for num, key, head, tail, body in rows:
            h = np.frombuffer(body.as_buffer(), _U)
            n = len(h)
            left = np.concatenate([[_U(0)], np.cumsum(h * _powers(n), dtype=_U)])
            # words after the deleted one move down by one power
            values = mix(left[:-1] + (left[-1] - left[1:]) * inverse + _U(n - 1)).view(np.int64)
            part = (n - 1) // 2
            lo, hi = 0 if tail else part, n if head else n - part
            value.append(np.concatenate([[key], values[lo:hi]]))
            place.append(np.concatenate([[WHOLE], np.arange(lo, hi)]))
            number.append(np.full(hi - lo + 1, num, np.int64))
        if not value:
            continue
        v, pos, num = (np.concatenate(x).astype(np.int64) for x in (value, place, number))
        order = np.lexsort((num, pos, v))
        v, pos, num = v[order], pos[order], num[order]
        again = np.zeros(len(v), bool)
        again[1:] = (v[1:] == v[:-1]) & (pos[1:] == pos[:-1])
        first = np.maximum.accumulate(np.where(again, 0, np.arange(len(v))))
        v, pos = np.where(again, num[first], v), np.where(again, PAIR, pos)
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(pos), pa.array(num)], ["v", "pos", "num"])


def within_one(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether one insertion, deletion or replacement at most turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    if not len(differ):
        return True
    p = int(differ[0])
    if len(a) == len(b):
        return bool((a[p + 1 :] == b[p + 1 :]).all())
    long_, short = (a, b) if len(a) > len(b) else (b, a)
    return bool((long_[p + 1 :] == short[p:]).all())


def _confirm(batches):
    for batch in slices(batches):
        good = [within_one(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("lh").filter(pa.array(good, pa.bool_()))], ["lh"])


def line_decisions(docs: DataFrame, min_words: int = 8) -> tuple[DataFrame, DataFrame]:
    """(lines, dropped) of docs (doc_id, text): lines has doc_id, line, lh for each line with a word; dropped has doc_id, line, near for each line that goes.

    A line is its sequence of words (runs of anything but ASCII white space, A-Z
    lower-cased), numbered by line ends.  Its first occurrence is the smallest
    (doc_id, line).  A line goes if its sequence occurred earlier, or if it has
    min_words words at least and an earlier first occurrence of such a line is within
    one word edit (insertion, deletion, replacement), whether that one goes or not.

    1. Lines collapse to distinct sequences by one partial aggregation.
    2. Two sequences within one edit share the first or the last half, so only
       sequences that share a half with another go on (four keys a line), numbered
       by first occurrence.
    3. These emit the hashes of variants with a word deleted, in the part that they
       don't share.  Equal variants at the same place mean a replacement, a variant
       equal to a line an insertion.  A batch keeps the earliest line of a variant
       and pairs the others with it, so of a template's lines one for each batch
       meets the others; variants are shuffled once, and a running window pairs
       each line with the earliest of its variant.
    4. Each pair is compared word by word.

    Rows with a null doc_id, null, empty or blank texts have no lines here and lose
    none; rows that repeat a doc_id count as one document.  An empty table has no
    lines.
    """
    spark = docs.sparkSession
    python_workers(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    lines = materialize(base.mapInArrow(_line_rows, "doc_id long, line long, lh long, n long, halves array<bigint>"), "lines")
    first = F.min(F.struct("doc_id", "line")).alias("first")
    distinct = materialize(lines.groupBy("lh").agg(first, F.count("*").alias("c"), F.first("n").alias("n"), F.first("halves").alias("halves")), "distinct")
    halves = materialize(distinct.where(F.col("n") >= min_words).select("lh", "first", F.posexplode("halves").alias("i", "half")), "halves")
    shared, known = weighed(halves.groupBy("half").agg(F.count("*").alias("c")).where("c > 1"), "c", "shared")
    near = hot_join(halves, shared, ["half"], "c", known=known).groupBy("lh", "first").agg(F.max(F.col("i") % 2 == 0).alias("head"), F.max(F.col("i") % 2 == 1).alias("tail"))
    near = positions(near.select("lh", "first.doc_id", "first.line", "head", "tail"), ["doc_id", "line"]).withColumnRenamed("position", "num")
    wanted = near.groupBy("doc_id").agg(F.collect_list(F.struct("lh", "num", "head", "tail")).alias("wanted"))  # a document's own lines
    bodies = base.join(wanted.hint("merge"), "doc_id").select("text", "wanted").mapInArrow(_word_rows, "num long, lh long, head boolean, tail boolean, body binary")
    bodies = materialize(bodies.dropDuplicates(["num"]), "bodies")
    rows = bodies.mapInArrow(_variants, "v long, pos long, num long").repartition("v")
    order = Window.partitionBy("v").orderBy("pos", "num").rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy("v", "pos").orderBy("num").rowsBetween(Window.unboundedPreceding, 0)
    line = F.first(F.when(F.col("pos") == WHOLE, F.col("num")), ignorenulls=True).over(order)
    rows = rows.withColumn("line", line).withColumn("low", F.first("num").over(group))
    found = F.when(F.col("pos") == PAIR, F.array("v")).when(F.col("pos") >= 0, F.array("low", "line")).otherwise(F.array().cast("array<bigint>"))
    pairs = rows.select("num", F.explode(found).alias("other")).where("other is not null and num <> other")
    pairs = materialize(pairs.select(F.greatest("num", "other").alias("num"), F.least("num", "other").alias("other")).distinct(), "pairs")
    x = pairs.join(bodies.select("num", "lh", F.col("body").alias("x")).hint("merge"), "num").select("lh", "other", "x")
    y, known = weighed(pairs.groupBy("other").agg(F.count("*").alias("c")).join(bodies.select(F.col("num").alias("other"), F.col("body").alias("y")).hint("merge"), "other"), "c", "others")
    gone = materialize(hot_join(x, y, ["other"], "c", known=known).select("lh", "x", "y").mapInArrow(_confirm, "lh long").distinct(), "gone")
    discard(halves, shared, bodies, pairs, y)
    state = distinct.select("lh", "first", "c").join(gone.withColumn("near", F.lit(True)).hint("merge"), "lh", "left")
    state = state.where("near or c > 1").select("lh", "first", F.coalesce("near", F.lit(False)).alias("near"), "c")
    state, known = weighed(state, "c", "state")
    discard(distinct, gone)
    marked = hot_join(lines.select("doc_id", "line", "lh"), state, ["lh"], "c", known=known).where(F.col("near") | (F.struct("doc_id", "line") != F.col("first")))
    return lines.select("doc_id", "line", "lh"), marked.select("doc_id", "line", "near")


def line_digest(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """doc_id, n_lines, n_exact, n_near, n_kept of each row of docs: lines with a word, those gone as equal, as near, and those that stay.

    A null doc_id or a text without words has zeros; rows that repeat a doc_id have
    the same figures; an empty table gives an empty result.
    """
    lines, dropped = line_decisions(docs, min_words)
    marks = lines.select("doc_id", "line", F.lit(0).alias("gone")).unionByName(dropped.select("doc_id", "line", F.when(F.col("near"), 2).otherwise(1).alias("gone")))
    each = marks.groupBy("doc_id", "line").agg(F.max("gone").alias("gone")).groupBy("doc_id")
    counts = each.agg(F.count("*").alias("n_lines"), F.count_if(F.col("gone") == 1).alias("n_exact"), F.count_if(F.col("gone") == 2).alias("n_near"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(counts.hint("merge"), "doc_id", "left")
    n = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_lines", "n_exact", "n_near")}
    return out.select("doc_id", *[v.alias(c) for c, v in n.items()], (n["n_lines"] - n["n_exact"] - n["n_near"]).alias("n_kept"))


def dedup_lines(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """docs without the lines that go; all columns kept, line ends between the lines that stay.

    Rows with a null doc_id or text stay as they are; a text that loses all its lines becomes empty.
    """
    _, dropped = line_decisions(docs, min_words)
    gone = dropped.groupBy(F.col("doc_id").alias("gone_id")).agg(F.collect_set("line").alias("gone_lines"))
    return _clean(docs, gone)


def _clean(docs: DataFrame, gone: DataFrame) -> DataFrame:
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    joined = inner.join(gone, F.col("row.doc_id").cast("long") == F.col("gone_id"), "left")
    kept = F.array_join(F.filter(F.split("row.text", "\n"), lambda _, i: ~F.array_contains("gone_lines", i.cast("long"))), "\n")
    text = F.when(F.col("gone_lines").isNull(), F.col("row.text")).otherwise(kept).alias("text")
    return joined.select(*[text if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names])
