"""Pair operators: exact groups, Hamming range joins, cosine neighbours, tiers and upgrades."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.columns import dot, hamming, hash_confidence
from tessera.operators.ordering import numbered_groups
from tessera.runtime import materialize, python_workers, slices


def exact_groups(rows: DataFrame, key: str = "exact_hash", member: str = "path") -> DataFrame:
    """(key, representative, group_size) of keys with two members at least: partial aggregates only, so a key with a third of all rows is no burden. Null keys form no group."""
    found = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(member).alias("representative"), F.count_distinct(member).alias("group_size"))
    return found.where("group_size >= 2")


def exact_members(rows: DataFrame, key: str = "exact_hash", member: str = "path", confidence: int = 100) -> DataFrame:
    """A row for each member of an exact group: group_id, file_path, representative, group_size, confidence, match_type."""
    found = exact_groups(rows, key, member).withColumns({"confidence": F.lit(confidence), "match_type": F.lit("exact")})
    members = rows.select(key, F.col(member).alias("file_path")).where("file_path is not null").distinct()
    return members.join(numbered_groups(found), key).select("group_id", "file_path", "representative", "group_size", "confidence", "match_type")


def exact_pairs(rows: DataFrame, key: str = "exact_hash", member: str = "path", confidence: int = 100) -> DataFrame:
    """All pairs a < b inside a key: the expanded report; clustering uses star_edges, which grow with the rows and not with their square."""
    a, b = rows.select(key, F.col(member).alias("a")), rows.select(key, F.col(member).alias("b"))
    return a.join(b, key).where("a < b").select("a", "b", F.lit(confidence).alias("confidence"), F.lit("exact").alias("match_type"))


def star_edges(rows: DataFrame, key: str = "exact_hash", member: str = "path") -> DataFrame:
    low = rows.groupBy(key).agg(F.min(member).alias("a"))
    return rows.join(low, key).where(F.col(member) > F.col("a")).select("a", F.col(member).alias("b"), F.lit(100).alias("confidence"), F.lit("exact").alias("match_type"))


def canonical_rows(rows: DataFrame, key: str = "exact_hash", member: str = "path") -> DataFrame:
    """The row with the smallest member of each key."""
    low = rows.groupBy(key).agg(F.min(member).alias(member))
    return rows.join(low, [key, member], "left_semi")


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *[c for c in pairs.columns if c not in ("a", "b")])


def vector_signatures(vectors: DataFrame) -> DataFrame:
    """(id, p, d) of vectors (id, embedding): the signs of the first 64 elements, and whether each of the 63 after the first is above the one before, in one numpy pass.

    What columns.sign_bits and columns.pack_bits say of the same flags, with Spark's
    order of floats: NaN is above all else, and a null or missing element sets no bit.
    A null embedding has null signatures.
    """
    python_workers(vectors.sparkSession)

    def packed(flags: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(flags), 64), bool)
        wide[:, 64 - flags.shape[1] :] = flags
        return np.packbits(wide, axis=1).view(">u8")[:, 0].astype(np.uint64).view(np.int64)

    def run(batches):
        for batch in slices(batches, 1 << 14):
            column = batch.column("embedding")
            size = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), -1)
            start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
            flat = column.flatten()
            there = flat.is_valid().to_numpy(zero_copy_only=False)
            value = flat.to_numpy(zero_copy_only=False)
            p, d = np.zeros((2, len(batch)), np.int64)
            for n in np.unique(size[size >= 0]).tolist():
                of = np.flatnonzero(size == n)
                at = start[of][:, None] + np.arange(min(n, 64))
                x, known = value[at], there[at]
                odd = np.isnan(x) & known
                p[of] = packed(known & ((x > 0) | odd))
                up = known[:, 1:] & known[:, :-1] & ((x[:, 1:] > x[:, :-1]) | (odd[:, 1:] & ~odd[:, :-1]))
                d[of] = packed(np.pad(up, ((0, 0), (0, 63 - up.shape[1]))))
            none = pa.array(size < 0)
            blank = lambda v: pc.if_else(none, pa.scalar(None, pa.int64()), pa.array(v))
            yield pa.RecordBatch.from_arrays([batch.column("id"), blank(p), blank(d)], ["id", "p", "d"])

    rows = vectors.select("id", "embedding")
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, p long, d long")


def hamming_theta(sigs: DataFrame, p_max: int, d_max: int) -> DataFrame:
    """Pairs a < b of sigs (id, p, d) within both distances, every pair compared: the check of hamming_join."""
    x, y = sigs.select(F.col("id").alias("a"), F.col("p").alias("pa"), F.col("d").alias("da")), sigs.select(F.col("id").alias("b"), F.col("p").alias("pb"), F.col("d").alias("db"))
    both = x.join(y, F.col("a") < F.col("b")).select("a", "b", hamming("pa", "pb").alias("p_dist"), hamming("da", "db").alias("d_dist"))
    return both.where((F.col("p_dist") <= p_max) & (F.col("d_dist") <= d_max))


def _edges(n: int) -> list[tuple[int, int]]:
    """n bands of the 64 bits: (first bit, bits)."""
    at = [round(64 * i / n) for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(at, at[1:], strict=False)]


def _bands(signature: str, n: int):
    """n disjoint bands of the 64 bits: signatures within n - 1 bits agree in one at least, and those within 2 n - 1 bits differ in one bit of some band at most."""
    mask = lambda w: (1 << w) - 1 if w < 64 else -1
    return F.array(*[F.shiftrightunsigned(signature, lo).bitwiseAND(F.lit(mask(w)).cast("bigint")) for lo, w in _edges(n)])


def _around(bands: str, n: int):
    """By band: its value, and all values one bit away."""
    flips = F.array(*[F.array(F.lit(0).cast("bigint"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(w)]) for _, w in _edges(n)])
    return F.zip_with(bands, flips, lambda v, f: F.transform(f, lambda x: v.bitwiseXOR(x)))


def _close_by_join(classes: DataFrame, key: str, most: int, p_max: int, d_max: int) -> DataFrame:
    """Close pairs of classes (p, d) by an equi-join: most // 2 + 1 bands, one side with the bands as keys, the other with all values within a bit of its own."""
    n = most // 2 + 1
    classes = classes.withColumn("bands", _bands(key, n))
    x = classes.select(F.col("p").alias("pa"), F.col("d").alias("da"), F.col("bands").alias("xs"), F.posexplode(_around("bands", n)).alias("band", "near")).withColumn("v", F.explode("near")).drop("near")
    y = classes.select(F.col("p").alias("pb"), F.col("d").alias("db"), F.col("bands").alias("ys"), F.posexplode("bands").alias("band", "v"))
    earlier = F.array_position(F.zip_with("xs", "ys", lambda s, t: hamming(s, t) <= 1), F.lit(True)) - 1
    ordered = (F.col("pa") < F.col("pb")) | ((F.col("pa") == F.col("pb")) & (F.col("da") <= F.col("db")))
    return x.join(y, ["band", "v"]).where(ordered & (hamming("pa", "pb") <= p_max) & (hamming("da", "db") <= d_max) & (earlier == F.col("band"))).select("pa", "da", "pb", "db")


#: Signatures of a block, about (2 MB); queries that look into a block at once; pairs compared at once.
SIGNATURES, QUERIES, COMPARED = 1 << 17, 64, 1 << 20


def _search_bands(rows: int, most: int) -> tuple[list[tuple[int, int]], int]:
    """Bands (first bit, bits) and the radius within which one band at least of signatures within `most` bits agrees: the cheapest by microseconds for a block; one band of no bits, so every pair, if no bands pay."""
    best, bands, radius = rows * rows / 2 * 0.0025, [(0, 0)], 0
    for n in range(4, most + 2):
        r, w = most // n, round(64 / n)
        values = sum(math.comb(w, i) for i in range(r + 1))
        cost = n * (min(rows, 1 << w) * (40 + 0.03 * values) + rows * rows / 2 * 0.003 * values / (1 << w))
        if cost < best:
            best, bands, radius = cost, _edges(n), r
    return bands, radius


def _close_in_blocks(x: np.ndarray, y: np.ndarray | None, bands: list[tuple[int, int]], radius: int, limits: tuple[int, int], part: int, parts: int):
    """(rows of x, rows of y) in chunks that are close: x and y have the searched and the other signature as rows; y is None for pairs inside x, each once and every row with itself.

    By band, rows are sorted by their value, and the rows of a value meet those of
    all values within the radius.  A pair counts in the first band that brings it
    together.  Every parts-th chunk of queries is searched.
    """
    turn = 0
    for at, (lo, w) in enumerate(bands):
        value = lambda s: ((s >> np.uint64(lo)) & np.uint64((1 << w) - 1)).astype(np.int64)  # noqa: B023, E731
        flips = np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(w), r)], np.int64)
        order = np.argsort(value(x[0]), kind="stable")
        own = x[:, order]
        place, other = (order, own) if y is None else (o := np.argsort(value(y[0]), kind="stable"), y[:, o])
        every = np.arange((1 << w) + 1)
        first, start = np.searchsorted(value(own[0]), every), np.searchsorted(value(other[0]), every)
        for v in np.flatnonzero(np.diff(first)).tolist():
            u = None
            for q in range(first[v], first[v + 1], QUERIES):
                turn += 1
                if turn % parts != part:
                    continue
                if u is None:
                    u = np.sort(flips ^ v)
                    u = u[u >= v] if y is None else u
                    n = start[u + 1] - start[u]
                    ends = np.cumsum(n)
                    targets = np.arange(ends[-1]) + np.repeat(start[u] - (ends - n), n)
                asked = np.arange(q, min(q + QUERIES, first[v + 1]))
                step = max(1, COMPARED // len(asked))
                for t in range(0, len(targets), step):
                    some = targets[t : t + step]
                    hit = np.flatnonzero(np.bitwise_count(own[0, asked][:, None] ^ other[0, some][None, :]) <= limits[0])
                    i, j = asked[hit // len(some)], some[hit % len(some)]
                    keep = np.bitwise_count(own[1, i] ^ other[1, j]) <= limits[1]
                    if y is None:
                        keep &= i <= j
                    i, j = i[keep], j[keep]
                    apart = own[0, i] ^ other[0, j]
                    for b, bits in bands[:at]:
                        new = np.bitwise_count((apart >> np.uint64(b)) & np.uint64((1 << bits) - 1)) > radius
                        i, j, apart = i[new], j[new], apart[new]
                    if len(i):
                        yield order[i], place[j]


#: Close pairs that a search sends on at once, about.
SENT = 1 << 16


def _in_batches(found, names: list[str], most: int = SENT):
    """The arrays of `found`, chunk after chunk, as record batches of `most` rows and more: a batch for each small chunk would cost more than the search."""
    held: list[tuple] = []
    rows = 0
    for chunk in found:
        held.append(chunk)
        rows += len(chunk[0])
        if rows >= most:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held, strict=True)], names)
            held, rows = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held, strict=True)], names)


def _pairs_by_blocks(named: DataFrame, key: str, most: int, p_max: int, d_max: int, block: int) -> DataFrame:
    """Close pairs of named (id, p, d): blocks of about `block` signatures are packed as buffers with their ids, and each two blocks meet in a task or several.

    Where every signature has one row, what a task finds is the result; else the
    members of signatures that several rows have are joined to it.
    """
    spark = named.sparkSession
    python_workers(spark)
    kind = dict(named.dtypes)["id"]
    seen, known = Observation(), Observation()
    named = materialize(named.select("id", "p", "d").observe(seen, F.count(F.lit(1)).alias("rows")), "signatures")
    rows = seen.get.get("rows") or 0
    blocks = max(1, -(-rows // block))
    meetings = blocks * (blocks + 1) // 2
    parts = max(1, 24 // meetings)
    first, limits = (("p", "d"), (p_max, d_max)) if key == "p" else (("d", "p"), (d_max, p_max))

    def pack(table: pa.Table) -> pa.Table:
        raw = [np.ascontiguousarray(table.column(c).to_numpy(), np.int64).tobytes() for c in (*first, "n")]
        ids = table.column("id").combine_chunks()
        ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
        return pa.table({"block": table.column("block")[:1], "own": pa.array([b"".join(raw)], pa.binary()), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)})

    classes = named.groupBy("p", "d").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    classes = classes.observe(known, F.count(F.lit(1)).alias("classes"), F.max("n").alias("most"))
    packed = classes.withColumn("block", F.pmod(F.xxhash64("p", "d"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(pack, f"block int, own binary, ids array<{kind}>")
    packed = materialize(packed, "blocks")
    known = known.get
    bands, radius = _search_bands(-(-(known.get("classes") or 0) // blocks), most)

    def run(batches):
        of = lambda raw: np.frombuffer(raw, np.uint64).reshape(3, -1)
        apart = lambda s, t: pa.array(np.bitwise_count(s ^ t).astype(np.int32))

        def found():
            for batch in batches:
                for r in range(len(batch)):
                    x, ids = of(batch.column("own")[r].as_buffer()), batch.column("ids")[r].values
                    inside = not batch.column("other")[r].is_valid
                    y, others = (None, ids) if inside else (of(batch.column("other")[r].as_buffer()), batch.column("other_ids")[r].values)
                    for i, j in _close_in_blocks(x[:2], None if inside else y[:2], bands, radius, limits, batch.column("part")[r].as_py(), parts):
                        if inside:
                            keep = (i != j) | (x[2, i] > 1)
                            i, j = i[keep], j[keep]
                        z = x if inside else y
                        dist = [apart(x[0, i], z[0, j]), apart(x[1, i], z[1, j])]
                        yield ids.take(pa.array(i)), others.take(pa.array(j)), *(dist if key == "p" else dist[::-1])

        yield from _in_batches(found(), ["x", "y", "p_dist", "d_dist"])

    inside = packed.select("own", "ids", F.lit(None).cast("binary").alias("other"), F.lit(None).cast(f"array<{kind}>").alias("other_ids"))
    later = packed.select("own", "ids", F.explode(F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: i > F.col("block"))).alias("block"))
    meet = inside.unionByName(later.join(packed.withColumnRenamed("own", "other").withColumnRenamed("ids", "other_ids").hint("merge"), "block").drop("block"))
    meet = meet.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # few rows to a task, as each may have two blocks
    close = meet.repartition(min(parts * meetings, 4096)).mapInArrow(run, f"x {kind}, y {kind}, p_dist int, d_dist int")
    if (known.get("most") or 0) > 1:
        several = named.groupBy("p", "d").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        member = named.join(several, ["p", "d"]).select("class", "id")
        for side in ("x", "y"):
            close = close.join(member.select(F.col("class").alias(side), F.col("id").alias(f"{side}_id")), side, "left").withColumn(f"{side}_id", F.coalesce(f"{side}_id", side))
        # the rows of a signature meet each other both ways
        close = close.where((F.col("x") != F.col("y")) | (F.col("x_id") < F.col("y_id"))).select(F.col("x_id").alias("x"), F.col("y_id").alias("y"), "p_dist", "d_dist")
    return close.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "p_dist", "d_dist")


def hamming_join(sigs: DataFrame, p_max: int, d_max: int, block: int = SIGNATURES) -> DataFrame:
    """The pairs of hamming_theta by multi-index search on the tighter signature.

    Within d bits, one of n bands differs in d // n bits at most.  For few bits the
    bands are keys of a join: of d // 2 + 1 bands one differs in one bit at most (for
    6 bits, 4 bands of 16 bits, so each bucket has 1 / 65,536 of the rows).  Where
    that join would meet over a hundredth of all pairs, as beyond 8 bits, fewer and
    wider bands are searched with a larger radius, inside packed blocks of signatures
    (for 18 bits, 5 bands of 13 bits within 3 bits), so candidates are never rows.
    Either way they are verified on both signatures and kept in the first band that
    brings them together, and no pair is missed.

    Equal signatures meet once, as classes, so a large group of copies costs its
    output and no more candidates.  Null signatures match nothing; an empty table has
    no pairs.
    """
    key, most = ("d", d_max) if d_max <= p_max else ("p", p_max)
    named = sigs.where("p is not null and d is not null")
    share = sum((w + 1) / 2.0**w for _, w in _edges(most // 2 + 1))
    if share > 0.01:
        return _pairs_by_blocks(named, key, most, p_max, d_max, block)
    close = _close_by_join(named.select("p", "d").distinct(), key, most, p_max, d_max)
    left = named.select(F.col("id").alias("a"), F.col("p").alias("pa"), F.col("d").alias("da"))
    right = named.select(F.col("id").alias("b"), F.col("p").alias("pb"), F.col("d").alias("db"))
    same = (F.col("pa") == F.col("pb")) & (F.col("da") == F.col("db"))
    both = close.join(left, ["pa", "da"]).join(right, ["pb", "db"]).where(~same | (F.col("a") < F.col("b")))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), hamming("pa", "pb").alias("p_dist"), hamming("da", "db").alias("d_dist"))


def hamming_among(candidates: DataFrame, sigs: DataFrame, p_max: int, d_max: int) -> DataFrame:
    """The pairs of hamming_theta that are among candidates (a, b), a < b: their signatures are looked up, so nothing is searched and no pair of the candidates is missed."""
    named = sigs.where("p is not null and d is not null")
    of = lambda x: named.select(F.col("id").alias(x), F.col("p").alias(f"p{x}"), F.col("d").alias(f"d{x}"))
    both = candidates.select("a", "b").where("a < b").join(of("a"), "a").join(of("b"), "b")
    return both.select("a", "b", hamming("pa", "pb").alias("p_dist"), hamming("da", "db").alias("d_dist")).where((F.col("p_dist") <= p_max) & (F.col("d_dist") <= d_max))


def crop_join(sigs: DataFrame, most: int = 2) -> DataFrame:
    """Pairs in which one side's crop signatures (crop_p, crop_d) are within `most` bits of the other's full ones; the smaller sum for each pair."""
    full = sigs.select(F.col("id").alias("j"), F.col("p").alias("pj"), F.col("d").alias("dj"), F.posexplode(_bands("d", most + 1)).alias("band", "v"))
    crop = sigs.where("crop_p is not null and crop_d is not null")
    crop = crop.select(F.col("id").alias("i"), F.col("crop_p").alias("pi"), F.col("crop_d").alias("di"), F.posexplode(_bands("crop_d", most + 1)).alias("band", "v"))
    hits = crop.join(full, ["band", "v"]).where("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), hamming("pi", "pj").alias("p_dist"), hamming("di", "dj").alias("d_dist"))
    best = hits.where((F.col("p_dist") <= most) & (F.col("d_dist") <= most)).groupBy("a", "b")
    return best.agg(F.min(F.struct((F.col("p_dist") + F.col("d_dist")).alias("sum"), "p_dist", "d_dist")).alias("m")).select("a", "b", "m.p_dist", "m.d_dist")


def near_duplicates(sigs: DataFrame, p_max: int = 8, d_max: int = 6, base: float = 95, decay: float = 2.0) -> DataFrame:
    """Full-to-full pairs and crop-to-full pairs, the smaller distance sum of each (the full one on ties), with a confidence."""
    full = hamming_join(sigs, p_max, d_max).withColumn("rank", F.lit(0))
    crop = crop_join(sigs).withColumn("rank", F.lit(1)) if {"crop_p", "crop_d"} <= set(sigs.columns) else full.limit(0)
    best = full.unionByName(crop).groupBy("a", "b").agg(F.min(F.struct((F.col("p_dist") + F.col("d_dist")).alias("sum"), "rank", "p_dist", "d_dist")).alias("m"))
    best = best.select("a", "b", "m.p_dist", "m.d_dist")
    return best.select("a", "b", hash_confidence("p_dist", "d_dist", base, decay).alias("confidence"), F.lit("near_exact").alias("match_type"), "p_dist", "d_dist")


#: Rows of a block of vectors, about.
BLOCK = 4096


def _pack(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ids and vectors of rows (id, embedding, keys): a row for each group, its vectors as one buffer, of 32-bit floats if they are floats and else of 64-bit ones, sorted by id."""
    kinds = dict(rows.dtypes)
    short = kinds["embedding"] == "array<float>"

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        column = table.column("embedding").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        raw = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), np.float32 if short else np.float64).tobytes()
        one = {k: table.column(k)[:1] for k in keys}
        return pa.table({**one, "ids": pa.array([table.column("id").to_pylist()], pa.list_(table.schema.field("id").type)), "short": pa.array([short]), "vectors": pa.array([raw], pa.binary())})

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"ids array<{kinds['id']}>", "short boolean", "vectors binary"])
    return rows.select("id", F.col("embedding").cast(f"array<{'float' if short else 'double'}>").alias("embedding"), *keys).groupBy(*keys).applyInArrow(run, schema)


#: Queries that meet a block of targets at once.
ASKED = 512


def _true_at(flags: np.ndarray) -> np.ndarray:
    """np.flatnonzero of flags that are few, eight at a time."""
    flat = flags.ravel()
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    row, at = np.nonzero(flat[:whole].reshape(-1, 8)[words])
    return np.concatenate((words[row] * 8 + at, whole + np.flatnonzero(flat[whole:])))


def best_of(queries: np.ndarray, targets: np.ndarray, ids: np.ndarray, held: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, room: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, similarity, id) of the k best for each query, of those held and the targets, sorted by both; equal similarities, at 12 digits, by id.

    A product of 32-bit floats tells which targets can be among the best, with all
    that its rounding may hide; the similarity of those is a 64-bit one.  `room`: at
    least as many 32-bit floats as there are products, to be used again.
    """
    n, m = len(queries), len(targets)
    size = np.sqrt((queries**2).sum(axis=1)), np.sqrt((targets**2).sum(axis=1).max(initial=0.0))
    kind = np.float32 if size[0].max(initial=0.0) < 1e15 and size[1] < 1e15 else np.float64
    slack = 1e-12 + (queries.shape[1] + 8) * 2.5e-7 * size[0] * size[1]
    sims = room[: n * m].reshape(n, m) if room is not None and kind == np.float32 else np.empty((n, m), kind)
    np.matmul(queries.astype(kind), targets.astype(kind).T, out=sims)
    row, value, name = held
    last = np.searchsorted(row, np.arange(n), side="right") - 1
    full = np.bincount(row, minlength=n) >= k
    least = np.full(n, -np.inf)
    least[full] = value[last[full]] - slack[full]
    if m > k and not full.all():
        least[~full] = np.partition(sims[~full], m - k, axis=1)[:, m - k] - 2 * slack[~full]
    # next lower: a limit that was rounded up would leave out what equals it
    hit = _true_at(sims >= np.nextafter(least.astype(kind), kind(-np.inf))[:, None])
    i, j = hit // m, hit % m
    exact = np.concatenate([np.round((queries[i[at : at + 65536]] * targets[j[at : at + 65536]]).sum(axis=1), 12) for at in range(0, len(i), 65536)] or [np.zeros(0)])
    better = ~full[i]
    known = np.flatnonzero(~better)
    at = last[i[known]]
    better[known] = (exact[known] > value[at]) | ((exact[known] == value[at]) & (ids[j[known]] < name[at]))
    i, j, exact = i[better], j[better], exact[better]
    if not len(i):
        return held
    row, value, name = np.concatenate((row, i)), np.concatenate((value, exact)), np.concatenate((name, ids[j]))
    order = np.lexsort((name, -value, row))
    row, value, name = row[order], value[order], name[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return tuple(x[place < k] for x in (row, value, name))


def _topk_stream(k: int, kind: pa.DataType):
    """Runs of equal `key`, the queries' block first (own): the k best targets of each query over all blocks of the run, with one block of targets in memory."""

    def run(batches):
        key = queries = held = names = None
        room = np.empty(0, np.float32)

        def flush():
            row, value, name = (np.concatenate(x) for x in zip(*[(h[0] + at * ASKED, h[1], h[2]) for at, h in enumerate(held)], strict=True))
            return pa.RecordBatch.from_arrays([pa.array(names[row].tolist(), kind), pa.array(name.tolist(), kind), pa.array(value)], ["i", "j", "similarity"])

        for batch in batches:
            for r in range(len(batch)):
                ids = np.array(batch.column("ids")[r].as_py())
                x = np.frombuffer(batch.column("vectors")[r].as_buffer(), np.float32 if batch.column("short")[r].as_py() else np.float64).reshape(len(ids), -1).astype(np.float64)
                now = batch.column("key")[r].as_py()
                if now != key:
                    if held is not None:
                        yield flush()
                    key, queries, names = now, x, ids
                    held = [(np.zeros(0, np.int64), np.zeros(0), ids[:0]) for _ in range(0, len(ids), ASKED)]
                if batch.column("targets")[r].as_py():
                    room = np.empty(ASKED * len(x), np.float32) if len(room) < ASKED * len(x) else room
                    held = [best_of(queries[at * ASKED : (at + 1) * ASKED], x, ids, h, k, room) for at, h in enumerate(held)]
        if held is not None:
            yield flush()

    return run


def _search(blocks: DataFrame, k: int, kind: str) -> DataFrame:
    """(i, j, similarity) of blocks (key, own, targets, ids, short, vectors): the k best for each query, over all keys that it has."""
    spark = blocks.sparkSession
    python_workers(spark)
    # keys are few and heavy, so they are dealt over more partitions than there are cores
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 64)
    laid = blocks.repartition(parts, "key").sortWithinPartitions("key", F.desc("own"))
    arrow = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    found = laid.select("key", "targets", "ids", "short", "vectors").mapInArrow(_topk_stream(k, arrow), f"i {kind}, j {kind}, similarity double")
    order = Window.partitionBy("i").orderBy(F.desc("similarity"), "j")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def cosine_topk(vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(i, j, similarity) of the k nearest rows j, i itself included, of each row of vectors (id, embedding); ties by id.

    Blocks of about `block` vectors are packed as float buffers; a block of queries
    meets every block in turn in one stream, by a matrix product of 512 queries at a
    time, and keeps only k rows for each query; what can't be among them isn't ranked.
    A task holds two blocks and writes k rows for each of its queries.  Every pair is compared: the work grows with the square of the rows, and
    larger blocks mean fewer copies.  Rows with a null id or embedding are left out;
    ids are integers or strings; an empty table has no neighbours.
    """
    rows = vectors.where("id is not null and embedding is not null")
    blocks = max(1, -(-rows.count() // block))
    packed = materialize(_pack(rows.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")), ["block"]), "blocks")
    meet = packed.withColumn("key", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("own", F.col("key") == F.col("block")).withColumn("targets", F.lit(True))
    return _search(meet, k, dict(rows.dtypes)["id"])


def _candidates(near: DataFrame, threshold: float) -> DataFrame:
    near = near.where((F.col("i") != F.col("j")) & (F.col("similarity") >= threshold))
    return near.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.max("similarity").alias("similarity"))


def cosine_candidates(vectors: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs a < b where either is among the k nearest of the other (itself counted) and the similarity reaches the threshold."""
    return _candidates(cosine_topk(vectors, k), threshold)


def knn_single(vectors: DataFrame, query: list[float], k: int, threshold: float) -> DataFrame:
    """The k nearest rows of one vector that reach the threshold."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("id", dot("embedding", q).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k).where(F.col("similarity") >= threshold)


def cell_count(rows: int) -> int:
    """Cells of an index over so many rows: four times the root, a tenth of the rows at most."""
    return max(1, min(int(4 * rows**0.5), rows // 10))


def train_cells(vectors: DataFrame, nlist: int | None = None, seed: int = 42, sample: int = 20_000) -> np.ndarray:
    """Cell centres by spherical k-means on at most `sample` rows in seeded hash order: nlist or cell_count cells, a tenth as many as rows at most."""
    rows = vectors.where("id is not null and embedding is not null")
    n = rows.count()
    cells = max(1, min(nlist if nlist is not None else cell_count(n), n // 10))
    chosen = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).select("embedding").collect()  # `sample` rows at most
    if not chosen:
        return np.zeros((0, 0))
    x = np.array([r["embedding"] for r in chosen], dtype=float)
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:cells]].copy()
    for _ in range(15):
        label = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x)
        full = np.bincount(label, minlength=len(centres)) > 0
        centres[full] = sums[full] / np.maximum(1e-12, np.linalg.norm(sums[full], axis=1, keepdims=True))
    return centres


def nearest_cells(vectors: DataFrame, centres: np.ndarray, many: int) -> DataFrame:
    """(id, embedding, cells): the nearest cells of each row of vectors; rows with a null id or embedding are left out."""
    spark = vectors.sparkSession
    python_workers(spark)
    held = spark.sparkContext.broadcast(centres)  # at most a tenth of train_cells' sample

    def run(batches):
        for batch in slices(batches, 4096):
            v = np.ascontiguousarray(batch.column("embedding").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(batch), -1)
            near = np.argsort(-(v @ held.value.T), axis=1, kind="stable")[:, :many].astype(np.int32)
            ends = np.arange(len(batch) + 1, dtype=np.int32) * near.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("embedding"), pa.ListArray.from_arrays(ends, near.ravel())], ["id", "embedding", "cells"])

    rows = vectors.where("id is not null and embedding is not null").select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, embedding array<double>, cells array<int>")


def ivf_topk(vectors: DataFrame, k: int, nlist: int | None = None, nprobe: int | None = None, seed: int = 42, sample: int = 20_000, block: int = BLOCK) -> DataFrame:
    """cosine_topk by cells: every row is a target in its nearest cell, and a query in its nprobe nearest cells (a tenth of them, ten at least, where it isn't given).

    A cell's queries and targets are packed into blocks of about `block` rows, so a
    large cell is many tasks; a block of queries meets its cell's blocks in one stream.
    """
    centres = train_cells(vectors, nlist, seed, sample)
    probes = min(nprobe if nprobe is not None else max(10, -(-len(centres) // 10)), max(1, len(centres)))
    near = materialize(nearest_cells(vectors, centres, probes), "cells")
    ask = near.select("id", "embedding", F.explode("cells").alias("cell"))
    home = near.select("id", "embedding", F.get("cells", F.lit(0)).alias("cell"))

    def packed(rows: DataFrame) -> DataFrame:
        n = rows.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("n"))  # a row for each cell
        return materialize(_pack(rows.join(F.broadcast(n), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")), ["cell", "part", "n"]), "blocks")

    x, y = packed(ask), packed(home)
    key = F.col("cell").cast("long") * F.lit(1 << 32) + F.col("part")
    asked = x.select(key.alias("key"), F.lit(True).alias("own"), F.lit(False).alias("targets"), "ids", "short", "vectors")
    parts = x.select("cell", "n").distinct()  # a row for each cell
    meet = y.drop("part", "n").join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    # parts that hash left empty have no queries
    meet = meet.join(F.broadcast(x.select("cell", "part")), ["cell", "part"], "left_semi").select(key.alias("key"), F.lit(False).alias("own"), F.lit(True).alias("targets"), "ids", "short", "vectors")
    return _search(asked.unionByName(meet), k, dict(near.dtypes)["id"])


def ivf_candidates(vectors: DataFrame, k: int, threshold: float, nlist: int | None = None, nprobe: int | None = None, seed: int = 42, sample: int = 20_000) -> DataFrame:
    """cosine_candidates by cells (ivf_topk)."""
    return _candidates(ivf_topk(vectors, k, nlist, nprobe, seed, sample), threshold)


def save_index(vectors: DataFrame, folder: str, nlist: int | None = None, seed: int = 42, sample: int = 20_000) -> None:
    """Cell centres, and all rows partitioned by cell, as Parquet under folder."""
    centres = train_cells(vectors, nlist, seed, sample)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    vectors.sparkSession.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres")
    placed = nearest_cells(vectors, centres, 1).select("id", "embedding", F.get("cells", F.lit(0)).alias("cell"))
    # a cell's rows go to several files if the cell is large
    spread = F.pmod(F.xxhash64("id"), F.lit(4))
    placed.repartition("cell", spread).write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/rows")


def query_index(spark, folder: str, query: list[float], k: int, threshold: float, nprobe: int = 10) -> DataFrame:
    """The k nearest rows of one vector among its nprobe nearest cells of a saved index; other cells' files aren't read."""
    centres = spark.read.parquet(f"{folder}/centres").orderBy("cell").collect()
    q = np.array(query, dtype=float)
    order = sorted(centres, key=lambda r: -float(np.dot(r["centre"], q)))[:nprobe]
    rows = spark.read.schema("id long, embedding array<double>, cell int").parquet(f"{folder}/rows")
    return knn_single(rows.where(F.col("cell").isin([r["cell"] for r in order])), query, k, threshold)


def tier_split(pairs: DataFrame, strict: int = 2) -> DataFrame:
    """pairs with tier: `strict` if both distances are within the bits, else `deferred`."""
    return pairs.withColumn("tier", F.when((F.col("p_dist") <= strict) & (F.col("d_dist") <= strict), "strict").otherwise("deferred"))


def skip_decided(candidates: DataFrame, matched: DataFrame, rejected: DataFrame) -> DataFrame:
    """Candidates (a, b) that no earlier stage matched, with whether one rejected them."""
    marks = rejected.select("a", "b").distinct().withColumn("was_rejected", F.lit(True))
    return candidates.join(matched.select("a", "b"), ["a", "b"], "left_anti").join(marks, ["a", "b"], "left").withColumn("was_rejected", F.coalesce("was_rejected", F.lit(False)))


def upgrade_deferred(accepted: DataFrame, deferred: DataFrame) -> DataFrame:
    """Accepted neighbour pairs (a, b, confidence): those that are deferred hash pairs too become near_exact with the larger confidence."""
    d = deferred.select("a", "b", F.col("confidence").alias("hash_confidence"))
    joined = accepted.join(d, ["a", "b"], "left")
    both = F.col("hash_confidence").isNotNull()
    return joined.select("a", "b", F.greatest("confidence", F.coalesce("hash_confidence", "confidence")).alias("confidence"), F.when(both, "near_exact").otherwise("embedding_color_verified").alias("match_type"))
