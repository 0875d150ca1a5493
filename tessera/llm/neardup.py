"""Near duplicates by MinHash banding, signature verification and alternating large-star / small-star components."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.wordhash import mix, space_words, text_buffer, words
from tessera.operators.graph import connected_components
from tessera.operators.ordering import positions
from tessera.operators.skew import hot_join, weighed
from tessera.runtime import discard, materialize, python_workers, slices

_U = np.uint64
#: A bucket of more rows than this is worked on as pairs of blocks of this size.
BLOCK = 1024


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words than width, the whole sequence is one shingle."""
    data, offsets = text_buffer(column)
    _, _, hashes, first = words(data, offsets, space_words())
    rolled = hashes
    for k in range(1, width):
        rolled = mix(rolled[:-1] * _U(0x9FB21C651E98DF25) + hashes[k:])
    for i in range(len(column)):
        a, z = first[i], first[i + 1]
        if z - a >= width:
            yield np.unique(rolled[a : z - width + 1])
        elif z > a:
            one = hashes[a : a + 1]
            for h in hashes[a + 1 : z]:
                one = mix(one * _U(0x9FB21C651E98DF25) + h)
            yield mix(one + _U(z - a))
        else:
            yield hashes[:0]


def _binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def _keys(x: np.ndarray, seed: int) -> tuple[int, int]:
    """Two 64-bit sums over a set that tell sets apart."""
    return (int(np.bitwise_xor.reduce(mix(x + _U(seed)))) if len(x) else 0, int(x.sum(dtype=_U)) if len(x) else 0)


def _features(width: int, bands: int, rows: int, seed: int):
    k = bands * rows

    def run(batches):
        factors = np.random.default_rng(seed).integers(0, 1 << 63, k, dtype=_U) * _U(2) + _U(1)
        for batch in slices(batches):
            sizes, keys, sigs, tables = [], [], [], []
            for x in shingle_sets(batch.column("text"), width):
                sizes.append(len(x))
                low = np.full(k, ~_U(0))
                for j in range(0, len(x), 1024):
                    np.minimum(low, (factors[:, None] * x[None, j : j + 1024]).min(axis=1), out=low)
                keys.append(_keys(x, seed))
                low = mix(low)
                band = low.reshape(bands, rows)
                key = np.arange(bands, dtype=_U)
                for r in range(rows):
                    key = mix(key * _U(0x9FB21C651E98DF25) + band[:, r])
                sigs.append(low.astype(np.uint8).tobytes())
                tables.append(key.view(np.int64))
            both = np.array(keys, dtype=_U).reshape(-1, 2).view(np.int64)
            flat = np.concatenate(tables) if tables else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]),
                 pa.ListArray.from_arrays(np.arange(len(tables) + 1, dtype=np.int32) * bands, flat), _binary(sigs)],
                ["doc_id", "text_key", "n_shingles", "k1", "k2", "bands", "sig"],
            )

    return run


def _sets(width: int, seed: int):
    """The set of each row's node; of rows of one node that follow each other, as they do after a merge join, the first."""

    def run(batches):
        last = None
        for batch in slices(batches):
            nodes, items = [], []
            wanted = zip(batch.column("node").to_pylist(), batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True)
            for x, (node, k1, k2) in zip(shingle_sets(batch.column("text"), width), wanted, strict=True):
                # rows that share a doc_id can have texts of other classes
                if node != last and tuple(np.array(_keys(x, seed), _U).view(np.int64)) == (k1, k2):
                    nodes.append(node)
                    items.append(x.tobytes())
                    last = node
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), _binary(items)], ["node", "items"])

    return run


def _enough(common: int, n: int, m: int, percent: int) -> bool:
    return 100 * common >= percent * (n + m - common)


def _verified(percent: int):
    def run(batches):
        for batch in slices(batches):
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                good.append(_enough(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q), percent))
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("node"), kept.column("centre")], ["a", "b"])

    return run


def _likely(floor: float):
    """Pairs whose signatures agree in at least this share of the minima."""

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), -1) for c in ("x", "y"))
            good = (x == y).mean(axis=1) >= floor if len(batch) else np.zeros(0, bool)
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("node"), kept.column("centre")], ["node", "centre"])

    return run


def bucket_links(rows: pa.Table, floor: float, percent: int) -> list[tuple[int, int]]:
    """Links between different components of one bucket, or of two blocks of one, found by whole sets: (component, component).

    Only pairs whose components no confirmed link has joined yet are compared; a pair
    that shares an earlier band belongs to that band's bucket.
    """
    if len(rows) < 2:
        return []
    comp, block = (rows.column(c).to_pylist() for c in ("comp", "block"))
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(len(rows), -1)
    band = np.array(rows.column("bands").to_pylist(), np.int64)
    sets = [np.frombuffer(x.as_buffer(), _U) for x in rows.column("items")]
    size = np.array([len(s) for s in sets])
    here, two = rows.column("band")[0].as_py(), rows.column("p")[0].as_py() != rows.column("q")[0].as_py()
    block = np.array(block)
    roots: dict[int, int] = {}

    def root(c: int) -> int:
        while c in roots:
            c = roots[c]
        return c

    out = []
    label = np.array(comp)
    for i in range(len(rows) - 1):
        j = np.arange(i + 1, len(rows))
        ok = label[j] != label[i]
        if two:
            ok &= block[j] != block[i]
        ok &= 100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i])
        j = j[ok]
        j = j[(sig[j] == sig[i]).mean(axis=1) >= floor]
        if here and len(j):
            j = j[~(band[j, :here] == band[i, :here]).any(axis=1)]
        for k in j:
            a, b = root(comp[i]), root(comp[k])
            if a != b and _enough(len(np.intersect1d(sets[i], sets[k], assume_unique=True)), size[i], size[k], percent):
                out.append((comp[i], comp[k]))
                roots[max(a, b)] = min(a, b)
    return out


def _bucket_links(floor: float, percent: int):
    """bucket_links of each run of equal (h, p, q); rows come sorted by them."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        key = None

        def flush():
            out = bucket_links(pa.Table.from_batches(held), floor, percent) if held else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("h", "p", "q")])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
            for lo, hi in itertools.pairwise(edges):
                if key != (now := tuple(keys[:, lo].tolist())):
                    yield flush()
                    held, key = [], now
                held.append(batch.slice(lo, hi - lo))
        yield flush()

    return run


def minhash_classes(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, seed: int = 17) -> DataFrame:
    """minhash_components with two columns more: text_key, the text's xxhash64, and component, a number of the component (null where nothing can be linked)."""
    spark = docs.sparkSession
    python_workers(spark)
    share = percent / 100
    floor = share - 8 * (share * (1 - share) / (bands * rows)) ** 0.5
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    schema = "doc_id long, text_key long, n_shingles long, k1 long, k2 long, bands array<bigint>, sig binary"
    features = materialize(base.mapInArrow(_features(width, bands, rows, seed), schema), "minhash")
    named = features.where("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    # numbered in the order of the smallest doc_id, so the smallest number of a component has its smallest doc_id
    nodes = positions(classes, ["class_id", "k1", "k2"]).withColumnRenamed("position", "node")
    each = nodes.select("node", F.posexplode("bands").alias("band", "h"))
    shared, known = weighed(each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "n", "shared")
    members = materialize(hot_join(each, shared.withColumn("w", F.col("n")), ["h"], "w", known=known), "buckets")
    score = members.groupBy("node").agg(F.sum(F.col("n") - 1).alias("score"))
    scored = members.join(score.hint("merge"), "node")
    centres = scored.groupBy("h").agg(F.max(F.struct("score", (-F.col("node")).alias("m"))).alias("c"), F.count("*").alias("n"))
    centres, known = weighed(centres.select("h", (-F.col("c.m")).alias("centre"), "n"), "n", "centres")
    star = materialize(hot_join(members.select("h", "node"), centres, ["h"], "n", known=known).where("node <> centre").select("node", "centre").distinct(), "star")

    needed = nodes.select(F.col("class_id").alias("doc_id"), "node", "k1", "k2").join(members.select("node").distinct().hint("merge"), "node", "left_semi")
    sets = base.where("doc_id is not null").select("doc_id", "text").join(needed.hint("merge"), "doc_id").select("node", "k1", "k2", "text")
    sets = materialize(sets.mapInArrow(_sets(width, seed), "node long, items binary"), "sets")

    def with_both(pairs: DataFrame, what: DataFrame, column: str) -> DataFrame:
        """pairs (node, centre) with x and y, the column of either; a centre of many nodes is dealt out."""
        x = pairs.join(what.select("node", F.col(column).alias("x")).hint("merge"), "node")
        y = pairs.groupBy("centre").agg(F.count("*").alias("w")).join(what.select(F.col("node").alias("centre"), F.col(column).alias("y")).hint("merge"), "centre")
        y, known = weighed(y, "w", "centre")
        temporary.append(y)
        return hot_join(x, y, ["centre"], "w", known=known)

    temporary = [shared, members, centres, star, sets]
    marks = nodes.select("node", F.struct("sig", "n_shingles").alias("s"))
    likely = with_both(star, marks, "s").where(100 * F.least("x.n_shingles", "y.n_shingles") >= percent * F.greatest("x.n_shingles", "y.n_shingles"))
    likely = materialize(likely.select("node", "centre", F.col("x.sig").alias("x"), F.col("y.sig").alias("y")).mapInArrow(_likely(floor), "node long, centre long"), "likely")
    edges = materialize(with_both(likely, sets, "items").mapInArrow(_verified(percent), "a long, b long"), "edges")
    first = materialize(connected_components(edges), "first")

    labelled = materialize(members.join(first.hint("merge"), "node", "left").select("h", "band", "node", F.coalesce("component", "node").alias("comp")), "labelled")
    open_ = labelled.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("h", "n", F.col("n").alias("w"))
    open_, known = weighed(open_, "w", "open")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    work = hot_join(labelled, open_, ["h"], "w", known=known).withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    work = work.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    work = work.select("h", "band", "node", "comp", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    work = work.join(nodes.select("node", "bands", "sig").hint("merge"), "node").join(sets.hint("merge"), "node")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    work = work.repartition(parts, "h", "p", "q").sortWithinPartitions("h", "p", "q", "node")
    found = work.select("h", "p", "q", "band", "node", "comp", "block", "bands", "sig", "items").mapInArrow(_bucket_links(floor, percent), "a long, b long")
    found = materialize(found, "found")
    # links of open buckets join whole components
    joined = connected_components(found).select(F.col("node").alias("part"), F.col("component").alias("whole"))
    final = first.select("node", F.col("component").alias("part")).unionByName(joined.join(first, F.col("part") == F.col("node"), "left_anti").select(F.col("part").alias("node"), "part"))
    final = final.join(joined.hint("merge"), "part", "left").select("node", F.coalesce("whole", "part").alias("component"))
    final = materialize(final, "components")

    names = nodes.select(F.col("node").alias("component"), F.col("class_id").alias("component_id"))
    rep = nodes.select("k1", "k2", "n_shingles", "class_id", "copies", "node").join(final.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node")
    rep, known = weighed(rep.join(names.hint("merge"), "component"), "copies", "classes")
    discard(*temporary, likely, edges, first, labelled, open_, found, final)
    out = hot_join(features.select("doc_id", "text_key", "n_shingles", "k1", "k2"), rep, ["k1", "k2", "n_shingles"], "copies", "left", known)
    named = F.col("doc_id").isNotNull()
    component = F.when(named, F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.when(named, F.coalesce("class_id", "doc_id")).alias("class_id"),
        "text_key", F.when(named, F.col("component")).alias("component"),
    )


def minhash_components(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, seed: int = 17) -> DataFrame:
    """Near-duplicate classes of docs (doc_id, text): doc_id, n_shingles, component_id, kept, class_id (smallest id with an equal set).

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set holds
    the distinct shingles of `width` words.  Two documents link if
    100 * |A and B| >= percent * |A or B|, confirmed on the whole sets of 64-bit
    shingle hashes.

    1. Equal sets collapse to one class, so copies cost one aggregation.
    2. Each class has bands * rows universal hash minima; the chance that a pair at
       0.8 shares no band of 4 out of 32 is 4.8e-8.
    3. In every band bucket all members are compared with one centre only (the
       member that shares most buckets); components of these links collapse most
       of a bucket.
    4. Buckets with several components left are dealt out by bucket, in pairs of
       blocks of BLOCK rows if large, and pairs of different components are
       compared by size, signature, then whole sets inside the task: no pair is
       written that isn't a link, and only confirmed links join components there.

    Signatures only spare work: pairs that agree in fewer minima than 8 standard
    deviations under what similarity `percent` gives (66.2 of 128 at 80) aren't
    compared; a link at 80 has a chance of 6e-13 to be one of them (binomial tail).

    Nulls: a row with a null doc_id links with nothing: component_id and class_id
    are null and it is kept.  Null, empty or blank text: n_shingles 0, a component
    of its own.  Rows that repeat a doc_id are judged by their own texts.  An empty
    table gives an empty result.
    """
    return minhash_classes(docs, width, percent, bands, rows, seed).drop("text_key", "component")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each near-duplicate component of docs (doc_id, text, ...), all columns kept: that with the smallest doc_id.

    Of rows that repeat a doc_id and its text one stays, the same in every run (the
    smallest hash of the row); a doc_id with several texts is judged text by text, so
    each that no kept row resembles stays.  Rows without a doc_id, which nothing
    tells apart, all stay.
    """
    rows = minhash_classes(docs, width, percent).where("kept and doc_id is not null")
    alone = F.when(F.col("component").isNull(), F.col("text_key"))
    kept = rows.groupBy("doc_id", "component", "text_key").agg(F.count("*").alias("n")).groupBy("doc_id", "component", alone.alias("alone"))
    kept = kept.agg(F.min(F.struct("text_key", "n")).alias("k")).select(F.col("doc_id").alias("d"), F.col("k.text_key").alias("t"), F.col("k.n").alias("n"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    held = held.select("row", F.col("row.doc_id").cast("long").alias("d"), F.xxhash64(F.col("row.text").cast("string")).alias("t"))
    joined = held.join(materialize(kept, "kept"), ["d", "t"])
    again = joined.where("n > 1").groupBy("d", "t").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    parts = (joined.where("n = 1"), again, held.where("d is null"))
    out = parts[0].select("row.*")
    for part in parts[1:]:
        out = out.unionByName(part.select("row.*"))
    return out
