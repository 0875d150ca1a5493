"""Registered queries against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import math
import os
import random
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import plans
from tessera.functions import columns as c
from tessera.operators import pairs

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(float(v), 4) if isinstance(v, float) else int(v) if isinstance(v, int) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = df.select(*[f"`{c}`" for c in names]).collect()
    if name in plans.ORACLES:
        found = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in names)} FROM ({plans.ORACLES[name]})").fetchall()
        assert plain(got) == plain(found)


def test_ivf_recall(spark):
    exact = {(r.a, r.b) for r in plans.QUERIES["cosine_candidates"](spark, DATA).collect()}
    found = {(r.a, r.b) for r in plans.QUERIES["ivf_candidates"](spark, DATA).collect()}
    assert found <= exact and len(found) >= 0.9 * len(exact)


def clustered(spark, n=3_000, ids="long"):
    """Vectors around 40 directions, as those of pictures lie, with some equal ones and nulls."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 24))[rng.integers(0, 40, n)] + 0.4 * rng.normal(size=(n, 24))
    x[10:13] = x[9]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i if ids == "long" else f"v{i:05d}", [float(v) for v in r]) for i, r in enumerate(x)] + [(n if ids == "long" else "w", None), (None, [0.0] * 24)]
    return x, spark.createDataFrame(rows, f"id {ids}, embedding array<double>").repartition(5)


@pytest.mark.parametrize("ids", ["long", "string"])
def test_cosine_in_many_blocks(spark, ids):
    x, df = clustered(spark, 700, ids)
    got = defaultdict(list)
    for r in pairs.cosine_topk(df, 6, block=90).collect():
        got[int(str(r.i).lstrip("v"))].append((-r.similarity, int(str(r.j).lstrip("v"))))
    sims = np.round(x @ x.T, 9)
    for i in range(700):
        want = sorted((-s, j) for j, s in enumerate(sims[i].tolist()))[:6]
        assert [j for _, j in sorted((round(s, 9), j) for s, j in got[i])] == [j for _, j in want]
    assert pairs.cosine_topk(df.limit(0), 3).count() == 0


def test_best_of_ranks_ties_and_what_short_floats_blur():
    """Against a full sort, over targets in three blocks: copies, similarities that differ in the tenth digit, and long vectors."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 16))
    x[100:140] = x[50]
    x[200:260] = x[60] + 1e-10 * rng.normal(size=(60, 16))
    for scale in (1.0, 1e-9, 1e16):
        y = x * scale
        held, ids = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)), rng.permutation(600)
        for at in range(0, 600, 200):
            held = pairs.best_of(y[40:110], y[at : at + 200], ids[at : at + 200], held, 7)
        sims = np.round((y[40:110, None, :] * y[None, :, :]).sum(axis=2), 12)
        want = [(i, s, n) for i in range(70) for s, n in sorted(zip(sims[i].tolist(), ids.tolist(), strict=True), key=lambda t: (-t[0], t[1]))[:7]]
        assert list(zip(*map(np.ndarray.tolist, held), strict=True)) == want


def test_cosine_of_floats_travels_as_floats(spark):
    _, df = clustered(spark, 200)
    short = df.withColumn("embedding", df.embedding.cast("array<float>")).where("id is not null and embedding is not null").selectExpr("id", "embedding", "1 block")
    row = pairs._pack(short, ["block"]).first()
    assert len(row.vectors) == 200 * 24 * 4


def test_ivf_recall_at_default_settings(spark):
    """A tenth of the cells, each in several blocks, finds nine of ten neighbours of grouped vectors."""
    x, df = clustered(spark)
    want = {(i, j) for i, r in enumerate(np.argsort(-(x @ x.T), axis=1, kind="stable")[:, :10].tolist()) for j in r}
    found = {(r.i, r.j) for r in pairs.ivf_topk(df, 10, block=64).collect()}
    assert len(found & want) >= 0.9 * len(want)
    assert pairs.ivf_topk(df.limit(0), 3).count() == 0


def test_hamming_join_against_all_pairs(spark):
    rng = random.Random(9)
    rows = []
    for i in range(150):
        p, d = rng.getrandbits(64), rng.getrandbits(64)
        for k in range(3):
            rows.append((3 * i + k, p - (1 << 63), d - (1 << 63)))
            p, d = (v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for v in (p, d))
    rows += [(1000, rows[0][1], rows[0][2]), (1001, rows[0][1], rows[0][2]), (1002, None, 5)]
    df = spark.createDataFrame(rows, "id long, p long, d long")
    for p_max, d_max in ((8, 6), (3, 9), (0, 0), (1, 1)):
        assert sorted(map(tuple, pairs.hamming_join(df, p_max, d_max).collect())) == sorted(map(tuple, pairs.hamming_theta(df, p_max, d_max).collect()))


def test_hamming_join_at_loose_thresholds(spark):
    """Bands with a radius in one block and in several, and no bands at all: the pairs of all against all, and no candidates as rows."""
    rng = random.Random(4)
    rows = []
    for i in range(120):
        p, d = rng.getrandbits(64), rng.getrandbits(64)
        for k in range(4):
            rows.append((4 * i + k, p - (1 << 63), d - (1 << 63)))
            p, d = (v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(14))) for v in (p, d))
    rows += [(1000, *rows[0][1:]), (1001, *rows[0][1:]), (1002, None, 5), (1003, -1, -1), (1004, -1, -2)]
    df = spark.createDataFrame(rows, "id long, p long, d long").repartition(3)
    for p_max, d_max, block in ((18, 22, 1 << 17), (18, 22, 100), (22, 18, 100), (30, 40, 200)):
        found = pairs.hamming_join(df, p_max, d_max, block)
        assert "MapInArrow" in found._jdf.queryExecution().toString()
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, pairs.hamming_theta(df, p_max, d_max).collect()))
    assert pairs.hamming_join(df.limit(0), 18, 22).count() == 0


def test_bands_of_blocks_miss_no_pair():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 64, (2, 400), dtype=np.uint64)
    x[0, 200:] = x[0, :200] ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 20), replace=False)) for _ in range(200)], np.uint64)
    x[0, :30] &= np.uint64(7)  # one value in most bands
    apart = np.bitwise_count(x[0][:, None] ^ x[0][None, :]) <= 18
    ok = apart & (np.bitwise_count(x[1][:, None] ^ x[1][None, :]) <= 30)
    for bands, radius in (pairs._search_bands(1 << 17, 18), (pairs._edges(10), 1), ([(0, 0)], 0)):
        inside = [(i, j) for part in range(3) for a, b in pairs._close_in_blocks(x, None, bands, radius, (18, 30), part, 3) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(inside) == len(set(map(frozenset, inside))) and {f for i, j in inside for f in ((i, j), (j, i))} == set(zip(*map(np.ndarray.tolist, np.nonzero(ok)), strict=True))
        across = [(i, j) for a, b in pairs._close_in_blocks(x[:, :150], x[:, 150:], bands, radius, (18, 30), 0, 1) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        assert sorted(across) == sorted(zip(*map(np.ndarray.tolist, np.nonzero(ok[:150, 150:])), strict=True))
    assert pairs._search_bands(1 << 17, 18) == (pairs._edges(5), 3)


def test_hamming_join_of_unique_signatures_joins_nothing_back(spark):
    """Ids travel with the signatures, so pairs come out of the search as they are; texts as ids, and in several blocks too."""
    rng = random.Random(6)
    rows = [(f"v{i:03d}", rng.getrandbits(64) - (1 << 63), (1 << 40) - i) for i in range(200)]
    rows += [(f"w{i}", p ^ 7, d ^ 1) for i, (_, p, d) in enumerate(rows[:50])]
    df = spark.createDataFrame(rows, "id string, p long, d long")
    want = sorted(map(tuple, pairs.hamming_theta(df, 18, 22).collect()))
    assert len(want) >= 50
    one = pairs.hamming_join(df, 18, 22)
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # of blocks with blocks
    for found in (one, pairs.hamming_join(df, 18, 22, 90), pairs.hamming_join(df.unionByName(df.limit(0)), 18, 22)):
        assert sorted(map(tuple, found.collect())) == want


def test_hash_pairs_among_candidates(spark):
    """The close pairs that are candidates, copies and null signatures included."""
    rng = random.Random(7)
    rows = [(i, rng.getrandbits(20), rng.getrandbits(20)) for i in range(60)]
    rows += [(100 + i, p, d) for i, (_, p, d) in enumerate(rows[:10])] + [(200, None, 1), (201, 1, None)]
    df = spark.createDataFrame(rows, "id long, p long, d long")
    close = {(r.a, r.b): (r.p_dist, r.d_dist) for r in pairs.hamming_theta(df, 8, 10).collect()}
    ids = [r[0] for r in rows]
    asked = {(a, b) for a in ids for b in ids if a < b and (a + b) % 3 == 0} | {(0, 999)}
    want = sorted((*ab, *close[ab]) for ab in asked & set(close))
    found = pairs.hamming_among(spark.createDataFrame(sorted(asked), "a long, b long"), df, 8, 10)
    assert 20 < len(want) < len(close) and sorted(map(tuple, found.collect())) == want


def test_deferred_upgrade_searches_no_hash_pairs(spark, monkeypatch):
    """The neighbours' hash pairs are looked up; a search of all of them took most of the query's stages."""
    want = plans.QUERIES["deferred_upgrade"](spark, DATA).collect()
    near = pairs.cosine_candidates(plans._vectors(spark, DATA), 10, 0.35).select("a", "b", F.bround(100 * F.col("similarity"), 0).cast("int").alias("confidence"))
    every = pairs.hamming_join(plans._sigs(spark, DATA), 18, 22).select("a", "b", c.hash_confidence("p_dist", "d_dist").alias("confidence"))
    assert sorted(map(tuple, want)) == sorted(map(tuple, pairs.upgrade_deferred(near, every).collect()))
    monkeypatch.setattr(pairs, "hamming_join", None)
    assert plans.QUERIES["deferred_upgrade"](spark, DATA).count() == len(want)


def test_close_pairs_travel_in_large_batches():
    chunks = ([pa.array([i, i + 1]), pa.array([0, 1])] for i in range(100))
    got = list(pairs._in_batches(chunks, ["x", "y"], 64))
    assert [len(b) for b in got] == [64, 64, 64, 8] and got[0].column("x").to_pylist()[:4] == [0, 1, 1, 2]
    assert not list(pairs._in_batches(iter([]), ["x", "y"]))


def test_vector_signatures_as_the_scalar_expressions(spark):
    nan, rng = float("nan"), random.Random(8)
    odd = [None, [], [1.0], [nan, 1.0, nan, nan, -1.0], [None, 1.0, None, 2.0, 3.0], [0.0, -0.0, 1.0]]
    rows = [(i, [rng.gauss(0, 1) for _ in range(n)]) for i, n in enumerate([64] * 20 + [63, 65, 80, 2])] + [(100 + i, v) for i, v in enumerate(odd)]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"id long, embedding array<{kind}>").repartition(2)
        step = F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.get("embedding", i + 1) > F.get("embedding", i))
        want = df.select("id", c.sign_bits("embedding", 0), F.when(F.col("embedding").isNotNull(), c.pack_bits(step)))
        assert sorted(map(tuple, pairs.vector_signatures(df).collect())) == sorted(map(tuple, want.collect()))


def test_bench_times_registered_queries():
    import bench

    assert set(bench.HEADLINES) <= set(plans.QUERIES)
