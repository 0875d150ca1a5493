from __future__ import annotations

import random
import re

import numpy as np

from tessera.functions import mutations as m
from tessera.functions.images import dhash, header_size
from tessera.operators import catalogue, pairs
from tessera.plans import _seeds, _vectors
from tessera.sources import sinks

DATA = "/root/testdata/sf0.001"


def scan(rows, p_max, d_max):
    """The acceptance scan, one seed after the other."""
    kept, stems = [], set()
    for path, stem, p, d in sorted(rows):
        stem = re.sub(r"(?i)(_[0-9]+|_angle[0-9]+|_view[0-9]+|_original.*|\s*\([0-9]+\))$", "", stem).lower().strip()
        if stem not in stems and not any(bin((p ^ q) & (2**64 - 1)).count("1") <= p_max and bin((d ^ e) & (2**64 - 1)).count("1") <= d_max for _, q, e in kept):
            kept.append((path, p, d))
            stems.add(stem)
    return [k[0] for k in kept]


def test_seeds_as_a_scan_accepts_them(spark):
    rows = [tuple(r) for r in _seeds(spark, DATA).select("path", "stem", "p", "d").collect()]
    want = scan(rows, 18, 22)
    assert len(want) < len({r[1].rsplit("_", 1)[0] for r in rows}) + 1
    assert sorted(r.path for r in catalogue.distinct_seeds(_seeds(spark, DATA), 18, 22).collect()) == want
    assert [r.path for r in catalogue.distinct_seeds(_seeds(spark, DATA), 18, 22, n=3).collect()] == want[:3]


def test_chain_and_copies_of_seeds(spark):
    # a - b - c - d differ by one bit from one to the next; copies of b; a null signature; a null stem, two bits from a
    rows = [("a", "s1", 0, 0), ("b", "s2", 1, 0), ("b2", "s3", 1, 0), ("c", "s4", 3, 0), ("d", "s5", 7, 0), ("e", "s6", None, None), ("f", None, 5 << 40, 0)]
    got = catalogue.distinct_seeds(spark.createDataFrame(rows, "path string, stem string, p long, d long"), 1, 0)
    assert sorted(r.path for r in got.collect()) == ["a", "c", "e", "f"]
    assert catalogue.distinct_seeds(got.selectExpr("path", "path stem", "1L p", "1L d").limit(0)).count() == 0


def test_seeds_in_rounds_and_in_one_task(spark, monkeypatch):
    """A chain of 60 seeds, each close to the next only: one task scans it without a round; in rounds, and rounds first, the result is the same."""
    rng = random.Random(3)
    rows = [(f"{i:03d}", f"chain{chr(97 + i % 26)}{i // 26}", (1 << (i % 63)) - 1, 5) for i in range(60)]
    rows += [(f"9{i:02d}", f"s{rng.randrange(30)}x", rng.getrandbits(8), 1 << 50) for i in range(40)]
    want = scan(rows, 1, 0)
    assert len(want) < 60 and want[:3] == ["000", "002", "004"]
    df = spark.createDataFrame(rows, "path string, stem string, p long, d long").repartition(3)
    made = []
    monkeypatch.setattr(catalogue, "materialize", lambda df, name="table", f=catalogue.materialize: made.append(name) or f(df, name))
    assert sorted(r.path for r in catalogue.distinct_seeds(df, 1, 0).collect()) == want
    assert made == ["seeds", "close", "open"]
    assert sorted(r.path for r in catalogue.distinct_seeds(df.where("path >= '9'"), 1, 0, scanned=(0, 0)).collect()) == scan(rows[60:], 1, 0)
    made.clear()
    assert sorted(r.path for r in catalogue.distinct_seeds(df, 1, 0, scanned=(80, 1 << 20)).collect()) == want
    assert 1 <= made.count("won") < 10


def test_classes_and_positions_of_an_empty_table(spark):
    none = spark.createDataFrame([], "name string, category string, width int, height int")
    assert catalogue.capped_classes(none, "name", [("x", ["a"], ["b"])], 2, "rest").count() == 0
    assert catalogue.positions(none, ["name"]).count() == 0
    assert catalogue.without_sizes(none, [(1, 1)], ["sofa"]).count() == 0
    assert catalogue.smallest_class(none, "category", ["p", "q"]) == "p"


def test_smallest_class_and_seeded_order(spark):
    rows = spark.createDataFrame([(i, "p" if i % 3 else "q") for i in range(30)], "id int, category string")
    assert catalogue.smallest_class(rows, "category", ["p", "q"]) == "q"
    first = [r.id for r in catalogue.seeded_order(rows, "id", 1).collect()]
    assert first == [r.id for r in catalogue.seeded_order(rows.repartition(3), "id", 1).collect()] and first != sorted(first)


def test_saved_index(spark, tmp_path):
    v = _vectors(spark, DATA)
    folder = f"file://{tmp_path}/index"
    pairs.save_index(v, folder, nlist=8)
    assert spark.read.parquet(f"{folder}/rows").count() == v.count()
    query = list(v.where("id = 3").first()["embedding"])
    exact = [(r.id, round(r.similarity, 9)) for r in pairs.knn_single(v, query, 5, -1.0).collect()]
    assert [(r.id, round(r.similarity, 9)) for r in pairs.query_index(spark, folder, query, 5, -1.0, nprobe=8).collect()] == exact
    assert pairs.query_index(spark, folder, query, 1, -1.0, nprobe=1).first().id == 3


def test_mutations():
    x = np.random.default_rng(3).integers(0, 256, (60, 80, 3), dtype=np.uint8)
    smooth = np.repeat(np.repeat(x[:6, :8], 10, axis=0), 10, axis=1)
    assert header_size(m.encode_png(x)) == (80, 60)
    assert m.crop(x, 0.1).shape == (48, 64, 3) and m.crop(x[:9], 0.1).shape == (9, 80, 3)
    assert m.scale(x, 0.5).shape == (32, 40, 3)
    assert np.array_equal(m.brightness(x, 1.0), x) and m.brightness(x, 9.0).max() == 255
    assert np.array_equal(m.contrast(x, 1.0), x) and m.contrast(x, 0.0).std() == 0
    assert m.shift_channels(x, (0, 0, 0), (1, 2, 3))[5, 5].tolist() == [1, 2, 3]
    assert bin((dhash(smooth) ^ dhash(m.brightness(smooth, 0.9))) & (2**64 - 1)).count("1") <= 6
    assert not np.array_equal(m.watermark(x), x) and np.array_equal(m.watermark(x)[:30], x[:30])


def test_scorecard(spark, tmp_path):
    path = sinks.write_scorecard(spark.createDataFrame([(40, 99.5, "a|b", None)], "target_scale int, precision double, domain string, note string"), str(tmp_path / "x/card.md"))
    assert open(path).read() == "| target_scale | precision | domain | note |\n| --- | --- | --- | --- |\n| 40 | 99.50 | a\\|b |  |\n"
