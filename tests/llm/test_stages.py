"""The pipeline's stages, each on its own input, against what its operator says, and on awkward rows."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.decontaminate import benchmark_digest
from tessera.llm.mixing import mix_sources
from tessera.llm.neardup import minhash_components
from tessera.llm.quality_rules import quality_rules

D = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in each column, empty and long texts, a repeated row, one id with two texts, and columns with the names that stages use."""
    rng = random.Random(9)
    prose = lambda n: " ".join(f"word{rng.randrange(300)}" for _ in range(n))
    item = spark.read.parquet(f"{D}/benchmark.parquet").where("text is not null").orderBy("item_id").first()["text"]
    long = prose(8_000)
    texts = [None, "", " \n\t", "one", prose(60), prose(60), long, long, prose(40) + "\n" + item, item]
    names = ["size", "key", "taken", "kept", "component_id", "target", "label", "row", "hit", "parts", "copies", "copy", "d", "t", "n", "same", "lang_", "common", "chars", "c0", "__row", "__marks", "__n_words", "base_failed"]
    extra = [f"{c} of a user" for c in names]
    rows = [(i, t, ["en", None][i % 2], ["a", None, "b"][i % 3], None) for i, t in enumerate(texts)]
    rows += [rows[4], (5, prose(70), "en", "a", 3), (None, texts[4], "en", "a", 3), (None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names)
    return spark.createDataFrame([(*r, *extra) for r in rows], schema).repartition(3)


def texts(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_quality_keeps_what_the_rules_keep(spark, documents):
    kept = {r.doc_id for r in quality_rules(documents).where("kept").collect()}
    got = STAGE["quality_rules"](spark, documents, D)
    assert got.columns == documents.columns and texts(got) == texts(documents.where(F.col("doc_id").isin(*kept)))


def test_near_dedup_keeps_the_first_of_a_class(spark, documents):
    first = {r.component_id for r in minhash_components(documents).collect()}
    got = STAGE["near_dedup"](spark, documents, D)
    assert got.columns == documents.columns and texts(got) == texts(documents.where(F.col("doc_id").isin(*first)))
    # what is left holds no near pair
    assert minhash_components(got).where("not kept").count() == 0


def test_decontamination_drops_what_is_contaminated(spark, documents):
    bad = {r.doc_id for r in benchmark_digest(documents, spark.read.parquet(f"{D}/benchmark.parquet")).where("contaminated").collect()}
    got = STAGE["decontamination"](spark, documents, D)
    assert bad and got.columns == documents.columns and texts(got) == texts(documents.where(~F.col("doc_id").isin(*bad)))


def test_mixing_copies_documents_as_taken(spark, documents):
    got = STAGE["mixing"](spark, documents, D)
    assert got.columns == documents.columns
    copies = Counter(r.doc_id for r in got.select("doc_id").collect())
    # the operator on the stage's keys, document by document
    sizes = {r.doc_id: r["size"] for r in mix_sources(documents).collect()}
    assert all(copies[i] <= 3 and (n or copies[i] == 1) for i, n in sizes.items())
    assert texts(got) == texts(STAGE["mixing"](spark, documents.repartition(7), D))


def test_mixing_meets_targets(spark):
    """Even documents, many to a source, so that a draw for each adds little."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(50)), "abcd"[min(3, i % 7)]) for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    goal = {r.source: r.target for r in mix_sources(docs).collect()}
    words = Counter()
    for r in STAGE["mixing"](spark, docs, D).collect():
        words[r.source] += 50
    assert all(abs(words[s] - goal[s]) <= 0.04 * goal[s] + 500 for s in goal), (words, goal)


def test_mixing_keys_tell_nulls_apart(spark):
    rows = [(1, "a b c", None, "x"), (1, "a b c", "x", None)]
    got = STAGE["mixing"](spark, spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), D).collect()
    assert len(got) <= 6 and {(r.source, r.lang) for r in got} <= {(None, "x"), ("x", None)}


def test_near_dedup_keeps_each_text_of_an_id(spark):
    """Two texts of one id are two documents; a repeated row is one, the same in every run."""
    rng = random.Random(3)
    prose = [" ".join(f"w{rng.randrange(500)}" for _ in range(50)) for _ in range(3)]
    rows = [(5, prose[0], "a"), (5, prose[1], "b"), (7, prose[1], "c"), (7, prose[2], "d"), (5, prose[0], "e"), (5, prose[0].upper(), "f"), (9, "", "g"), (9, "", "h"), (None, prose[0], "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = STAGE["near_dedup"](spark, docs.repartition(4), D).collect()
    assert sorted((r.doc_id or -1, (r.text or "").lower()) for r in got) == sorted([(5, prose[0]), (5, prose[1]), (7, prose[2]), (9, ""), (-1, prose[0])])
    assert sorted(map(str, got)) == sorted(map(str, STAGE["near_dedup"](spark, docs.coalesce(1), D).collect()))


def test_sharding_fills_shards_evenly(spark, documents):
    got = STAGE["sharding"](spark, documents, D).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    sizes = [len(s) for s in slots.values()]
    assert len(got) == documents.count() and len(slots) == 16 and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("name", list(STAGE))
def test_awkward_rows(spark, awkward, name):
    got = STAGE[name](spark, awkward, D)
    have, seen = texts(awkward), texts(got) if "text" in got.columns else None
    if name == "sharding":
        assert got.count() == awkward.count()
    else:
        assert got.columns == awkward.columns and set(seen) <= set(have)
    if name == "quality_rules":
        assert all(t is not None and len(t.split()) >= 20 for _, t in seen)
    if name != "sharding":
        row = got.first()
        assert all(row[c] == f"{c} of a user" for c in awkward.columns[5:])
    if name == "near_dedup":
        assert {i for i, t in seen if i is not None and i < 4} == {0, 1, 2, 3} and not {7} & {i for i, _ in seen} and sum(n for (i, _), n in seen.items() if i is None) == 2
        assert sum(n for (i, _), n in seen.items() if i == 5) == 2
    if name == "decontamination":
        assert {0, 1, 2, 3, 4, 5, 6, 7} <= {i for i, _ in seen} and not {8, 9} & {i for i, _ in seen}
    assert STAGE[name](spark, awkward.limit(0), D).count() == 0
