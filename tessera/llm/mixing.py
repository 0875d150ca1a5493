"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
import itertools
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.runtime import materialize

#: Sources that the driver apportions at most; their totals are the only rows that it reads.
MAX_SOURCES = 100_000


def targets(sizes: list[int], weights: list[int], cap: int = 3) -> list[Fraction]:
    """Shares of the total of sizes by weight; what would exceed cap times a source's size goes to the others by weight, until none is above."""
    total = sum(sizes)
    capped: set[int] = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(cap * sizes[i] for i in capped)
        whole = sum(weights[i] for i in free)
        share = {i: Fraction(left * weights[i], whole) for i in free}
        above = {i for i in free if share[i] > cap * sizes[i]}
        if not above:
            return [Fraction(cap * sizes[i]) if i in capped else share[i] for i in range(len(sizes))]
        capped |= above


def sainte_lague(votes: list[Fraction], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by highest quotients v / (2 s + 1), none above `most`; ties go to the earlier entry.

    Each entry starts with one seat less than its rounded quota and the rest are
    dealt by quotient, so the work grows with the entries and not with the seats.
    What an entry can't take goes to the others, again by quotient; seats that none
    can take are left.
    """
    whole = sum(votes)
    if not whole or seats <= 0:
        return [0] * len(votes)
    room = most if most is not None else [seats] * len(votes)
    full: dict[int, int] = {}
    while True:  # entries whose quota is above their room take all of it, and the others share what is left
        free = [i for i, v in enumerate(votes) if i not in full and v > 0]
        left, whole = seats - sum(full.values()), sum(votes[i] for i in free)
        above = [i for i in free if votes[i] * left >= (room[i] + 1) * whole]
        if not above:
            break
        full |= {i: room[i] for i in above}
    # the divisor whole / left rounds each quota; it is off by at most one seat for each entry
    won = [full.get(i, 0) for i in range(len(votes))]
    for i in free:
        won[i] = min(room[i], max(0, int(votes[i] * left / whole + Fraction(1, 2)) - 1))
    while sum(won) > seats:
        worst = min((i for i in free if won[i]), key=lambda i: (votes[i] / (2 * won[i] - 1), -i))
        won[worst] -= 1
    queue = [(-votes[i] / (2 * won[i] + 1), i) for i in free if won[i] < room[i]]
    heapq.heapify(queue)
    while queue and sum(won) < seats:
        for _ in range(seats - sum(won)):
            if queue:
                _, i = heapq.heappop(queue)
                won[i] += 1
                if won[i] < room[i]:
                    heapq.heappush(queue, (-votes[i] / (2 * won[i] + 1), i))
    return won


def shard_quotas(quotas: list[int], shards: int) -> list[list[int]]:
    """Each source's blocks by shard: Sainte-Lague with equal votes, ties from where the source before stopped, so all shards' totals differ by one at most."""
    out, turn = [], 0
    for q in quotas:
        even = sainte_lague([Fraction(1)] * shards, q) if q else [0] * shards
        out.append([even[(t - turn) % shards] for t in range(shards)])
        turn = (turn + q) % shards
    return out


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, shards: int = 16, seed: int = 29, block: int = 1024, rows_in_bucket: int = 2_000) -> DataFrame:
    """How many words a mix takes of each row of docs (doc_id, text, source): doc_id, size, source_size, target, taken, source, shard_words.

    Size is the number of words (runs of anything but ASCII white space; null text:
    0).  Sources, sorted by code point with null last, weigh `weights`, repeating;
    their targets share the total of sizes by weight, none above cap times its size.

    Each source's documents, in seeded hash order, form a stream of words cut into
    equal blocks (at most `block` words, fewer if sources are small).  All blocks of
    the mix go to sources by highest quotients (Sainte-Lague, none above cap times
    its blocks; what it can't give goes to others), and each source's blocks to
    shards in the same way: integer quotas for each source and shard.  A source with
    q blocks to give and m in its stream gives every block q // m times and q % m
    blocks, spread evenly over the seeded order, once more; these q copies, whole
    rounds first, fill the shards' quotas in order.  Where a block's copies go has a
    closed form, so no row is made for a block: a document is at most cap + 1
    intervals of the sequence of copies, and a shard is one.  shard_words lists the
    shards and how many of the document's words each takes.

    Prefix sums run within (source, hash bucket) windows of about rows_in_bucket
    rows, then over one row for each bucket, so a source with a third of all rows is
    dealt out like the others.  Reruns agree: the order depends on doc_id, size and
    the text's hash alone.  Empty texts take 0; an empty table gives an empty
    result; repeated rows are separate rows.
    """
    text = F.col("text").cast("string")
    source = F.col("source").cast("string")
    order = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.xxhash64(text))
    rows = docs.select(F.col("doc_id"), source.alias("source"), F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long").alias("size"), order.alias("key"))
    rows = materialize(rows, "mix")
    totals = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    if totals.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them first")
    found = sorted(totals.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    names, sizes = [r["source"] for r in found], [int(r["size"]) for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], cap) if names else []
    total = sum(sizes)
    block = max(1, min(block, total // (4096 * max(1, len(names)))))
    there = [-(-size // block) for size in sizes]
    quota = sainte_lague(goal, -(-total // block), [cap * n for n in there])
    plan = []
    for name, size, want, q, n, r, parts in zip(names, sizes, goal, quota, there, found, shard_quotas(quota, shards), strict=True):
        full, more = divmod(q, n) if n else (0, 0)
        ends = list(itertools.accumulate(parts))
        plan.append((name, size, float(want), full, more, n, max(1, -(-r["n"] // rows_in_bucket)), [0, *ends]))
    spark = docs.sparkSession
    schema = "source string, source_size long, target double, full long, more long, there long, buckets long, borders array<long>"
    quotas = F.broadcast(spark.createDataFrame(plan, schema))  # at most MAX_SOURCES rows
    rows = rows.join(quotas.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    rows = rows.withColumn("bucket", F.floor((F.shiftrightunsigned("key", 1) / F.lit(float(1 << 63))) * F.col("buckets")))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    whole = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("held").over(whole), F.lit(0)).alias("start"))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")), "left")

    def extra(x):
        """Words of the blocks taken once more among the first x words of the stream: block j is one if floor((j + 1) more / there) > floor(j more / there)."""
        j = F.floor(x / F.lit(block))
        up = lambda k: F.floor(k.cast("decimal(38,0)") * F.col("more") / F.greatest(F.col("there"), F.lit(1))).cast("long")
        return up(j) * block + (x - j * block) * (up(j + 1) - up(j))

    rows = rows.withColumn("begin", F.col("start") + F.col("before"))
    rows = rows.withColumn("x0", extra(F.col("begin"))).withColumn("x1", extra(F.col("begin") + F.col("size")))
    taken = (F.col("full") * F.col("size") + F.col("x1") - F.col("x0")).cast("long")
    # copy c of the stream begins at block c * there of the sequence, and the extra blocks come last
    one_round = F.col("there") * block
    rounds = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(cap).cast("long")), lambda c: F.when(c < F.col("full"), F.struct((c * one_round + F.col("begin")).alias("a"), (c * one_round + F.col("begin") + F.col("size")).alias("b"))))
    last = F.struct((F.col("full") * one_round + F.col("x0")).alias("a"), (F.col("full") * one_round + F.col("x1")).alias("b"))
    rows = rows.withColumn("copies", F.array_append(F.filter(rounds, lambda s: s.isNotNull()), last))

    def held(t):
        lo, hi = F.get("borders", t) * block, F.get("borders", t + 1) * block
        return F.aggregate("copies", F.lit(0).cast("long"), lambda n, s: n + F.greatest(F.lit(0).cast("long"), F.least(s["b"], hi) - F.greatest(s["a"], lo)))

    by_shard = F.filter(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda t: F.struct(t.alias("shard"), held(t).alias("words"))), lambda s: s["words"] > 0)
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", by_shard.alias("shard_words"))


def mix_documents(docs: DataFrame, seed: int = 41) -> DataFrame:
    """The rows of docs (doc_id, text, source, ...), each as often as the mix takes its words: whole copies, and one more by a seeded draw with the odds of the part that is left; all columns as they are.

    Texts without words have nothing that the mix could take and stay once.  Repeated
    rows share what the mix takes of them.  An empty table gives an empty result.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # nulls leave a field out of the JSON, so no two rows that differ in these columns share a key
    text = F.col("row.text").cast("string")
    names = [F.col(f"row.{c}") for c in ("doc_id", "source", "lang") if c in docs.columns]
    held = held.withColumn("key", F.xxhash64(F.to_json(F.struct(*names)), F.xxhash64(text), F.length(text), F.hash(text)))
    taken = mix_sources(held.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"), F.col("row.source").alias("source")))
    taken = taken.groupBy(F.col("doc_id").alias("key")).agg(F.first("size").alias("size"), F.sum("taken").alias("taken"), F.count("*").alias("same"))
    share = F.col("taken") / (F.col("size") * F.col("same"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 30)) / F.lit(1 << 30)
    copies = F.when(F.col("size") > 0, F.floor(share) + (draw < share - F.floor(share)).cast("long")).otherwise(1).cast("int")
    joined = held.join(taken, "key").withColumn("copies", copies).where("copies > 0")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
