"""Balanced label propagation: linked documents move to their neighbours' shards under row quotas."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.neardup import shingle_sets
from tessera.llm.wordhash import mix
from tessera.operators.skew import hot_join, weighed
from tessera.runtime import discard, materialize, python_workers, slices

#: Cells of moves that a round approves or refuses as a whole, for each pair of shards and level of gain.
CELLS = 32
#: Votes are counted in millionths, as whole numbers, so that reruns agree.
UNIT = 1_000_000


def _place(hubs: list[tuple[int, int, dict[int, int]]], quotas: list[int]) -> tuple[dict[int, int], dict[int, list[tuple[int, int]]], list[int]]:
    """(label of each hub that stays whole, (label, rows) pieces of the others, room left) for hubs (hub, rows, votes by label).

    The largest hub moves first, to the label that most of its rows have among those
    with room for all of it, or to the fullest of them if that cuts less in the end.
    A hub that fits nowhere takes as few shards as room allows.
    """

    def attempt(by_votes: bool):
        whole, cut, room = {}, {}, list(quotas)
        for hub, rows, votes in sorted(hubs, key=lambda h: (-h[1], h[0])):
            fits = [t for t in range(len(room)) if room[t] >= rows]
            if fits:
                whole[hub] = t = max(fits, key=lambda t: (votes.get(t, 0), zlib.crc32(f"{hub} {t}".encode()))) if by_votes else min(fits, key=lambda t: (room[t], -votes.get(t, 0), t))
                room[t] -= rows
                continue
            cut[hub] = []
            while rows:
                t = min((t for t in range(len(room)) if room[t] >= rows), key=lambda t: (room[t], t), default=max(range(len(room)), key=lambda t: (room[t], -t)))
                take = min(rows, room[t])
                cut[hub].append((t, take))
                room[t] -= take
                rows -= take
        return whole, cut, room

    return min((attempt(True), attempt(False)), key=lambda x: sum(len(p) - 1 for p in x[1].values()))


def _hubs(width: int, minima: int):
    """For each text the smallest hashes of its shingles: texts that share much share some of them."""

    def run(batches):
        for batch in slices(batches):
            flat, ends = [], [0]
            for x in shingle_sets(batch.column("text"), width):
                flat.append(np.sort(mix(x))[:minima].view(np.int64))
                ends.append(ends[-1] + len(flat[-1]))
            hubs = pa.ListArray.from_arrays(np.array(ends, np.int32), np.concatenate(flat) if flat else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "size", "text_crc32", "group_id", "doc")], hubs], ["doc_id", "size", "text_crc32", "group_id", "doc", "hubs"])

    return run


def approve(asked: dict[tuple[int, int, int, int], int], loads: list[int], rooms: list[int]) -> set[tuple[int, int, int, int]]:
    """The cells (from, to, level, cell) of moves, with their rows, after which no label holds more than its room, or than it holds now.

    All are taken at first; while a label is over its room, cells into it go, those
    of the least gain first.  What leaves a label makes room there, so two labels can
    swap even if both are full.
    """
    limit = [max(r, x) for r, x in zip(rooms, loads, strict=True)]
    after, into = list(loads), defaultdict(list)
    for key in sorted(asked, key=lambda k: (-k[2], k[3], k[0])):  # the least wanted last
        after[key[0]] -= asked[key]
        after[key[1]] += asked[key]
        into[key[1]].append(key)
    while over := [t for t in range(len(rooms)) if after[t] > limit[t]]:
        for t in over:
            while after[t] > limit[t]:
                key = into[t].pop()
                after[t] -= asked[key]
                after[key[0]] += asked[key]
    good = {k for keys in into.values() for k in keys}
    left = [k for k in sorted(asked, key=lambda k: (-k[2], k[3], k[0])) if k not in good]
    while fits := [k for k in left if after[k[1]] + asked[k] <= limit[k[1]]]:
        for k in fits:  # what a large cell left room for, or what leaves made room
            if after[k[1]] + asked[k] <= limit[k[1]]:
                after[k[0]] -= asked[k]
                after[k[1]] += asked[k]
                good.add(k)
        left = [k for k in left if k not in good]
    return good


def _tally(state: DataFrame, shards: int) -> tuple[DataFrame, tuple[int, int]]:
    """For each hub: rows by label (w), all its rows, nodes (c)."""
    by_label = ", ".join(f"coalesce(sum(n) FILTER (WHERE label = {t}), 0)" for t in range(shards))
    return weighed(state.groupBy("hub").agg(F.expr(f"array({by_label})").alias("w"), F.sum("n").alias("whole"), F.count("*").alias("c")), "c", "tally")


def propagate_labels(nodes: DataFrame, edges: DataFrame, rooms: list[int], rounds: int) -> tuple[DataFrame, list[int], list[int]]:
    """(labels, loads, history) for nodes (g, n, label, fixed) of n rows and edges (hub, g, n): nodes that share a hub are neighbours.

    In each round a hub counts its rows by label, and a node adds up its neighbours'
    labels, where a hub has one vote, shared by its rows, so that a hub of a third of
    all rows weighs no more than one of two.  Half of the nodes, by hash, ask to move
    to the label with the most votes if it has more than their own.  Requests are
    added up by (from, to, level of gain, cell), and the driver approves cells with
    `approve`, so it sees shards * shards * 3 * CELLS numbers at most and no room is
    passed.  All other work is joins and partial aggregations; hot hubs are dealt
    out.  Rounds end when fewer than one in 200 rows moves.

    labels has g, n, label, fixed, links (rows of other nodes that share a hub, for
    each hub) and cut_links (those with another label).  loads are the rows of nodes
    that aren't fixed, by label.  history has the linked pairs of rows that are cut at
    the start and at the end, then the rows that moved in each round.
    """
    spark, shards = nodes.sparkSession, len(rooms)
    state = materialize(edges.join(nodes.select("g", "label", "fixed").hint("merge"), "g"), "state")
    held = {r["label"]: r["n"] for r in nodes.where("not fixed").groupBy("label").agg(F.sum("n").alias("n")).collect()}  # one row for each shard
    loads = [int(held.get(t, 0)) for t in range(shards)]
    history, moved = [], 0
    square = F.col("whole").cast("double") * F.col("whole") - F.aggregate("w", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    for turn in range(rounds + 1):
        tally, known = _tally(state, shards)
        if turn:
            history.append(moved)
        done = turn == rounds or (turn and 200 * moved <= sum(loads))
        if done or not turn:
            history.insert(min(turn, 1), int((tally.agg(F.sum(square)).first()[0] or 0) // 2))
        if done:
            break
        # one parsed expression for each label is much quicker to build than columns
        votes = [F.expr(f"sum(floor((w[{t}] - if(label = {t}, n, 0)) * {UNIT} / greatest(whole - n, 1))) AS v{t}") for t in range(shards)]
        asks = hot_join(state.where("not fixed"), tally, ["hub"], "c", known=known).groupBy("g", "n", "label").agg(*votes)
        best = F.expr("array_max(array(" + ", ".join(f"struct(v{t} AS v, label = {t} AS stays, xxhash64({turn}, g, {t}) AS x, {t} AS t)" for t in range(shards)) + "))")
        asks = asks.select("g", "n", "label", best.alias("best"), F.expr(f"get(array({', '.join(f'v{t}' for t in range(shards))}), label)").alias("own"))
        gain = F.col("best.v") - F.col("own")
        level = F.when(gain >= UNIT, 2).when(gain >= UNIT // 4, 1).otherwise(0)
        active = F.pmod(F.xxhash64(F.lit(-1 - turn), "g"), F.lit(2)) == 0
        cell = F.pmod(F.xxhash64(F.lit(turn), "g"), F.lit(CELLS)).cast("int")
        asks = asks.where(active & (gain > 0)).select("g", "n", F.col("label").alias("from"), F.col("best.t").alias("to"), level.alias("level"), cell.alias("cell"))
        asks = materialize(asks, "asks")
        asked = {(r["from"], r["to"], r["level"], r["cell"]): int(r["n"]) for r in asks.groupBy("from", "to", "level", "cell").agg(F.sum("n").alias("n")).collect()}
        good = approve(asked, loads, rooms)
        moved = sum(asked[k] for k in good)
        if good:
            for k in good:
                loads[k[0]] -= asked[k]
                loads[k[1]] += asked[k]
            cells = F.broadcast(spark.createDataFrame(sorted(good), "from int, to int, level int, cell int"))  # shards * shards * 3 * CELLS rows at most
            moves = asks.join(cells, ["from", "to", "level", "cell"]).select("g", "to")
            after = state.join(moves.hint("merge"), "g", "left").withColumn("label", F.coalesce("to", "label")).drop("to")
            after = materialize(after.select("hub", "g", "n", "label", "fixed"), "state")
            discard(state, tally, asks)
            state = after
        else:
            discard(tally, asks)
    same = F.coalesce(F.get("w", F.col("label")) - F.col("n"), F.lit(0))
    linked = hot_join(state, tally, ["hub"], "c", known=known).groupBy("g").agg(F.first("label").alias("now"), F.sum(F.col("whole") - F.col("n")).alias("links"), F.sum(F.col("whole") - F.col("n") - same).alias("cut_links"))
    labels = nodes.join(linked.hint("merge"), "g", "left").select("g", "n", F.coalesce("now", "label").alias("label"), "fixed", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("links", "cut_links")])
    labels = materialize(labels, "labels")
    discard(state, tally)
    return labels, loads, history


def _replace(groups: DataFrame, left: list[int], rounds: int) -> DataFrame:
    """(g, to) for groups (g, n) that find a shard with room left for the whole of them, asking by hash in rounds; `left` is brought up to date."""
    spark = groups.sparkSession
    settled, open_ = [], materialize(groups, "open")
    for turn in range(rounds):
        rooms = F.array(*[F.lit(r).cast("long") for r in left])
        draw = lambda t: F.xxhash64(F.lit(turn), "g", t)  # noqa: E731, B023
        ask = F.array_max(F.transform(rooms, lambda r, t: F.when(r >= F.col("n"), F.struct(draw(t).alias("x"), t.alias("to")))))  # noqa: B023
        asks = materialize(open_.withColumn("to", ask["to"]).withColumn("cell", F.pmod(draw(F.lit(-1)), F.lit(8 * CELLS)).cast("int")), "asks")
        good = []
        for r in sorted(asks.where("to is not null").groupBy("to", "cell").agg(F.sum("n").alias("n")).collect(), key=lambda r: (r["to"], r["cell"])):  # 8 * CELLS rows for each shard
            if r["n"] <= left[r["to"]]:
                left[r["to"]] -= r["n"]
                good.append((r["to"], r["cell"]))
        if not good:
            break
        cells = F.broadcast(spark.createDataFrame(good, "to int, cell int"))  # 8 * CELLS * shards rows at most
        settled.append(asks.join(cells, ["to", "cell"]).select("g", "to"))
        open_ = asks.join(cells, ["to", "cell"], "left_anti").select("g", "n")
    out = groups.select("g", F.lit(None).cast("int").alias("to")).limit(0)
    for s in settled:
        out = out.unionByName(s)
    return out


def place_groups(groups: DataFrame, edges: DataFrame, quotas: list[int], rounds: int, exact: int = 8):
    """(placed, large, undecided, segments, history) for groups (g, n) and edges (hub, g, n): where linked rows go, under row quotas.

    Groups of more than 1 / exact of a shard, at most exact * shards of them, are
    placed one by one by the driver and keep their place; the labels of all others
    with two rows or a neighbour start by hash and are propagated.  If a label holds
    more than its room in the end, cells of it by hash look for another shard that
    takes the whole of them.  Rows without links, the pieces of cut groups and what
    found no shard are the remainder, which fills the shards up.

    placed has g, zone, links, cut_links of groups that aren't large; zone is the
    label, or len(quotas) + k for the k-th cut group, then undecided; rows without
    links come last.  large has the same for large groups, as rows of the driver.
    segments are (start, shard, slot) runs of the order by zone, history is that of
    propagate_labels.
    """
    spark, shards, n = groups.sparkSession, len(quotas), sum(quotas)
    start = F.pmod(F.xxhash64(F.lit(0), "g"), F.lit(shards)).cast("int")
    linked = edges.select("g").distinct().withColumn("linked", F.lit(True))
    nodes = groups.join(linked.hint("merge"), "g", "left").where("n > 1 or linked").select("g", "n", start.alias("label"))
    nodes = materialize(nodes, "nodes")
    least = n / (exact * shards)
    found = [(r["g"], r["n"], {r["label"]: r["n"]}) for r in nodes.where(F.col("n") > least).collect()]  # at most exact * shards rows
    whole, cut, room = _place(found, quotas)
    undecided = shards + len(cut)
    place = [(g, whole.get(g)) for g, _, _ in found]
    fixed = F.broadcast(spark.createDataFrame(place, "g long, place int").withColumn("fixed", F.lit(True)))  # at most exact * shards rows
    marked = nodes.join(fixed, "g", "left").select("g", "n", F.when(F.col("fixed"), F.col("place")).otherwise(F.col("label")).alias("label"), F.coalesce("fixed", F.lit(False)).alias("fixed"))
    marked = materialize(marked, "marked")
    labels, loads, history = propagate_labels(marked, edges, room, rounds)
    # labels beyond their room give cells back
    cell = F.pmod(F.xxhash64(F.lit(-7), "g"), F.lit(8 * CELLS)).cast("int")
    over = [t for t in range(shards) if loads[t] > room[t]]
    spare, kept = [], list(loads)
    if over:
        cells = labels.where(~F.col("fixed") & F.col("label").isin(over)).groupBy("label", cell.alias("cell")).agg(F.sum("n").alias("n")).collect()  # 8 * CELLS rows for each shard
        for r in sorted(cells, key=lambda r: (r["n"], r["cell"]), reverse=True):
            if kept[r["label"]] > room[r["label"]]:
                kept[r["label"]] -= r["n"]
                spare.append((r["label"], r["cell"]))
    gone = F.broadcast(spark.createDataFrame(spare, "label int, cell int").withColumn("gone", F.lit(True)))  # 8 * CELLS * shards rows at most
    small = labels.where(~F.col("fixed")).withColumn("cell", cell).join(gone, ["label", "cell"], "left")
    zone = F.when(F.col("gone"), undecided).otherwise(F.col("label"))
    left = [room[t] - kept[t] for t in range(shards)]
    if spare:
        small = small.join(_replace(small.where("gone").select("g", "n"), left, rounds).hint("merge"), "g", "left")
        zone = F.coalesce("to", zone)
    placed = small.select("g", zone.alias("zone"), "links", "cut_links")
    zones = {g: shards + k for k, g in enumerate(cut)}
    large = [(r["g"], whole.get(r["g"], zones.get(r["g"])), r["links"], r["cut_links"]) for r in labels.where("fixed").collect()]  # at most exact * shards rows
    # the order by zone: what each label holds, the pieces of cut groups, then the rest into what room is left, widest first
    given = [0] * shards
    for pieces in cut.values():
        for t, rows_in in pieces:
            given[t] += rows_in
    used = [quotas[t] - left[t] - given[t] for t in range(shards)]
    runs = [(t, used[t]) for t in range(shards)] + [x for pieces in cut.values() for x in pieces] + sorted(enumerate(left), key=lambda x: (-x[1], x[0]))
    segments, position, slots = [], 0, [0] * shards
    for t, rows_in in runs:
        if rows_in:
            segments.append((position, t, slots[t]))
            position += rows_in
            slots[t] += rows_in
    return placed, large, undecided, segments, history


def shard_documents(docs: DataFrame, shards: int = 16, rounds: int = 6, seed: int = 5, width: int = 5, minima: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, group_id, links, cut_links for each row of docs (doc_id, text).

    The law is `rows`: shard sizes differ by one row at most.  Equal texts are one
    group and stay together.  Groups are linked by hubs: the `minima` smallest
    hashes of their distinct shingles of `width` words, so texts that share much
    share hubs, and no hub is left out for its size.  Labels start by hash; balanced
    label propagation under the quotas moves linked groups towards their
    neighbours' shards, and the remainder, mostly rows without links, fills each
    shard up.  A group is cut only if it exceeds a shard or no shard has room.
    links counts the rows of other groups that share a hub, for each hub, and
    cut_links those in another shard, as the propagation left them.  slot counts from
    0 within a shard.

    The global order is one range partitioning on (zone, group, row hash), so a
    group with a third of all rows is dealt out over many partitions; positions
    are a partition's offset (one row for each partition) plus the place in it.

    Size is the text's UTF-8 bytes plus 1, null: 1 with the CRC of no bytes.  Null
    texts form one group without links, as do empty ones.  Repeated rows are separate
    rows with slots of their own; an empty table gives an empty result; null doc_ids
    are sharded like others.
    """
    spark = docs.sparkSession
    python_workers(spark)
    text = F.col("text").cast("string")
    body = F.coalesce(text, F.lit(""))
    # crc32, size and two 64-bit hashes tell texts apart
    group = F.xxhash64(F.coalesce(F.xxhash64(F.lit(seed), text), F.lit(1)), F.hash(body), F.octet_length(body), F.crc32(body.cast("binary")))
    rows = docs.select(F.col("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).cast("long").alias("text_crc32"), group.alias("group_id"), text.alias("text"))
    rows = rows.withColumn("doc", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("group_id"))).select("doc_id", "size", "text_crc32", "group_id", "doc", "text")
    kind = dict(rows.dtypes)["doc_id"]
    rows = materialize(rows.mapInArrow(_hubs(width, minima), f"doc_id {kind}, size long, text_crc32 long, group_id long, doc long, hubs array<bigint>"), "shard")
    each, more = divmod(rows.count(), shards)
    if not each + more:
        return _cut(rows.select("doc_id", "size", "text_crc32", "group_id", "doc", F.lit(0).alias("zone"), F.lit(0).cast("long").alias("links"), F.lit(0).cast("long").alias("cut_links")), [(0, 0, 0)], spark)
    groups = materialize(rows.groupBy(F.col("group_id").alias("g")).agg(F.count("*").alias("n"), F.first("hubs").alias("hubs")), "groups")
    every = groups.select(F.explode("hubs").alias("hub"), "g", "n")
    shared, known = weighed(every.groupBy("hub").agg(F.count("*").alias("c")).where("c > 1"), "c", "shared")
    edges = materialize(hot_join(every, shared, ["hub"], "c", known=known), "edges")
    # the first n % shards shards hold one row more
    placed, large, undecided, segments, _ = place_groups(groups.select("g", "n"), edges, [each + (t < more) for t in range(shards)], rounds)
    table = spark.createDataFrame(large, "group_id long, large int, links_1 long, cut_1 long")  # some 64 groups for each shard at most
    joined = rows.drop("hubs").join(F.broadcast(table), "group_id", "left")
    # rows of large groups have their place and are dealt out by doc
    key = F.when(F.col("large").isNull(), F.col("group_id")).otherwise(F.col("doc"))
    joined = joined.withColumn("key", key).join(placed.withColumnRenamed("g", "key").hint("merge"), "key", "left")
    placed_by_driver = F.col("large").isNotNull()
    pick = lambda a, b: F.when(placed_by_driver, F.col(a)).otherwise(F.coalesce(b, F.lit(0)))
    joined = joined.select("doc_id", "size", "text_crc32", "group_id", "doc", F.coalesce("large", "zone", F.lit(undecided + 1)).alias("zone"), pick("links_1", "links").alias("links"), pick("cut_1", "cut_links").alias("cut_links"))
    out = _cut(joined, segments, spark)
    discard(groups, shared, edges, rows)
    return out


def _cut(placed: DataFrame, segments: list[tuple[int, int, int]], spark) -> DataFrame:
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ["zone", "group_id", "doc", "doc_id"]
    laid = placed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    laid = materialize(laid.withColumn("place", F.monotonically_increasing_id()), "laid")
    laid = laid.withColumn("part", F.shiftright("place", 33)).withColumn("inside", F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = sorted((r["part"], r["n"]) for r in laid.groupBy("part").agg(F.count("*").alias("n")).collect())
    offsets, n = [], 0
    for part, count in counts:
        offsets.append((part, n))
        n += count
    starts = F.broadcast(spark.createDataFrame(offsets, "part long, start long"))  # one row for each partition
    out = laid.join(starts, "part", "left").withColumn("position", F.col("start") + F.col("inside"))
    firsts, shards, slots = (F.array(*[F.lit(x).cast("long") for x in column]) for column in zip(*segments, strict=True))
    out = out.withColumn("run", F.size(F.filter(firsts, lambda x: x <= F.col("position"))) - 1)
    shard = F.get(shards, F.col("run")).cast("int")
    slot = F.get(slots, F.col("run")) + F.col("position") - F.get(firsts, F.col("run"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_id", "links", "cut_links",
    )
