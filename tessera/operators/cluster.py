"""Clusters under cannot-link, density and confidence constraints."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import connected_components
from tessera.operators.ordering import numbered_groups
from tessera.runtime import materialize

#: Rank of match types, the strongest last.
TYPES = ("embedding_color_verified", "near_exact", "exact")


def type_rank(c: str = "match_type"):
    return F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col(c)).cast("int")


def type_name(c):
    return F.get(F.array(*[F.lit(t) for t in TYPES]), c - 1)


def best_edges(edges: DataFrame) -> DataFrame:
    """One row for each unordered pair: the largest confidence, and apart from it the strongest type."""
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "confidence", type_rank().alias("rank"))
    return pairs.groupBy("a", "b").agg(F.max("confidence").alias("confidence"), F.max("rank").alias("rank"))


def split_component(nodes: set, edges: list[tuple], banned: set[tuple], floor: int = 45) -> list[set]:
    """Parts of a component (connected, or the parts of one that isn't): a part stands if it has no cannot-link pair, no edge under the floor and enough density; else its weakest edge goes and it is looked at anew."""
    names = sorted(nodes)
    at = {x: i for i, x in enumerate(names)}
    links = sorted((c, a, b) for a, b, c in edges)
    ends = np.array([(at[a], at[b]) for _, a, b in links], np.int64).reshape(-1, 2)
    pairs = np.array([(at[a], at[b]) for a, b in banned if a in at and b in at], np.int64).reshape(-1, 2)
    found = defaultdict(set)
    for x, part in zip(names, split_parts(len(names), ends, [c >= floor for c, _, _ in links], pairs).tolist(), strict=True):
        found[part].add(x)
    return list(found.values())


def split_parts(n: int, ends: np.ndarray, firm: list[bool], banned: np.ndarray) -> np.ndarray:
    """The smallest node of its part for each node 0 .. n - 1, by the rule of split_component; ends are node pairs, the weakest first, firm tells which reach the floor.

    Cuts are found backwards: edges come in with the strongest first, and each that
    joins two parts is the cut that would part them.  When a part is joined to
    another, the edges it has are those left to it after the cut, so what it holds
    then tells whether it stands; the largest that stand are the result.  Each edge
    is seen once, and the members and bans of the smaller side move, so a large
    component costs little more than its edges' sort.
    """
    boss, size = list(range(2 * n)), [1] * n + [0] * n
    count, breaks, stands = [0] * (2 * n), [0] * (2 * n), [True] * n + [False] * n
    sides: list[tuple[int, int]] = [(0, 0)] * (2 * n)
    apart = [[] for _ in range(n)]
    for a, b in banned.tolist():
        apart[a].append(b)
        apart[b].append(a)
    # nodes with a ban, by part
    wary: list[list[int]] = [[x] if apart[x] else [] for x in range(n)] + [[] for _ in range(n)]
    made, cut_firm = n, [True] * (2 * n)

    def root(x: int) -> int:
        while boss[x] != x:
            boss[x] = boss[boss[x]]
            x = boss[x]
        return x

    def settle(x: int) -> None:
        m = size[x]
        dense = m <= 2 or 2 * count[x] / (m * (m - 1)) >= (0.65 if m == 3 else 0.70)
        stands[x] = m == 1 or (not breaks[x] and cut_firm[x] and dense)

    for (a, b), strong in zip(ends[::-1].tolist(), reversed(firm), strict=True):
        x, y = root(a), root(b)
        if x == y:
            # edges under the floor go before a part can stand
            count[x] += strong
            continue
        settle(x)
        settle(y)
        few, many = (x, y) if len(wary[x]) <= len(wary[y]) else (y, x)
        breaks[made] = breaks[x] + breaks[y] + sum(root(other) == many for one in wary[few] for other in apart[one])
        wary[many] += wary[few]
        wary[made], wary[few], wary[many] = wary[many], [], []
        size[made], count[made], cut_firm[made], sides[made] = size[x] + size[y], count[x] + count[y] + strong, strong, (x, y)
        boss[x] = boss[y] = made
        made += 1
    part = np.arange(n)
    for top in {root(x) for x in range(n)}:
        settle(top)
        todo = [top]
        while todo:
            x = todo.pop()
            if not stands[x]:
                todo += sides[x]
                continue
            inside, members = [x], []
            while inside:
                y = inside.pop()
                if y < n:
                    members.append(y)
                else:
                    inside += sides[y]
            part[members] = min(members)
    return part


def build_groups(edges: DataFrame, rejected: DataFrame | None = None, floor: int = 45) -> DataFrame:
    """group_members with the members of a group as one sorted array, for groups that fit a row: group_id, members, confidence, match_type."""
    return group_members(edges, rejected, floor).groupBy("group_id", "confidence", "match_type").agg(F.array_sort(F.collect_list("file_path")).alias("members")).select("group_id", "members", "confidence", "match_type")


def group_members(edges: DataFrame, rejected: DataFrame | None = None, floor: int = 45) -> DataFrame:
    """Duplicate groups of edges (a, b, confidence, match_type) under cannot-link pairs (a, b), a row for each member: group_id, file_path, representative, group_size, confidence, match_type.

    Exact pairs collapse to their smallest member first.  Edges under the floor go:
    they are the weakest of a component that can't stand.  Components without a
    cannot-link pair and with enough density stand, pairs that are forbidden part, by
    aggregates of their edges; only the others are split, each in one task, with
    split_parts, as a cut depends on those before; it sees each edge once.  Groups of one collapse away
    unless an exact class stands behind them.  A group's confidence and type are the maxima over its edges;
    ids count from 1 by confidence, size (both falling) and first member.
    """
    kind = dict(edges.dtypes)["a"]
    pairs = materialize(best_edges(edges), "pairs")
    exact = connected_components(pairs.where(F.col("rank") == len(TYPES)).select("a", "b"))
    rep = exact.select("node", F.col("component").alias("rep"))
    ends = lambda df: df.join(rep.toDF("a", "ra"), "a", "left").join(rep.toDF("b", "rb"), "b", "left").withColumn("ra", F.coalesce("ra", "a")).withColumn("rb", F.coalesce("rb", "b"))
    strong = (F.col("rank") == len(TYPES)) | (F.col("confidence") >= floor)
    quotient = ends(pairs.where(strong)).where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "confidence", "rank")
    quotient = materialize(quotient.groupBy("a", "b").agg(F.max("confidence").alias("confidence"), F.max("rank").alias("rank")), "quotient")
    apart = None
    if rejected is not None:
        apart = ends(rejected.select("a", "b")).where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
    whole = materialize(connected_components(quotient), "whole")
    labelled = quotient.join(whole.withColumnRenamed("node", "a"), "a").select("component", "a", "b", "confidence", F.lit(False).alias("banned"))
    if apart is not None:
        inside = apart.join(whole.toDF("a", "component"), "a").join(whole.toDF("b", "c2"), "b").where("component = c2")
        labelled = labelled.unionByName(inside.select("component", "a", "b", F.lit(None).cast("int").alias("confidence"), F.lit(True).alias("banned")))

    def prune(pdf: pd.DataFrame) -> pd.DataFrame:
        links = pdf[~pdf.banned].sort_values(["confidence", "a", "b"])
        names = np.unique(np.concatenate([links.a, links.b]))
        places = lambda df: np.stack([np.searchsorted(names, df[c].to_numpy()) for c in ("a", "b")], axis=1)
        parts = split_parts(len(names), places(links), (links.confidence >= floor).tolist(), places(pdf[pdf.banned]))
        return pd.DataFrame({"rep": names, "part": names[parts]})

    # what split_component accepts at its first look needs no task that holds it
    n = F.col("n")
    dense = 2 * F.col("links") / (n * (n - 1)) >= F.when(n == 2, 0.0).when(n == 3, 0.65).otherwise(0.70)
    seen = labelled.groupBy("component").agg(F.count_if(~F.col("banned")).alias("links"), F.min("confidence").alias("weakest"), F.count_if("banned").alias("bans"))
    seen = seen.join(whole.groupBy("component").agg(F.count("*").alias("n")), "component")
    fate = F.when((F.col("bans") == 0) & (F.col("weakest") >= floor) & dense, "stands").when(F.col("n") == 2, "parts").otherwise("split")
    fates = materialize(seen.select("component", fate.alias("fate")), "fates")
    settled = whole.join(fates.where("fate <> 'split'"), "component").select(F.col("node").alias("rep"), F.when(F.col("fate") == "stands", F.col("component")).otherwise(F.col("node")).alias("part"))
    split = labelled.join(fates.where("fate = 'split'"), "component", "left_semi").groupBy("component").applyInPandas(prune, f"rep {kind}, part {kind}")
    parts = settled.unionByName(split)
    members = rep.select("node", "rep").unionByName(quotient.select(F.col("a").alias("rep")).unionByName(quotient.select(F.col("b").alias("rep"))).distinct().join(rep.select(F.col("rep").alias("r2")).distinct(), F.col("rep") == F.col("r2"), "left_anti").select(F.col("rep").alias("node"), "rep"))
    placed = materialize(members.join(parts, "rep", "left").select("node", F.coalesce("part", "rep").alias("part")).distinct(), "placed")
    inner = pairs.join(placed.toDF("a", "part"), "a").join(placed.toDF("b", "p2"), "b").where("part = p2").groupBy("part").agg(F.max("confidence").alias("confidence"), F.max("rank").alias("rank"))
    groups = placed.groupBy("part").agg(F.min("node").alias("representative"), F.count("*").alias("group_size")).where("group_size >= 2").join(inner, "part")
    groups = numbered_groups(groups.withColumn("match_type", type_name(F.col("rank"))).drop("rank"))
    return placed.join(groups, "part").select("group_id", F.col("node").alias("file_path"), "representative", "group_size", "confidence", "match_type")
