from __future__ import annotations

import random
import time

from tessera.operators.cluster import build_groups, split_component
from tessera.operators.graph import connected_components

EDGE = "a string, b string, confidence int, match_type string"


def groups(spark, edges, rejected=()):
    found = build_groups(spark.createDataFrame(edges, EDGE), spark.createDataFrame(list(rejected), "a string, b string"))
    return [(r.group_id, r.members, r.confidence, r.match_type) for r in found.orderBy("group_id").collect()]


def test_transitive(spark):
    assert groups(spark, [("a", "b", 100, "exact"), ("b", "c", 90, "near_exact")]) == [(1, ["a", "b", "c"], 100, "exact")]


def test_maximum_confidence_and_strongest_type(spark):
    assert groups(spark, [("a", "b", 60, "embedding_color_verified"), ("a", "c", 95, "near_exact")]) == [(1, ["a", "b", "c"], 95, "near_exact")]


def test_independent_and_numbered_by_confidence(spark):
    found = groups(spark, [("e", "f", 60, "near_exact"), ("a", "b", 100, "exact"), ("c", "d", 80, "near_exact")])
    assert [(g[0], g[1]) for g in found] == [(1, ["a", "b"]), (2, ["c", "d"]), (3, ["e", "f"])]


def test_cannot_link(spark):
    found = groups(spark, [("a", "b", 90, "near_exact"), ("b", "c", 85, "near_exact")], [("c", "a")])
    assert [g[1] for g in found] == [["a", "b"]]


def test_floor_drops_weak_embedding_pairs(spark):
    assert groups(spark, [("a", "b", 44, "embedding_color_verified")]) == []


def test_a_path_of_four_is_too_thin():
    edges = [("a", "b", 90), ("b", "c", 80), ("c", "d", 95)]
    assert sorted(map(sorted, split_component(set("abcd"), edges, set()))) == [["a", "b"], ["c", "d"]]


def test_empty(spark):
    assert groups(spark, []) == []


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def plain_split(nodes, edges, banned, floor=45):
    """The published rule, step by step, with everything looked up anew."""
    queue, out = [(set(nodes), list(edges))], []
    while queue:
        part, inside = queue.pop()
        # what is connected
        left, parts = set(part), []
        while left:
            found, todo = set(), [min(left)]
            while todo:
                x = todo.pop()
                found.add(x)
                todo += [y for a, b, _ in inside for y in ((b,) if a == x else (a,) if b == x else ()) if y not in found]
            left -= found
            parts.append(found)
        if len(parts) > 1:
            queue += [(p, [e for e in inside if e[0] in p]) for p in parts]
            continue
        n = len(part)
        apart = any(a in part and b in part for a, b in banned)
        weak = any(c < floor for _, _, c in inside)
        if n == 1 or (not apart and not weak and (n == 2 or 2 * len(inside) / (n * (n - 1)) >= (0.65 if n == 3 else 0.7))):
            out.append(part)
        else:
            gone = min(inside, key=lambda e: (e[2], e[0], e[1]))
            queue.append((part, [e for e in inside if e is not gone]))
    return out


def test_split_against_the_plain_rule():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(2, 9)
        edges = [(i, j, rng.randint(40, 60)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.6]
        nodes = {x for a, b, _ in edges for x in (a, b)}
        banned = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(0, 2))}
        if nodes:
            assert sorted(map(sorted, split_component(nodes, edges, banned))) == sorted(map(sorted, plain_split(nodes, edges, banned)))


def test_a_large_component_is_split_quickly():
    rng = random.Random(4)
    edges = [(i, j, 50 + rng.randint(0, 40)) for i in range(400) for j in range(i + 1, min(400, i + 40))]
    began = time.time()
    parts = split_component(set(range(400)), edges, {(0, 399), (10, 60)})
    assert sum(map(len, parts)) == 400 and not any({0, 399} <= p or {10, 60} <= p for p in parts) and time.time() - began < 20


def test_components_with_a_hub(spark, monkeypatch):
    """A node of a third of all edges and more is broadcast, with the same result."""
    from tessera.operators import skew

    monkeypatch.setattr(skew, "LEAST", 20)
    edges = [(0, i) for i in range(1, 400)] + [(i, i + 1000) for i in range(1, 200)] + [(5000 + i, 5001 + i) for i in range(30)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(400)}, **{i + 1000: 0 for i in range(1, 200)}, **{5000 + i: 5000 for i in range(31)}}


def test_hot_join(spark, monkeypatch):
    from tessera.operators import skew

    monkeypatch.setattr(skew, "LEAST", 5)
    left = spark.createDataFrame([(1 if i % 2 else i, i) for i in range(60)] + [(None, 99)], "k long, x long")
    right = spark.createDataFrame([(1, "a", 30), (2, "b", 1), (4, "c", 1)], "k long, y string, n long")
    plain = left.join(right.drop("n"), "k")
    assert sorted(map(tuple, skew.hot_join(left, right, ["k"], "n").collect())) == sorted(map(tuple, plain.collect()))
    assert skew.hot_join(left, right, ["k"], "n", "left").count() == 61 and skew.hot_join(left, right, ["k"], "n", "left_semi").count() == 32
    assert skew.hot_join(left, right.limit(0), ["k"], "n").count() == 0


def test_random_graphs_against_the_split(spark):
    """Aggregates accept exactly the components that the split accepts at its first look."""
    rng = random.Random(7)
    edges, banned = [], []
    for k in range(60):
        names = [f"{k:02d}{c}" for c in "abcdef"[: rng.randint(2, 6)]]
        edges += [(x, y, rng.randint(30, 100), "near_exact") for i, x in enumerate(names) for y in names[i + 1 :] if rng.random() < 0.8]
        banned += [tuple(rng.sample(names, 2)) for _ in range(rng.random() < 0.3)]
    want = []
    for c in {r.component for r in connected_components(spark.createDataFrame(edges, EDGE)).collect()}:
        inside = [(a, b, conf) for a, b, conf, _ in edges if a[:2] == c[:2]]
        nodes = {x for a, b, _ in inside for x in (a, b)}
        for root in sorted(nodes):  # the parts of this prefix that are connected
            part, todo = set(), [root]
            while todo:
                x = todo.pop()
                if x not in part:
                    part.add(x)
                    todo += [b if a == x else a for a, b, _ in inside if x in (a, b)]
            if root == min(part) == c:
                want += [sorted(p) for p in split_component(part, [e for e in inside if e[0] in part], {(min(p), max(p)) for p in banned}) if len(p) > 1]
    assert sorted(g[1] for g in groups(spark, edges, banned)) == sorted(want)


def test_a_large_component_is_split_in_one_pass():
    """A hub's leaves go one by one, each cut leaving all other edges: with a look at all of them for each cut this took the square of the edges."""
    n = 60_000
    edges = [(0, i, 50 + i % 40) for i in range(1, n)] + [(i, i + 1, 99) for i in range(1, n - 1, 2)]
    began = time.time()
    parts = split_component(set(range(n)), edges, {(i, i + 1) for i in range(1, n - 1, 10)})
    assert time.time() - began < 20
    # a leaf whose own edge is the last that 0 keeps stays with it
    assert sorted(x for p in parts for x in p) == list(range(n)) and sum(len(p) == 2 for p in parts) > 0.39 * n


def test_bans_and_weak_edges_in_larger_components_against_the_plain_rule():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(10, 25)
        edges = [(i, j, rng.randint(40, 99)) for i in range(n) for j in range(i + 1, n) if rng.random() < rng.choice((0.1, 0.4, 0.9))]
        nodes = {x for a, b, _ in edges for x in (a, b)}
        banned = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(0, 12))}
        if nodes:
            assert sorted(map(sorted, split_component(nodes, edges, banned))) == sorted(map(sorted, plain_split(nodes, edges, banned)))
