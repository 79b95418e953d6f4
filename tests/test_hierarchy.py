"""Hierarchies against brute force on small graphs."""

import random
from collections import defaultdict, deque

from astrolith.operators.hierarchy import Forest, descendants


def brute(edges):
    """{(node, root): depth} and the nodes at or below a loop."""
    edges = {(a, b) for a, b in edges if a and b}
    up = defaultdict(set)
    for a, b in edges:
        up[a].add(b)
    nodes = {x for e in edges for x in e}
    reach = {}
    for n in nodes:
        dist, queue = {n: 0}, deque([n])
        while queue:
            x = queue.popleft()
            for y in up[x]:
                if y not in dist:
                    dist[y] = dist[x] + 1
                    queue.append(y)
        reach[n] = dist
    on_loop = {n for n in nodes if any(n in reach[p] for p in up[n])}
    rows = {(n, r, d) for n in nodes for r, d in reach[n].items() if not up[r]}
    return rows | {(n, "", -1) for n in nodes if on_loop & set(reach[n])}


def frame(spark, edges):
    return spark.createDataFrame(list(edges), "child string, parent string")


def found(spark, edges):
    return {tuple(r) for r in Forest(frame(spark, edges)).distances().collect()}


CASES = {
    "empty": [],
    "missing_ends": [(None, "a"), ("a", None), ("", "a"), ("b", "")],
    "chain_and_repeat": [("c", "b"), ("c", "b"), ("b", "a")],
    "diamond": [("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("c", "z"), ("a", "top")],
    "self_loop_with_way_out": [("a", "a"), ("a", "root"), ("b", "a")],
    "loop": [("a", "b"), ("b", "c"), ("c", "a"), ("t", "a"), ("c", "out"), ("x", "out")],
    "deep": [(f"n{i}", f"n{i + 1}") for i in range(70)] + [("n10", "other"), ("n65", "n64x")],
}


def random_edges():
    rng = random.Random(5)
    step = lambda a: max(0, a - rng.randint(1, 6))
    return [(f"v{a}", f"v{rng.randrange(60) if rng.random() < 0.05 else step(a)}") for a in range(1, 60) for _ in range(rng.choice([1, 1, 1, 2]))]


def test_distances(spark):
    """All cases side by side in one frame, each under its own prefix."""
    cases = {**CASES, "random": random_edges()}
    marked = [(a and f"{name}/{a}", b and f"{name}/{b}") for name, edges in cases.items() for a, b in edges]
    got, want = found(spark, marked), brute(marked)
    for name in cases:
        mine = lambda rows: {r for r in rows if r[0].startswith(name + "/")}  # noqa: E731, B023
        assert mine(got) == mine(want), name
    assert got == want


def test_no_links(spark):
    assert found(spark, []) == found(spark, CASES["missing_ends"]) == set()


def test_nested_sets_and_descendants(spark):
    edges = [("b", "a"), ("c", "a"), ("d", "b"), ("e", "b"), ("f", "e"), ("y", "x"), ("l1", "l2"), ("l2", "l1")]
    f = Forest(frame(spark, edges))
    rows = {r.node_key: r for r in f.nested(with_path=True).collect()}
    assert rows["a"].size == 6 and rows["b"].size == 4 and rows["x"].size == 2
    assert list(rows["f"].path) == ["a", "b", "e", "f"] and rows["f"].depth == 3
    assert rows["l1"].on_loop == 1 and rows["l1"].path is None
    spans = sorted((r.pre, r.pre + r.size) for r in rows.values() if r.root_key == "a")
    assert [a for a, _ in spans] == list(range(6))
    below = descendants(f.nested(), frame(spark, [("b", "")]).selectExpr("child as node_key"))
    assert {tuple(r) for r in below.collect()} == {("b", "d", 1), ("b", "e", 1), ("b", "f", 2)}


def brute_below(edges):
    """{(ancestor, node, fewest links)}, at least one link."""
    up = defaultdict(set)
    for a, b in edges:
        if a and b:
            up[a].add(b)
    out = set()
    for n in list(up):
        dist, queue = {p: 1 for p in up[n]}, deque(up[n])
        while queue:
            x = queue.popleft()
            for y in up[x]:
                if y not in dist:
                    dist[y] = dist[x] + 1
                    queue.append(y)
        out |= {(a, n, d) for a, d in dist.items()}
    return out


def all_cases():
    cases = {**CASES, "random": random_edges()}
    return [(a and f"{name}/{a}", b and f"{name}/{b}") for name, edges in cases.items() for a, b in edges]


def test_descendants_over_all_links(spark):
    marked = all_cases()
    rows = [tuple(r) for r in Forest(frame(spark, marked)).descendants().collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_below(marked)


def test_descendants_of_both_trees(spark, tmp_path):
    from astrolith.plans.problems import p1_tree_descendants

    put = lambda name, rows, kind: spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    put("src_inheritance", [("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("l", "l"), ("", "a")], "derived_usr string, base_usr string")
    put("src_classes", [("k", 2), ("m", 0)], "usr string, namespace_id bigint")
    put("src_namespaces", [(2, 1), (1, 0)], "id bigint, parent_id bigint")
    assert {tuple(r) for r in p1_tree_descendants(spark, str(tmp_path)).collect()} == {
        ("inheritance", "b", "d", 1), ("inheritance", "c", "d", 1), ("inheritance", "a", "d", 2), ("inheritance", "a", "b", 1),
        ("inheritance", "a", "c", 1), ("inheritance", "l", "l", 1),
        ("namespace", "2", "k", 1), ("namespace", "1", "k", 2), ("namespace", "1", "2", 1)}


def test_all_paths(spark):
    marked = all_cases()
    up, roots, below = defaultdict(set), defaultdict(dict), defaultdict(set)
    for a, b in {(a, b) for a, b in marked if a and b}:
        up[a].add(b)
    for n, r, d in brute(marked):
        roots[n][r] = d
    for a, n, _ in brute_below(marked):
        below[a].add(n)
    got = defaultdict(dict)
    for r in Forest(frame(spark, marked)).all_paths().collect():
        n = r.node_key
        assert r.root_key not in got[n] and (r.n_parents, r.n_below) == (len(up[n]), len(below[n] - {n})), n
        assert r.at_loop == ("" in roots[n]), n
        got[n][r.root_key] = r.depth
        if r.root_key is None:
            assert r.depth is None and r.path is None
            continue
        assert r.path[0] == r.root_key and r.path[-1] == n and len(r.path) == r.depth + 1
        for above, x in zip(r.path, r.path[1:]):
            assert above == min(p for p in up[x] if roots[p].get(r.root_key) == roots[x][r.root_key] - 1)
    want = {n: {r: d for r, d in rs.items() if r} or {None: None} for n, rs in roots.items()}
    assert got == want
    assert got["diamond/d"] == {"diamond/top": 3, "diamond/z": 2}
