import random
from collections import deque

from braidgraph.operators import hierarchy_versions as hv

CHANGES = "child string, parent string, version string, added boolean"


def stamp(block):
    return f"{block:016d}:00000000"


def changes_of(seed, nodes, count):
    """Edges come and go, in cycles too, repeated and removed without having been there."""
    draw = random.Random(seed)
    rows = []
    for block in range(count):
        for _ in range(draw.choice([0, 1, 1, 2])):
            child, parent = draw.randrange(nodes), draw.randrange(nodes)
            rows.append((f"s{child}", f"s{parent}", stamp(block), draw.random() < 0.6))
    return rows


def walks(rows, version):
    """Brute force: the graph as of a version, breadth-first from each space of an edge."""
    held = {}
    for child, parent, at, added in sorted(rows, key=lambda r: (r[2], r[3])):
        if at <= version:
            held[child, parent] = added
    edges = [edge for edge, added in held.items() if added]
    found = set()
    for root in {space for edge in edges for space in edge}:
        depth, queue = {root: 0}, deque([root])
        while queue:
            space = queue.popleft()
            for child, parent in edges:
                if child == space and parent not in depth:
                    depth[parent] = depth[space] + 1
                    queue.append(parent)
        found |= {(root, space, d) for space, d in depth.items()}
    return found


def check(closure, rows, blocks):
    held = [tuple(row) for row in closure.select(*hv.CLOSURE).collect()]
    for block in blocks:
        version = stamp(block)
        at = [(r, s, d) for r, s, d, lo, hi in held if lo <= version and (hi is None or version < hi)]
        assert len(at) == len(set(at)) and set(at) == walks(rows, version), block
    return held


def test_all_versions_equal_walks_anew(spark):
    rows = changes_of(1, 5, 40)
    edges = hv.edge_versions(spark.createDataFrame(rows, CHANGES))
    held = check(hv.closure_versions(edges), rows, range(-1, 41))
    assert any(hi is not None for *_, hi in held)


def test_extended_closure_equals_one_built_at_once(spark):
    rows = changes_of(3, 6, 45)
    closure = None
    for mark, until in ((None, 20), (20, 99)):
        known = [row for row in rows if row[2] < stamp(until)]
        edges = hv.edge_versions(spark.createDataFrame(known, CHANGES))
        closure = hv.closure_versions(edges) if closure is None else hv.extend(closure, edges, stamp(mark))
    held = check(closure, rows, range(-1, 46))
    whole = hv.closure_versions(hv.edge_versions(spark.createDataFrame(rows, CHANGES)))
    assert sorted(held, key=repr) == sorted((tuple(r) for r in whole.select(*hv.CLOSURE).collect()), key=repr)


def test_odd_changes(spark):
    rows = [("a", "a", stamp(1), True), ("b", None, stamp(1), True), (None, "b", stamp(1), False),
            ("c", "d", stamp(2), False), ("e", "f", stamp(3), True), ("e", "f", stamp(3), False),
            ("e", "f", stamp(3), True), ("e", "f", stamp(5), True), ("e", "f", stamp(6), False)]
    edges = hv.edge_versions(spark.createDataFrame(rows, CHANGES))
    assert {tuple(r) for r in edges.collect()} == {("a", "a", stamp(1), None), ("e", "f", stamp(3), stamp(6))}
    found = {tuple(r) for r in hv.spaces_at(hv.closure_versions(edges), stamp(4)).collect()}
    assert found == {("a", "a", 0), ("e", "e", 0), ("f", "f", 0), ("e", "f", 1)}
    nothing = hv.closure_versions(hv.edge_versions(spark.createDataFrame([], CHANGES)))
    assert nothing.collect() == []
    assert hv.extend(nothing, edges, "").count() == hv.closure_versions(edges).count()
