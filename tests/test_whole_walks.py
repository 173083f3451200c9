"""Walks and look-ups over every root and id against plain searches."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables aren't here")


def reached(edges, root, depth, cap=4000):
    seen, frontier = {root: 0}, {root}
    for d in range(1, depth + 1):
        frontier = {b for a in frontier for b in edges.get(a, ())} - seen.keys()
        seen |= dict.fromkeys(frontier, d)
    return set(sorted((d, n) for n, d in seen.items())[:cap])


def after(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    return out


@pytest.fixture(scope="module")
def graph(spark):
    import __spark_entry__ as entry
    from docgraph.jobs.inputs import edges, symbols

    roots = {r.anchor for r in entry.queries()["g5_roots_of"](spark, SF).collect()}
    pairs = set()
    for r in edges(spark, SF).where("kind = 'calls' AND `to` IS NOT NULL").collect():
        pairs |= {(r["from"], to) for to in [r["to"], *(r["candidates"] or [])]}
    return roots, pairs, {r.anchor: r.name for r in symbols(spark, SF).collect()}


def rows_of(spark, name):
    import __spark_entry__ as entry

    return entry.queries()[name](spark, SF).collect()


def test_callees_and_callers(spark, graph):
    roots, pairs, names = graph
    down, up = after(pairs), after((b, a) for a, b in pairs)
    shown = after((a, b) for a, b in pairs if not names[b].startswith("small"))
    asked = {f"p:{r.s_suppkey * 5}" for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()}
    for name, start, edges, depth in (("i1_callees", roots, down, 6), ("i2_callers", asked, up, 99), ("i4_hide_accessors", roots, shown, 6)):
        rows = [(r.root, r.depth, r.node) for r in rows_of(spark, name)]
        assert sorted(rows) == sorted((root, d, n) for root in start for d, n in reached(edges, root, depth))


def plain_layers(root, down, nodes):
    """Longest paths after a recursive depth-first walk set its back edges aside."""
    import sys

    sys.setrecursionlimit(100_000)
    after, open_, done, forward = {n: [b for b in sorted(down.get(n, ())) if b in nodes] for n in nodes}, set(), set(), []

    def visit(n):
        open_.add(n)
        for b in after[n]:
            if b not in open_:
                forward.append((n, b))
                if b not in done:
                    visit(b)
        open_.discard(n)
        done.add(n)

    visit(root)
    layer, changed = dict.fromkeys(nodes, 0), True
    while changed:
        changed = False
        for a, b in forward:
            if layer[b] < layer[a] + 1:
                layer[b], changed = layer[a] + 1, True
    return layer


def test_layers_of_every_root(spark, graph):
    roots, pairs, _ = graph
    down = after(pairs)
    rows = {}
    for r in rows_of(spark, "i3_layers"):
        rows.setdefault(r.root, {})[r.node] = r.layer
    expected = {}
    for r in roots & down.keys():
        near = reached(down, r, 6)
        shown = {a: down.get(a, set()) for d, a in near if d < 6}  # nodes at the horizon aren't followed
        expected[r] = plain_layers(r, shown, {n for _, n in near})
    assert rows == expected


def test_candidates_count_everywhere(spark):
    """A calls the interface I of another container; X and Y implement it, L is a leaf that nothing but a candidate reaches."""
    from docgraph.operators import graph, walk

    s = spark.createDataFrame([("A", "a", "c1", "Function"), ("I", "i", "c2", "Function"), ("X", "x", "c2", "Function"), ("Y", "getY", "c3", "Function"), ("F", "f", "c3", "File"), ("<init>", "n", "c3", "Function")], "anchor string, name string, container string, kind string")
    raw = spark.createDataFrame([("calls", "A", "I", None, ("a.js", 3)), ("calls", "X", None, "out", ("x.js", 1)), ("imports", "A", "F", None, None), ("calls", "A", "F", None, None)], "kind string, from string, to string, to_text string, site struct<file: string, line: int>")
    e = graph.dispatch(raw, spark.createDataFrame([("I", "X"), ("I", "Y")], "member string, impl string"))
    d = {r.anchor: (r.out_degree, r.in_degree) for r in graph.degrees(e, s).collect()}
    assert d == {"A": (2, 0), "I": (0, 1), "X": (1, 1), "Y": (0, 1), "F": (0, 1), "<init>": (0, 0)}
    c = graph.classify(s, e)
    flags = {r.anchor: (r.leaf, r.accessor, r.entry) for r in c.collect()}
    assert flags == {"A": (False, False, False), "I": (True, False, True), "X": (False, False, True), "Y": (True, True, True), "F": (False, False, True), "<init>": (False, False, False)}
    starts = spark.createDataFrame([("A",)], "anchor string")
    assert {r.anchor for r in graph.classify(s, e, starts).where("entry").collect()} == {"A", "I", "X", "Y", "F"}
    assert {tuple(r) for r in graph.roots_of(c, e).collect()} == {("c1", "A"), ("c2", "X"), ("c3", "F")}
    who = graph.who_calls(spark.createDataFrame([("X",), ("A",), ("no",)], "anchor string"), s, e).collect()
    assert {(r.anchor, r.found, r.caller, r.kind, r.site and r.site.line) for r in who} == {("X", True, "A", "candidate", 3), ("A", True, None, None, None), ("no", False, None, None, None)}
    reach = walk.walk(e, spark.createDataFrame([("A",)], "root string"))
    assert {(r.node, r.depth) for r in reach.collect()} == {("A", 0), ("I", 1), ("X", 1), ("Y", 1), ("F", 1)}
    assert {r.node for r in walk.impact(e, spark.createDataFrame([("Y",)], "root string")).collect()} == {"Y", "A"}
    cut = {(r.node, r.total, r.truncated) for r in walk.cap_slice(reach, 2).collect()}
    assert cut == {("A", 5, True), ("F", 5, True)}


def test_rollup_of_small_trees(spark):
    from docgraph.operators import graph

    modules = spark.createDataFrame([("r", "a/x", False), ("r", "a/y", True), ("r", "b", False), ("one", "m/p", False), ("one", "m/q", False), ("solo", "s", False), ("ring", "u", False), ("ring", "v", False)], "repo string, path string, start boolean")
    edges = spark.createDataFrame([("r", "a/x", "a/y", 2), ("r", "a/y", "b", 3), ("r", "a/x", "b", 4), ("ring", "u", "v", 1), ("ring", "v", "u", 1)], "repo string, a string, b string, calls long")
    nodes, rolled = graph.rollup_modules(modules, edges)
    assert {tuple(r) for r in rolled.where("repo = 'r'").collect()} == {("r", "", "g:a", "b", 7), ("r", "a", "a/x", "a/y", 2), ("r", "a", "a/y", "x:b", 3), ("r", "a", "a/x", "x:b", 4), ("r", "b", "x:a", "b", 7)}
    got = {(r.view, r.node, r.label, r.external, r.root) for r in nodes.where("repo = 'r'").collect()}
    assert got == {("", "g:a", "a", False, True), ("", "b", "b", False, False), ("a", "a/x", "x", False, True), ("a", "a/y", "y", False, True), ("a", "x:b", "b", True, False), ("b", "b", "b", False, True), ("b", "x:a", "a", True, True)}
    assert {r.node for r in nodes.where("repo = 'ring' AND view = '' AND root").collect()} == {"u", "v"}
    assert {tuple(r) for r in graph.home_view(modules).collect()} == {("r", ""), ("one", "m"), ("solo", ""), ("ring", "")}


def test_a_full_root_is_not_followed(spark):
    from docgraph.operators import walk

    edges = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "e"), ("x", "y"), ("y", "z"), ("z", "a")]
    e = spark.createDataFrame(edges, "from string, to string")
    roots = spark.createDataFrame([("a",), ("x",)], "root string")
    for cap in (1, 2, 3, 4, 9):
        got = [(r.root, r.depth, r.node) for r in walk.walk(e, roots, cap=cap).collect()]
        assert sorted(got) == sorted((root, d, n) for root in "ax" for d, n in reached(after(edges), root, 6, cap))
