"""The sweep over ranges against the plain rule, and pointer doubling against walking."""

import random

import pytest

from codeatlas.operators import closure, ranges


def plain(found, total):
    """Pieces by trying every range at every piece: (start, end, class, semantic, link)."""
    found = [r for r in found if r[1] > r[0]]
    cuts = sorted({b for r in found for b in r[:2]})
    out, done = [], 0
    for a, b in zip(cuts, cuts[1:]):
        best = None
        for s, e, cls, semantic, link in sorted(found, key=lambda r: (r[0], r[3])):
            if s <= a and b <= e:
                best = ranges.better(best, (semantic and (s, e) == (a, b), cls, link))
        if best:
            if a > done:
                out.append((done, a - done, None, None))
            out.append((a, b - a, best[1], best[2]))
            done = b
    return out + ([(done, total - done, None, None)] if total > done else [])


def swept(found, total):
    return list(ranges.covered(sorted((r for r in found if r[1] > r[0]), key=lambda r: (r[0], r[3])), total))


def test_reference_cases():
    assert [r[:2] for r in swept([(2, 5, "a", False, None), (6, 8, "b", True, None)], 12)] == [(0, 2), (2, 3), (5, 1), (6, 2), (8, 4)]
    one = lambda *rs: swept([(0, 3, *r) for r in rs], 3)[0][2:]
    assert one(("keyword", False, None), ("comment", True, None)) == ("comment", None)
    assert one(("a", False, None), ("b", False, None)) == ("b", None) and one(("b", False, None), ("a", False, None)) == ("a", None)
    assert one(("zzz", False, None), ("text", False, None)) == ("zzz", None) and one(("text", False, None), ("zzz", False, None)) == ("zzz", None)
    assert one(("a", False, None), ("comment", False, "u")) == ("a", "u") and one(("a", False, "v"), ("b", False, None)) == ("b", "v")
    assert one(("a", False, "v"), ("b", True, "u")) == ("b", "v")
    # a semantic range that is cut is an ordinary one, and the later wins
    assert swept([(0, 4, "a", True, None), (2, 6, "b", False, None)], 6) == [(0, 2, "a", None), (2, 2, "b", None), (4, 2, "b", None)]


@pytest.mark.parametrize("seed", range(40))
def test_against_plain(seed):
    rng = random.Random(seed)
    found = []
    for _ in range(rng.randint(0, 40)):
        s = rng.randint(0, 30)
        found.append((s, s + rng.choice((0, 1, 2, 3, 9, 25)), rng.choice(("text", "comment", "k", "t", None)), rng.random() < 0.4, rng.choice((None, None, "u", "v"))))
    assert swept(found, 60) == plain(found, 60)
    pieces = sorted((s, s + n) for s, n, r in ranges.split(sorted((r for r in found if r[1] > r[0]), key=lambda r: r[0])))
    cuts = sorted({b for r in found if r[1] > r[0] for b in r[:2]})
    assert pieces == sorted((a, b) for r in found if r[1] > r[0] for a, b in zip(cuts, cuts[1:]) if r[0] <= a and b <= r[1])


def test_many_ranges_in_one_text():
    """All open at once: each opening and closing takes logarithmic time."""
    n = 30_000
    out = list(ranges.covered(((k, 2 * n - k, "comment" if k % 7 == 0 else f"c{k % 5}", k % 2 == 0, None) for k in range(n)), 2 * n))
    assert len(out) == 2 * n - 1 and sum(r[1] for r in out) == 2 * n


def test_in_spark(spark):
    rng = random.Random(1)
    rows = [(d, s, rng.randint(0, 6), rng.choice(("text", "comment", "k")), rng.random() < 0.5, rng.choice((None, "u")), i) for d in ("x", "y", None) for i, s in enumerate(rng.choices(range(20), k=15))]
    docs = [("x", 40), ("y", 3), ("empty", 5), ("nothing", 0)]
    got = ranges.prepared(spark.createDataFrame(docs, "doc string, total int"), spark.createDataFrame(rows, "doc string, start long, len long, class string, semantic boolean, link string, seq long"), "doc", "total").collect()
    for d in ("x", "y", None):
        want = plain([(r[1], r[1] + r[2], r[3], r[4], r[5]) for r in sorted(rows, key=lambda r: r[6]) if r[0] == d], dict(docs).get(d, 0))
        assert sorted(tuple(r)[1:3] for r in got if r["doc"] == d) == [w[:2] for w in want]
        assert {tuple(r)[1:] for r in got if r["doc"] == d} == set(want)
    assert [tuple(r) for r in got if r["doc"] in ("empty", "nothing")] == [("empty", 0, 5, None, None)]


def forwards(spark, edges):
    rows = closure.forward_closure(spark.createDataFrame([(a, "t", b) for a, b in edges], "assembly int, type_id string, to_assembly int")).collect()
    return {r["assembly"]: (r["terminal"], r["depth"]) for r in rows}


def walked(edges):
    to, out = dict(edges), {}
    for a in to:
        seen, at = {a}, a
        while at in to and to[at] not in seen:
            at = to[at]
            seen.add(at)
        out[a] = (at, len(seen) - 1)
    return out


def test_long_chain(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    edges = [(k, k + 1) for k in range(10_000)]
    assert forwards(spark, edges) == {k: (10_000, 10_000 - k) for k in range(10_000)}
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


def test_rings_and_tails(spark):
    rng = random.Random(5)
    edges = [(k, rng.randrange(60)) for k in range(50)] + [(100, 101), (101, 102), (102, 100), (103, 100), (200, 200), (201, 200)]
    assert forwards(spark, edges) == walked(edges)


def test_ancestors_and_names(spark):
    n = 150
    nodes = spark.createDataFrame([(k, k - 1 if k else None, f"n{k}") for k in range(n)] + [(900, 899, "orphan")], "node int, parent int, name string")
    got = {(r["node"], r["ancestor"]): r["distance"] for r in closure.ancestors(nodes).collect()}
    assert got == {(a, b): a - b for a in range(n) for b in range(a)} | {(900, 899): 1}
    names = {r["node"]: (r["qualified"], r["depth"]) for r in closure.qualified_names(nodes).collect()}
    assert names[n - 1] == (".".join(f"n{k}" for k in range(n)), n - 1) and names[0] == ("n0", 0) and names[900] == ("orphan", 0)
    ring = spark.createDataFrame([(1, 2, "a"), (2, 1, "b")], "node int, parent int, name string")
    for f in (closure.ancestors, closure.qualified_names):
        with pytest.raises(ValueError):
            f(ring).collect()
