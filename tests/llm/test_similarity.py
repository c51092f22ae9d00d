"""The Jaccard join against all pairs, its trie, and components."""

import random
from collections import defaultdict

import numpy as np
import pytest

from codeatlas.llm import jaccard as J
from codeatlas.llm.components import components


def sets_of(pairs, n):
    out = []
    for i, t in pairs:
        w = (t or "").encode().lower().split()
        out.append((i, frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[k : k + n]) for k in range(len(w) - n + 1)])))
    return out


def brute(pairs, n, percent):
    """(n, component) by id, of documents that may lack one but share none; equal sets link."""
    sets = [(i if i is not None else ("none", k), s) for k, (i, s) in enumerate(sets_of(pairs, n))]
    order = lambda i: (isinstance(i, tuple), i)
    parent = {i: i for i, _ in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, x in sets:
        for j, y in sets:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = find(i), find(j)
                parent[max(a, b, key=order)] = min(a, b, key=order)
    return {i: (len(x), find(i)) for i, x in sets if not isinstance(i, tuple)}


@pytest.mark.parametrize("n,percent,tokens", [(4, 85, J.GROUP_TOKENS), (5, 80, 200)])
def test_edge_rows(docs, pairs, n, percent, tokens):
    got = J.join_components(docs, n, percent, group_tokens=tokens).collect()
    assert len(got) == len(pairs)
    want = brute(pairs, n, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert {r["n_shingles"] for r in got if r["doc_id"] is None} == {0, 1}


def test_no_rows(empty):
    assert J.join_components(empty).count() == 0


def test_documents_without_id_and_of_one_id(spark, tmp_path):
    """A link that runs through a document without an id holds, and documents that share an id are each compared."""
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(9000)}"
    base = [word() for _ in range(100)]
    middle, far = [*base], [*base]
    for k in range(0, 7):
        middle[k] = word()
    far[:7] = middle[:7]
    for k in range(93, 100):
        far[k] = word()
    other, third = [word() for _ in range(90)], [word() for _ in range(90)]
    rows = [(1, base), (None, middle), (2, far), (7, other), (7, third), (8, other[:89]), (9, third[1:]), (None, ["alone"] * 3)]
    rows = [(i, " ".join(t)) for i, t in rows]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(path)
    for tokens in (J.GROUP_TOKENS, 100):
        got = J.join_components(spark.read.parquet(path), 4, 85, group_tokens=tokens, groups=True).collect()
        of = {(r["doc_id"], r["component_id"]) for r in got}
        assert of == {(1, 1), (None, 1), (2, 1), (7, 7), (8, 7), (9, 7), (None, None)}
        groups = defaultdict(set)
        for r in got:
            groups[r["grp"]].add(r["doc_id"])
        assert sorted(map(len, groups.values())) == [1, 2, 2, 3]  # the two documents of id 7 are in groups of their own
    assert brute([(i, t) for i, t in rows if i != 7 and i != 8 and i != 9], 4, 85) == {1: (97, 1), 2: (97, 1)}


def test_large_cluster_of_several_bands(spark, tmp_path):
    """One passage in texts of growing size: a single cluster, cut into bands and blocks."""
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for k in range(48):
        own = [f"w{rng.randrange(10**6)}" for _ in range(k // 2)]
        rows.append((k, " ".join(passage + own)))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    for tokens in (120, 700):
        got = J.join_components(spark.read.parquet(str(tmp_path / "d")), 4, 85, group_tokens=tokens).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 4, 85)


def variants(seed, families=6, size=30):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(40)]
    out = []
    for f in range(families):
        base = [word() for _ in range(rng.randrange(60, 160))]
        if f % 2:
            base[10:10] = passage
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                at = rng.randrange(len(t))
                t[at : at + rng.randrange(0, 3)] = [word()]
            out.append((len(out), " ".join(t)))
    return out


def test_families(spark, tmp_path):
    rows = variants(5)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    got = J.join_components(spark.read.parquet(str(tmp_path / "d")), 4, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 4, 85)


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_trie(percent):
    rng = np.random.default_rng(percent)
    for _ in range(8):
        base = rng.choice(300, 40, replace=False)
        sets = [np.unique(np.r_[rng.choice(base, rng.integers(1, 40), replace=False), rng.choice(300, rng.integers(0, 8), replace=False)]).astype(np.uint64) for _ in range(40)]
        trie = J.TrieJoin(percent)
        for s in sets:
            trie.add(s[::-1].copy())
        parent = list(range(len(sets)))

        def find(a):
            while parent[a] != a:
                a = parent[a]
            return a

        as_sets = [set(s.tolist()) for s in sets]
        for i, x in enumerate(as_sets):
            for j, y in enumerate(as_sets[:i]):
                if 100 * len(x & y) >= percent * len(x | y):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
        mine, theirs = defaultdict(set), defaultdict(set)
        for k in range(len(sets)):
            mine[trie.find(k)].add(k)
            theirs[find(k)].add(k)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(-50, 50), rng.randrange(-50, 50)) for _ in range(60)] + [(k, k + 1) for k in range(100, 130)] + [(None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {a: find(a) for a in parent}
