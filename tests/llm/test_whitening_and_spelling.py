"""Merged covariances against plain ones, and spelling groups against all pairs."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeatlas.llm import spelling, whitening

VECTORS = "vec_id long, embedding array<double>, n long, component int, x string"


def table_of(spark, tmp_path, rows, schema, parts=3):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


def plain_whitening(rows, k):
    """Deviations, projections and shares by one covariance of the distinct grid vectors."""
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    grid = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in usable]
    out = []
    for size in {len(x) for _, x in grid}:
        fit = np.array(sorted({x for _, x in grid if len(x) == size}), dtype=float)
        n, s = len(fit), [int(v) for v in fit.sum(0)]
        z = fit - fit.mean(0)
        values, axes = np.linalg.eigh(z.T @ z / n)
        values, axes = values[::-1], axes[:, ::-1]
        for i, x in grid:
            if len(x) == size:
                deviation = sum((n * a - b) ** 2 for a, b in zip(x, s))
                for c in range(min(k, size)):
                    out.append((i, c + 1, n, deviation, abs((np.array(x) - fit.mean(0)) @ axes[:, c]) / math.sqrt(values[c]) if values[c] > 1e-9 else None, values[c] / values.sum() if values.sum() > 0 else None))
    return out


def close(a, b):
    return a is None and b is None or a is not None and b is not None and math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-7)


def rows_of(rng, n, d):
    scale = [3.0 / (j + 1) for j in range(d)]
    return [(i, [rng.gauss(0, scale[j]) for j in range(d)]) for i in range(n)]


def test_whitening_against_plain(spark, tmp_path):
    rng = random.Random(5)
    rows = rows_of(rng, 300, 7)
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # a vector that a third of the rows repeat counts once
    rows += [(0, rows[0][1]), (None, rows[3][1]), (2000, None), (2001, [1.0, None] + [0.0] * 5), (2002, [float("nan")] * 7), (2003, [float("inf")] + [0.0] * 6), (2004, []), (2005, [-1e-9] * 7), (2006, [0.0] * 6 + [-0.0])]
    df = table_of(spark, tmp_path, [(i, v, 1, 2, "x") for i, v in rows], VECTORS)
    got = whitening.whitened(df).collect()
    want = plain_whitening(rows, 4)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want) > 2000
    for g, w in zip(got, want):
        assert tuple(g)[:3] == w[:3] and int(g["deviation"]) == w[3]
        assert close(abs(g["whitened"]), w[4]) and close(g["explained"], w[5]) and 0 <= g["identity_error"] < 1e-9
    first = {r["component"]: r["whitened"] for r in got if r["vec_id"] == 0}
    assert all(r["whitened"] == first[r["component"]] for r in got if (r["vec_id"] or 0) >= 1000 and r["vec_id"] < 1200)


def test_merge_of_any_split():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(1e6, 3, (200, 5))).astype("i8")
    whole = whitening.state(x)
    for at in (1, 7, 100, 199):
        s = whitening.merge(whitening.state(x[:at]), whitening.state(x[at:]))
        assert s.n == 200 and s.sums == whole.sums == [int(v) for v in x.sum(0)]
        assert np.allclose(s.scatter, whole.scatter, rtol=1e-9) and np.allclose(s.mean, whole.mean)


def test_deviations_stay_exact_beyond_64_bits():
    x = np.array([[3_000_000_000, -7], [5, 11]], "i8")
    m = whitening.Whitening(10**12, [10**20, -3], np.zeros(2), np.eye(2), np.ones(2), 2.0)
    assert m.deviations(x) == [sum((10**12 * int(a) - s) ** 2 for a, s in zip(r, [10**20, -3])) for r in x]


def test_whitening_lengths_and_no_variance(spark, tmp_path):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [0.5]), (4, [1.5]), (5, [1.0, 0.0, 0.0]), (6, [0.0, 0.0, 1.0])]
    got = {(r["vec_id"], r["component"]): r for r in whitening.whitened(table_of(spark, tmp_path, [(i, v, 0, 0, "") for i, v in rows], VECTORS)).collect()}
    assert len(got) == 2 * 2 + 2 * 1 + 2 * 3
    assert got[1, 1]["whitened"] is None and got[1, 1]["explained"] is None and got[1, 1]["deviation"] == 0 and got[1, 1]["identity_error"] == 0
    assert {abs(got[3, 1]["whitened"]), abs(got[4, 1]["whitened"])} == {1.0} and got[3, 1]["n"] == 2
    assert abs(got[5, 1]["whitened"]) == pytest.approx(1) and got[5, 2]["whitened"] is None and got[5, 1]["explained"] == pytest.approx(1)


def test_whitening_of_nothing(spark, tmp_path):
    assert whitening.whitened(table_of(spark, tmp_path, [], VECTORS)).collect() == []


DOCS = "doc_id long, text string, n long, word string, form string"
LETTERS = "abcé"


def plain_words(docs):
    n = Counter()
    for i, text in docs:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def plain_variants(docs):
    words = plain_words(docs)
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v)) for w in words if near[w]}
    form = {w: v for w, v in best.items() if words[v] >= 2 * words[w]}
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


def variants(spark, tmp_path, docs):
    df = table_of(spark, tmp_path, [(i, t, 1, "w", None) for i, t in docs], DOCS)
    words = spelling.written(spelling.word_counts(df), "t")
    return [tuple(r) for r in spelling.variant_groups(words).select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_variants_against_all_pairs(spark, tmp_path):
    rng = random.Random(9)
    pool = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(5, 7))) for _ in range(400)]
    weights = [1 / (k + 1) for k in range(len(pool))]
    docs = [(k, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(pool, weights, k=200)) + "×÷ÀÉ.") for k in range(60)]
    docs += [(None, "aaaaa aaaab aaaab"), (None, None), (3, ""), docs[0], docs[0], (7, "word, " * 30_000), (8, "wordy wordé " * 5)]
    got = variants(spark, tmp_path, docs)
    want = plain_variants(docs)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(w[1] and w[2] != w[1] for w in want) and any(w[4] > 3 for w in want)  # chains, and groups of several


def test_chain_of_forms(spark, tmp_path):
    """Each word twice as frequent as the one before, all in one chain of replacements and one insertion."""
    chain = ["aaaaaa", "baaaaa", "bbaaaa", "bbbaaa", "bbbbaa", "bbbbba", "bbbbbba"]
    docs = [(k, " ".join([w] * (3 * 2**j))) for j, w in enumerate(chain) for k in (10_000 * j + next(i for i in range(1000) if zlib.crc32(f"{10_000 * j + i}:{w}".encode()) % 97),)]
    got = {r[0]: r for r in variants(spark, tmp_path, docs)}
    assert len(got) == 7 and {r[2] for r in got.values()} == {"bbbbbba"} and got["aaaaaa"][1] == "baaaaa" and got["bbbbbba"][1] is None
    assert set(got.values()) == plain_variants(docs)


def test_variants_of_nothing(spark, tmp_path):
    assert variants(spark, tmp_path, []) == []
