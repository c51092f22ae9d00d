"""Elias-Fano sequences and tries against plain lists, and scores against plain counts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeatlas.llm import language_model as lm
from codeatlas.llm.common import in_fold
from codeatlas.llm.elias_fano import STEPS, Sequence, Trie

STEP_CASES = [[], [0], [5], [0, 0, 0], list(range(100)), [0, 1 << 40], [7] * 70 + [1 << 33] * 70]


@pytest.mark.parametrize("values", [*STEP_CASES, sorted(random.Random(2).choices(range(5000), k=3000)), sorted(random.Random(3).sample(range(1 << 45), 2000))])
def test_sequence(values):
    s = Sequence.of(np.array(values, np.int64))
    assert s.get(np.arange(len(values))).tolist() == values
    rng = random.Random(4)
    distinct = sorted(set(values))
    s, n = Sequence.of(np.array(distinct, np.int64)), len(distinct)
    asks = [(rng.choice(distinct) + rng.choice((-1, 0, 0, 1)), *sorted((rng.randint(0, n), rng.randint(0, n)))) for _ in range(500)] if n else [(0, 0, 0)]
    asks = [(max(0, v), a, b) for v, a, b in asks] + [(1 << 50, 0, n), (0, 0, n)]
    got, hit = s.find(*(np.array(c, np.int64) for c in zip(*asks)))
    want = [next((i for i in range(a, b) if distinct[i] >= v), max(a, b)) for v, a, b in asks]
    assert got.tolist() == want and hit.tolist() == [i < b and distinct[i] == v for i, (v, a, b) in zip(want, asks)]


def test_sequence_is_small():
    values = np.sort(np.random.default_rng(0).integers(0, 1 << 30, 100_000))
    s = Sequence.of(values)
    assert 8 * sum(a.nbytes for a in s.parts()) / len(values) < 2 + math.log2((1 << 30) / len(values)) + 2


def test_trie(tmp_path):
    rng = random.Random(6)
    grams = {(rng.randint(0, 8) ** 2, rng.randint(0, 6) * 11, rng.randint(0, 1 << 34) if rng.random() < 0.2 else rng.randint(0, 9)): rng.randint(0, 60_000) for _ in range(600)}  # (v, u, w)
    pair = {(v, w): (v + w) % 997 for v, _, w in grams}
    context = {(v, u): v + u for v, u, _ in grams}
    columns = lambda d, last: (*(np.array(c) for c in zip(*sorted(d))), np.array([d[k] for k in sorted(d)]))
    number = {k: i for i, k in enumerate(sorted(pair))}
    v, u, w, code = columns(grams, 1)
    built = Trie.build(columns(pair, 1), columns(context, 1), (v, u, np.array([number[k] for k in zip(v.tolist(), w.tolist())]), code))
    path = str(tmp_path / "t.trie")
    built.save(path)
    asks = list(grams) + [(rng.randint(0, 70), rng.randint(0, 70), rng.randint(0, 10)) for _ in range(2000)]
    v, u, w = (np.array(c) for c in zip(*asks))
    for trie in (built, Trie.open(path, unlink=True)):
        got = [x.tolist() for x in trie.query(u, v, w)]
        assert got == [[pair.get((a, c), -1) for a, _, c in asks], [context.get((a, b), -1) for a, b, _ in asks], [grams.get(k, -1) for k in asks]]
    assert not (tmp_path / "t.trie").exists() and built.size() < 24 * len(grams) + 2000


def plain_scores(docs, modulus=7, remainder=2):
    """(id, held out, tokens, known, training tokens, base, steps) of every text by dictionaries."""
    held = [i is not None and zlib.crc32(str(i).encode()) % modulus == remainder for i, _ in docs]
    texts = [lm.tokens(None if t is None else t.encode()) for _, t in docs]
    grams = [[(([b"", b""] + x)[k], ([b"", b""] + x)[k + 1], x[k]) for k in range(len(x))] for x in texts]
    c1, c2, c3, ctx = Counter(), Counter(), Counter(), Counter()
    for g, h in zip(grams, held):
        if not h:
            for u, v, w in g:
                c1[w] += 1
                c2[v, w] += 1
                c3[u, v, w] += 1
                ctx[u, v] += 1
    n, types = sum(c1.values()), len(c1)
    code = lambda p: round(-STEPS * math.log10(p))

    def joined(c, context, lower, mu):
        if c:
            return code((c + mu * 10 ** (-lower / STEPS)) / (context + mu))
        return (code(mu / (context + mu)) if context else 0) + lower

    out = []
    for (i, _), h, g in zip(docs, held, grams):
        steps = sum(joined(c3[k], ctx[k[:2]], joined(c2[k[1:]], c1[k[1]], code((c1[k[2]] + 1) / (n + types + 1)), lm.MU2), lm.MU3) for k in g)
        out.append((i, h, len(g), sum(c1[w] > 0 for _, _, w in g), n, sum(math.log10((c1[w] + 1) / (n + types + 1)) for _, _, w in g), steps))
    return out


def check(df, docs, **how):
    held = in_fold("doc_id", 7, 2)
    got = lm.score_texts(df, ~held, **how).select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:5], r[6])
    want = sorted([(*r[:6], -r[6] / STEPS) for r in plain_scores(docs)], key=order)
    got = sorted(map(tuple, got), key=order)
    assert [r[:5] + r[6:] for r in got] == [r[:5] + r[6:] for r in want]
    assert all(math.isclose(a[5], b[5], rel_tol=1e-12, abs_tol=1e-9) for a, b in zip(got, want))
    return got


def test_edge_texts(spark, docs, pairs):
    got = check(docs, pairs)
    assert len(got) == len(pairs)


def test_shards_and_hot_words_change_nothing(spark, tmp_path):
    """A third of all tokens are one word, another pair is common, and shards are from one (all words of weight are hot) to many."""
    rng = random.Random(8)
    words = ["the"] * 40 + ["of", "a"] * 8 + [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(150)]
    docs += [(500 + k, "the of the of " * 20) for k in range(20)] + [(600, "the " * 500), (601, ""), (602, None), (None, "the the of"), (3, "a new a"), docs[0]]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(i, t, 1, "x", 0) for i, t in docs], "doc_id long, text string, n long, words string, row long").repartition(5).write.parquet(path)
    df = spark.read.parquet(path)
    for shards in (1, 4, 90):
        check(df, docs, shards=shards)


def test_pieces_keep_their_context(spark, docs, pairs, monkeypatch):
    """Blocks of few bytes and pieces of few tokens number differently but carry the same trigrams."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int64()), pa.array([True] * len(pairs)), pa.array([t and t.encode() for _, t in pairs], pa.binary())], ["a", "b", "c"])

    def trigrams(**how):
        out = Counter()
        for _, b in lm.blocks(iter([batch]), 3, **how):
            u, v, w, piece = lm._trigrams(b)
            out.update((b.rows[p], b.words[x], b.words[y], b.words[z]) for x, y, z, p in zip(u.tolist(), v.tolist(), w.tolist(), piece.tolist()))
        return out

    assert trigrams() == trigrams(block_bytes=200, piece=7) == trigrams(block_bytes=1, piece=1)


def test_messages():
    arrays = [np.array([], np.int64), np.array([0, 255]), np.array([256]), np.array([1 << 40, 3]), np.array([0.5, -2.0])]
    assert [a.tolist() for a in lm.unpack(lm.pack(*arrays))] == [a.tolist() for a in arrays]


def test_probabilities_add_up():
    """Over all words and one unseen, of a context that is known and one that is not."""
    c1 = {b"a": 5, b"b": 3, b"": 2}
    n, types = 10, 3
    first = lambda c: (c + 1) / (n + types + 1)
    assert math.isclose(sum(map(first, c1.values())) + first(0), 1)
    counts, context = np.array([2, 1, 0, 0]), 3
    lower = lm.first_code(np.array([5, 3, 2, 0]), n, types)
    assert abs(np.power(10.0, -lm.joined_code(counts, np.full(4, context), lower, lm.MU2) / STEPS).sum() - 1) < 2e-3


def test_nothing(spark, empty):
    assert lm.score_texts(empty, F.lit(True)).collect() == []


def test_nothing_to_learn_from(spark, docs, pairs):
    got = lm.score_texts(docs, F.lit(False)).collect()
    assert len(got) == len(pairs) and all(r["score"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 for r in got)


def test_words_of_arrays_are_those_of_single_texts():
    """Six bytes are space, A-Z alone have lower case, and bytes that are no UTF-8 stay as they are."""
    import pyarrow as pa

    texts = [b" a  B\xff ", b"", b"x\x0b\x0cY\x1cz\xc2\xa0Q\n\n", None, b"   ", "ÄÖ É ß A B".encode(), b"\x00 \x85", b"one"]
    arrays = pa.array(texts, pa.binary())
    for a, t in ((arrays, texts), (arrays.slice(2, 4), texts[2:6]), (arrays.slice(1, 1), texts[1:2])):
        words, sizes = lm._words(a)
        want = [lm.tokens(x)[:-1] for x in t]
        assert sizes.tolist() == list(map(len, want))
        assert lm._listed(words) == [w for ws in want for w in ws] == words.to_pylist()
