"""Toxicity and quality: gradients, held-out accuracy, odd rows."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from codeatlas.llm import quality as Q
from codeatlas.llm import toxicity as X
from codeatlas.llm.common import fit_logistic, in_fold, labelled_sample, logistic

SF = "/root/testdata/sf0.01"


def made(n, bad, seed):
    """Texts of invented words; those of class 1 hold words of a family that others lack."""
    rng = random.Random(seed)
    syllables = ["ta", "ro", "mi", "ken", "sol", "ur", "ba", "li"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    out = []
    for k in range(n):
        ws = [word() for _ in range(rng.randrange(30, 90))]
        if k % 2:
            for _ in range(3):
                ws[rng.randrange(len(ws))] = bad + rng.choice(syllables)
        out.append((k % 2, " ".join(ws)))
    return out


def test_gradients():
    net = X.Network(1, np.float64)
    rng = np.random.default_rng(0)
    buckets, grams, sizes = X.encode_words(["ab", "abc", "xyz", "longer", "ab"])
    _, table = net.gates(buckets, grams, sizes)
    at = rng.integers(0, 5, (4, X.WINDOW))
    at[1, 9:], at[3, :] = -1, -1
    first, y = np.array([0, 2]), np.array([1, 0])
    loss = lambda: X.text_loss(net.run(table, at), first, y)[0]
    logits, saved = net.run(table, at, keep=True)
    _, d = X.text_loss(logits, first, y)
    g, d_table = net.backward(table, at, saved, d)
    for name, grad in [*((k, g[k]) for k in ("Uf", "Ub", "attend", "out", "bias")), ("table", d_table)]:
        values = table if name == "table" else net.p[name]
        for _ in range(6):
            where = tuple(rng.integers(0, s) for s in values.shape)
            old = values[where]
            values[where] = old + 1e-6
            up = loss()
            values[where] = old - 1e-6
            down = loss()
            values[where] = old
            assert abs((up - down) / 2e-6 - grad[where]) < 1e-4, (name, where)


def test_windows_cover_everything():
    for n in (0, 1, X.WINDOW, X.WINDOW + 1, 100, 101):
        seen = {w for s in X.window_starts(n) for w in range(s, s + X.WINDOW)}
        assert seen >= set(range(n)) and len(X.window_starts(n)) >= 1


def plain_toxicity(text, model):
    """A text's score window by window and step by step, without tables, batches or caches."""
    p, h, ws = model["net"], X.HIDDEN, X.words(text)
    sig = lambda v: 1 / (1 + np.exp(-v))
    rates = []
    for s in X.window_starts(len(ws)):
        part, states = ws[s : s + X.WINDOW], {}
        xs = []
        for w in part:
            buckets, grams, _ = X.encode_words([w])
            xs.append(np.r_[p["words"][buckets[0]], p["chars"][grams].mean(0)].astype(np.float64))
        for way, order in (("f", range(len(part))), ("b", range(len(part) - 1, -1, -1))):
            state = np.zeros(h)
            for t in order:
                gate, u = xs[t] @ p[f"W{way}"] + p[f"b{way}"], state @ p[f"U{way}"]
                r, z = sig(gate[:h] + u[:h]), sig(gate[h : 2 * h] + u[h : 2 * h])
                c = np.tanh(gate[2 * h :] + r * u[2 * h :])
                state = c + z * (state - c)
                states[way, t] = state
        if part:
            both = np.array([np.r_[states["f", t], states["b", t]] for t in range(len(part))])
            e = np.exp(both @ p["attend"] - (both @ p["attend"]).max())
            pooled = (e / e.sum()) @ both
        else:
            pooled = np.zeros(2 * h)
        rates.append(np.logaddexp(0, float(pooled @ p["out"] + p["bias"][0])))
    return float(logistic(np.array([[np.log(max(rates) + 1e-9), np.log(sum(rates) + 1e-9), np.log(len(rates))]]), model["calibration"])[0])


def test_scores_are_those_of_plain_windows():
    model = X.fit(made(120, "grum", 1), {0: 60, 1: 60})
    texts = [t for _, t in made(6, "grum", 4)] + ["", "one", "Shouted, WORDS! (in) brackets", "w " * 40, " ".join(f"w{k}" for k in range(X.WINDOW + X.STRIDE + 1))]
    assert np.allclose(X.score_texts(texts, model), [plain_toxicity(t, model) for t in texts], atol=1e-4)


def test_compressed_sizes_are_those_of_plain_blocks():
    """Every block by itself, with a compressor of its own."""
    import zstandard

    good, bad = (Q.build_dictionary([t.encode() for _, t in made(300, "x", seed)]) for seed in (3, 4))
    compressors = Q.Compressors(good, bad)
    for text in ["", "short", made(1, "x", 9)[0][1], "long text " * 500, "é" * 700]:
        raw, sizes = text.encode(), []
        for content in (good, bad):
            d = zstandard.ZstdCompressionDict(content)
            one = lambda block: zstandard.ZstdCompressor(level=Q.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(block)  # noqa: E731, B023
            sizes.append(sum(len(one(raw[k : k + Q.BLOCK])) for k in range(0, len(raw), Q.BLOCK)) / max(64, len(raw)))
        d = sizes[1] - sizes[0]
        assert np.allclose(compressors.features(text), [d, d * d, d * np.log1p(len(raw)), d * sizes[0], sizes[0]])


def test_fitting_sees_whole_texts():
    """What tells the classes apart lies far behind the beginning of every text."""
    rng = random.Random(5)
    filler = lambda: " ".join(rng.choice(["ta", "ro", "mi", "ken"]) + str(rng.randrange(30)) for _ in range(1500))
    texts = [(k % 2, filler() + (" grumzol grumzol" if k % 2 else " plainly so")) for k in range(64)]
    model = X.fit(texts, {0: 32, 1: 32})
    tests = [filler() + end for end in (" grumzol grumzol", " plainly so") for _ in range(5)]
    scores = X.score_texts(tests, model)
    assert scores[:5].min() > scores[5:].max()
    junk = lambda: "".join(rng.choice("#%&$!") for _ in range(4000))
    rows = [(1, filler() + filler()) for _ in range(40)] + [(0, filler() + junk()) for _ in range(40)]
    model = Q.fit(rows, {0: 40, 1: 40})
    scores = Q.score_texts([filler() + filler(), filler() + junk()], model)
    assert scores[0] > 0.5 > scores[1]


def test_toxicity_learns_a_word_family():
    model = X.fit(made(240, "grum", 1), {0: 120, 1: 120})
    test = made(80, "grum", 2)
    p = X.score_texts([t for _, t in test], model) >= 0.5
    assert np.mean(p == np.array([y for y, _ in test])) >= 0.95
    # The one bad word counts wherever it stands, and batching does not matter.
    clean = test[0][1]
    long = [clean + " " + clean * 30 + " grumta", clean]
    both = X.score_texts(long, model)
    assert both[0] > both[1] and np.allclose(both, [X.score_texts([t], model)[0] for t in long], atol=1e-5)
    assert np.all((X.score_texts(["", None, "a", "!" * 50], model) >= 0) & (X.score_texts(["", None, "a", "!" * 50], model) <= 1))


def test_quality_learns():
    good, bad = made(200, "x", 3), [(0, " ".join(w.upper() + "!!" for w in t.split())) for _, t in made(200, "x", 4)]
    sample = [(1, t) for _, t in good] + bad
    model = Q.fit(sample, {0: 200, 1: 200})
    test = [(1, t) for _, t in made(40, "x", 5)] + [(0, " ".join(w.upper() + "!!" for w in t.split())) for _, t in made(40, "x", 6)]
    p = Q.score_texts([t for _, t in test], model) >= 0.5
    assert np.mean(p == np.array([y for y, _ in test])) >= 0.95
    assert np.all(np.isfinite(Q.score_texts(["", None, "a", "b" * 100_000], model)))


@pytest.mark.parametrize("module", [X, Q])
def test_without_labels(module):
    assert set(module.score_texts(["a", None], module.fit([], {}))) == {0.0 if module is X else 1.0}
    assert set(module.score_texts(["a"], module.fit([(1, "x")] * 3, {1: 3, 0: 1}))) == {0.75}


@pytest.mark.parametrize("module", [X, Q])
def test_columns_pass_through(docs, empty, module):
    model = module.fit(made(60, "grum", 7), {0: 30, 1: 30})
    scored = docs.withColumn("s", module.score_column(model))
    assert scored.drop("s").schema == docs.schema and scored.filter("s between 0 and 1").count() == docs.count()
    assert empty.withColumn("s", module.score_column(model)).count() == 0
    same = scored.filter("doc_id = 5").select("s").collect()
    assert len({r[0] for r in same}) == 1


def test_sample_is_bounded_and_leaves_the_fold_out(spark, docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 21)] + [(None, 1), (3, 0), (4, 0)], "doc_id long, toxic int")
    usable = ~in_fold("doc_id", 4, 2)
    rows, counts = labelled_sample(docs, labels, "toxic", usable, 3, 1 << 20)
    assert len(rows) <= 6 + 1 and set(counts) <= {0, 1}
    every, _ = labelled_sample(docs, labels, "toxic", usable, 100, 1 << 30)
    texts = {r["text"] for r in docs.collect()}
    assert {t for _, t in every} <= texts  # whole
    some, _ = labelled_sample(docs, labels, "toxic", usable, 100, 500)
    assert some == every[: len(some)] and sum(len(t.encode()) for _, t in some[:-1]) < 500  # ends with the row that passes the bound
    assert labelled_sample(docs, labels.filter("doc_id = 3"), "toxic", usable, 9, 99) == ([], {})  # both labels


def test_logistic_weights():
    x = np.random.default_rng(0).standard_normal((400, 2))
    y = (x[:, 0] + 0.3 * np.random.default_rng(1).standard_normal(400) > 0).astype(int)
    assert np.mean((logistic(x, fit_logistic(x, y, {0: 1, 1: 1})) > 0.5) == y) > 0.9


def measures(frame, held):
    """Recall, precision and the area under the curve, which no constant reaches."""
    y, p, score = held["label"].to_numpy(), held["predicted"].to_numpy(), held["score"].to_numpy()
    pairs = score[y == 1][:, None] - score[y == 0][None, :]
    hits = int(((p == 1) & (y == 1)).sum())
    return hits / (y == 1).sum(), hits / max(1, (p == 1).sum()), ((pairs > 0).mean() + 0.5 * (pairs == 0).mean())


def held_out(frame, label):
    labels = duckdb.sql(f"select doc_id, {label} as label from '{SF}/labels.parquet'").df()
    assert list(frame.columns) == ["doc_id", "held_out", "score", "predicted"] and len(frame) == 1000
    assert ((frame["score"] >= 0.3) == (frame["predicted"] == 1)).all() and frame["score"].between(0, 1).all()
    return frame[frame["held_out"]].merge(labels, on="doc_id")


def test_quality_of_held_out_documents(spark):
    frame = Q.op4_compression_quality(spark, SF).toPandas()
    held = held_out(frame, "quality")
    recall, precision, area = measures(frame, held)
    assert recall > 0.97 and precision > 0.93 and area > 0.99
    assert ((held["predicted"] == 0) & (held["label"] == 0)).sum() >= 8  # of eleven bad ones
    import zlib

    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(frame["doc_id"], frame["held_out"]))


def test_toxicity_of_held_out_documents(spark):
    frame = X.op1_recurrent_toxicity(spark, SF).toPandas()
    recall, precision, area = measures(frame, held_out(frame, "toxic"))
    assert recall > 0.55 and precision > 0.7 and area > 0.88  # learnt from 37 toxic texts


def test_fold(spark):
    import zlib

    rows = spark.range(50).select("id", in_fold("id", 4, 2).alias("h")).collect()
    assert all((zlib.crc32(str(r["id"]).encode()) % 4 == 2) == r["h"] for r in rows)
    assert spark.range(1).select(F.lit(None).cast("long").alias("i")).select(in_fold("i", 4, 2)).first()[0] is False
