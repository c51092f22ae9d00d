"""Toxicity by a bidirectional gated recurrent network, trained and run in numpy.

A text is a sequence of lower-cased words.  Each word's input is the embedding of
its hashed form and the mean embedding of its hashed character 1- to 5-grams,
marked at the word's ends.  Overlapping windows of ``WINDOW`` words, one every
``STRIDE``, cover the whole text.  A gated recurrent unit reads each window in
either direction, attention pools the states, and a linear layer gives the rate of
toxic matter of the window.  A text is toxic unless every window is clean, so the
loss of a text is that of the noisy-or over its windows, which lets labels of whole
texts teach windows.  A logistic calibration of the largest rate, the sum of rates
and the length, fitted on texts that the network has not seen, gives the score.

The model is fitted on the driver on at most ``PER_CLASS`` texts a class and about
``FIT_BYTES`` of text in all, seen whole and through the same windows as in scoring,
which covers all windows of every text and is a map without a shuffle.  The
broadcast model has a fixed size (two embedding tables of ``BUCKETS`` rows).  At
scoring, all that depends on a word alone is computed once for each distinct word
and kept in a bounded table of the task.

A null text scores as the empty text, which has one empty window.  One labelled text
of either class is enough to fit with; without one of each every text scores the share of
class 1 (0.0 if there are none).
``score_column`` adds a column to any DataFrame, so rows, ids and other columns,
null or repeated, pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fit_logistic, in_fold, labelled_sample, logistic, release, table

WINDOW, STRIDE = 16, 8
HIDDEN, WORD_DIM, CHAR_DIM, BUCKETS, GRAM = 8, 6, 10, 1 << 16, 5
PER_CLASS, FIT_BYTES, STEPS, BATCH_DOCS = 1200, 16 << 20, 100, 48
RATE, EMBEDDING_RATE = 0.02, 0.003
#: Standard errors beyond which a bucket's odds count, and texts below which a bucket is not learnt.
SURE, SEEN = 2.0, 2
THRESHOLD = 0.3
#: Words whose input gates a worker keeps, and windows run at a time.
CACHE_WORDS, RUN_WINDOWS = 120_000, 4096
_TRIM = ".,;:!?\"'()[]{}<>|*#$%&"


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def encode_words(listed: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's bucket, the buckets of its character n-grams word by word, and how many it has."""
    bare = [w.strip(_TRIM) for w in listed]
    hashed = xxhash.xxh32_intdigest
    buckets = np.fromiter((hashed(w) % BUCKETS for w in bare), np.int64, len(bare))
    codes = np.frombuffer("".join([f"^{w}$" for w in bare]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, bare), np.int64, len(bare)) + 2
    owner = np.repeat(np.arange(len(bare)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    h, grams, owners = np.zeros(len(codes), np.uint32), [], []
    for n in range(1, min(GRAM, len(codes)) + 1):
        h[: len(codes) - n + 1] = (h[: len(codes) - n + 1] ^ codes[n - 1 :]) * np.uint32(16777619) + np.uint32(n)
        whole = np.flatnonzero(left >= n)
        grams.append((h[whole] * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1))
        owners.append(owner[whole])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return buckets, np.concatenate(grams)[order].astype(np.int64), np.bincount(owner, minlength=len(bare))


def window_starts(n: int, stride: int = STRIDE) -> range:
    """Starts of the windows that cover ``n`` words; one for an empty text."""
    return range(0, max(1, n - WINDOW + stride), stride)


def windows_of(coded: np.ndarray) -> np.ndarray:
    """The windows of a text's word numbers, -1 past its end."""
    at = np.array(window_starts(len(coded)))[:, None] + np.arange(WINDOW)
    return np.where(at < len(coded), np.append(coded, -1)[np.minimum(at, len(coded))], -1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters by name; float32 unless asked otherwise (gradient tests)."""

    def __init__(self, seed: int = 7, dtype=np.float32):
        rng, d, h = np.random.default_rng(seed), WORD_DIM + CHAR_DIM, HIDDEN
        draw = lambda *s, k=0.1: (rng.standard_normal(s) * k).astype(dtype)
        self.p = {"words": draw(BUCKETS, WORD_DIM, k=0.05), "chars": draw(BUCKETS, CHAR_DIM, k=0.05)}
        for way in "fb":
            self.p |= {f"W{way}": draw(d, 3 * h, k=0.3), f"U{way}": draw(h, 3 * h, k=0.3), f"b{way}": np.zeros(3 * h, dtype)}
        self.p |= {"attend": draw(2 * h, k=0.3), "out": draw(2 * h, k=0.5), "bias": np.full(1, -4, dtype)}

    def gates(self, buckets: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word inputs and their input gates for both directions, row by word."""
        p = self.p
        starts = np.cumsum(sizes) - sizes
        mean = np.add.reduceat(p["chars"][grams], starts) / sizes[:, None].astype(p["chars"].dtype)
        x = np.hstack([p["words"][buckets], mean])
        return x, np.hstack([x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"]])

    def run(self, table_: np.ndarray, at: np.ndarray, keep: bool = False):
        """Window logits; ``at`` is (windows, WINDOW) rows of ``table_``, -1 past the end."""
        p, h, n = self.p, HIDDEN, len(at)
        mask = (at.T >= 0)[..., None]
        states = np.zeros((WINDOW, n, 2 * h), table_.dtype)
        kept = []
        for way, base, steps in (("f", 0, range(WINDOW)), ("b", 3 * h, range(WINDOW - 1, -1, -1))):
            U, inputs, state, trace = p[f"U{way}"], table_[:, base : base + 3 * h], np.zeros((n, h), table_.dtype), []
            for t in steps:
                x, u = inputs[at[:, t]], state @ U
                rz = _sigmoid(x[:, : 2 * h] + u[:, : 2 * h])
                r, z = rz[:, :h], rz[:, h:]
                c = np.tanh(x[:, 2 * h :] + r * u[:, 2 * h :])
                new = np.where(mask[t], c + z * (state - c), state)
                if keep:
                    trace.append((t, state, r, z, c, u[:, 2 * h :]))
                states[t, :, base // 3 : base // 3 + h] = state = new
            kept.append(trace)
        e = np.where(mask[..., 0], states @ p["attend"], -1e9)
        a = np.exp(e - e.max(0))
        a = np.where(mask[..., 0], a, 0)
        a /= a.sum(0) + 1e-9
        pooled = np.einsum("tn,tnh->nh", a, states)
        logits = pooled @ p["out"] + p["bias"]
        return (logits, (mask, states, a, pooled, kept)) if keep else logits

    def backward(self, table_: np.ndarray, at: np.ndarray, saved, d_logits: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the dense parameters and of ``table_``."""
        p, h = self.p, HIDDEN
        mask, states, a, pooled, kept = saved
        g = {"out": pooled.T @ d_logits, "bias": d_logits.sum(keepdims=True)}
        d_pooled = d_logits[:, None] * p["out"]
        d_a = np.einsum("nh,tnh->tn", d_pooled, states)
        d_e = a * (d_a - (a * d_a).sum(0))
        g["attend"] = np.einsum("tn,tnh->h", d_e, states)
        d_states = a[..., None] * d_pooled + d_e[..., None] * p["attend"]
        d_table = np.zeros_like(table_)
        for way, base, trace in (("f", 0, kept[0]), ("b", 3 * h, kept[1])):
            U = p[f"U{way}"]
            g[f"U{way}"], carry = np.zeros_like(U), np.zeros((len(at), h), table_.dtype)
            every_at, every_d = [], []
            for t, prev, r, z, c, uc in reversed(trace):
                m = mask[t]
                total = carry + d_states[t, :, base // 3 : base // 3 + h]
                d = np.where(m, total, 0)
                d_c = d * (1 - z) * (1 - c * c)
                d_z = d * (prev - c) * z * (1 - z)
                d_r = d_c * uc * r * (1 - r)
                d_u = np.hstack([d_r, d_z, d_c * r])
                g[f"U{way}"] += prev.T @ d_u
                every_at.append(at[:, t])
                every_d.append(np.hstack([d_r, d_z, d_c]))
                carry = np.where(m, d * z, total) + d_u @ U.T
            rows, d_rows = np.concatenate(every_at), np.concatenate(every_d)
            order = np.argsort(rows, kind="stable")
            rows, d_rows = rows[order], d_rows[order]
            first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            sums, rows = np.add.reduceat(d_rows, first), rows[first]
            d_table[rows[rows >= 0], base : base + 3 * h] = sums[rows >= 0]
        return g, d_table


def text_loss(logits: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Noisy-or loss over texts and its gradient by window; ``first``: each text's first window."""
    rate = np.logaddexp(0, logits)
    total = np.maximum(np.add.reduceat(rate, first), 1e-6)
    miss = np.exp(-total)
    loss = np.where(y == 1, -np.log(1 - miss + 1e-9), total).sum()
    by_text = np.where(y == 1, -miss / (1 - miss + 1e-9), 1.0)
    sizes = np.diff(np.r_[first, len(logits)])
    return float(loss), (np.repeat(by_text, sizes) * _sigmoid(logits)).astype(logits.dtype)


def evidence(features: Iterator[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By bucket: the smoothed log odds of occurring in class 1, 0 where chance explains them, and the number of texts.

    ``features`` has the buckets of one text after another.
    """
    k = np.zeros((2, BUCKETS), np.int64)
    for buckets, label in zip(features, y):
        k[label, np.unique(buckets)] += 1
    n0, n1 = np.maximum(1, np.bincount(y, minlength=2))
    k0, k1 = k
    share = (k1 + k0) / (n1 + n0)
    z = (k1 / n1 - k0 / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-6)
    odds = np.log((k1 + 1) / (n1 + 2)) - np.log((k0 + 1) / (n0 + 2))
    return np.where(np.abs(z) > SURE, np.clip(odds, -3, 3), 0.0), k1 + k0


def train(texts: list[str], y: np.ndarray, steps: int = STEPS, seed: int = 7) -> Network:
    """A network fitted on whole texts' labels by about so many Adam steps, however few texts there are.

    The first dimension of the embeddings starts as the evidence of their bucket, and buckets seen in fewer than
    ``SEEN`` texts stay at 0, since they could only teach the texts by heart.
    """
    net, rng = Network(seed), np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    coded = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words(t)], np.int64) for t in texts]
    listed = list(vocabulary) or [""]
    encoded = [encode_words(listed[k : k + 20_000]) for k in range(0, len(listed), 20_000)]  # in parts, to hold less at a time
    buckets, grams, sizes = (np.concatenate([e[k] for e in encoded]).astype(np.int32) for k in range(3))
    del encoded
    ends = np.cumsum(sizes)
    spread = lambda rows: grams[np.repeat(ends[rows] - np.cumsum(sizes[rows]), sizes[rows]) + np.arange(sizes[rows].sum())]
    live = {}
    for name, features in (("words", (buckets[c] for c in coded)), ("chars", (spread(np.unique(c)) for c in coded))):
        odds, seen = evidence(features, y)
        live[name] = (seen >= SEEN).astype(np.float32)[:, None]
        net.p[name] *= live[name]
        net.p[name][:, 0] = odds
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}

    def prepare(at: np.ndarray) -> tuple:
        """The distinct words of windows, their inputs and gates, and the windows in terms of these."""
        used, at = np.unique(at, return_inverse=True)
        at = at.reshape(-1, WINDOW)
        if used[0] == -1:
            used, at = used[1:], at - 1
        flat = spread(used)
        return used, flat, *net.gates(buckets[used], flat, sizes[used]), at

    def add_gradients(g: dict, at: np.ndarray, d_logits: np.ndarray, run: tuple | None = None) -> None:
        used, flat, x, gates, at = prepare(at) if run is None else run[0]
        saved = net.run(gates, at, keep=True)[1] if run is None else run[1]
        own, (dense, d_gates) = sizes[used], net.backward(gates, at, saved, d_logits)
        d_x = np.zeros_like(x)
        for way, base in (("f", 0), ("b", 3 * HIDDEN)):
            d = d_gates[:, base : base + 3 * HIDDEN]
            dense[f"W{way}"], dense[f"b{way}"] = x.T @ d, d.sum(0)
            d_x += d @ net.p[f"W{way}"].T
        d_char = np.repeat(d_x[:, WORD_DIM:] / own[:, None].astype(d_x.dtype), own, axis=0)
        dense["words"] = np.column_stack([np.bincount(buckets[used], d_x[:, k], BUCKETS) for k in range(WORD_DIM)]).astype(np.float32) * live["words"]
        dense["chars"] = np.column_stack([np.bincount(flat, d_char[:, k], BUCKETS) for k in range(CHAR_DIM)]).astype(np.float32) * live["chars"]
        for name, grad in dense.items():
            g[name] = g[name] + grad if name in g else grad

    step = 0
    batches = max(1, -(-len(texts) // BATCH_DOCS))
    for _ in range(max(1, round(steps / batches))):
        for part in np.array_split(rng.permutation(len(texts)), batches):
            windows = [windows_of(coded[k]) for k in part]
            at, first = np.concatenate(windows), np.cumsum([0, *map(len, windows[:-1])])
            if (at < 0).all():
                continue
            cuts, g = range(0, len(at), RUN_WINDOWS), {}
            if len(cuts) == 1:
                ready = prepare(at)
                logits, saved = net.run(ready[3], ready[4], keep=True)
                add_gradients(g, at, text_loss(logits, first, y[part])[1] / len(part), (ready, saved))
            else:  # the loss of a text needs all its windows before the gradients of any
                logits = np.concatenate([net.run(*prepare(at[c : c + RUN_WINDOWS])[3:]) for c in cuts])
                d_logits = text_loss(logits, first, y[part])[1] / len(part)
                for c in cuts:
                    add_gradients(g, at[c : c + RUN_WINDOWS], d_logits[c : c + RUN_WINDOWS])
            step += 1
            for name, grad in g.items():
                m, v = moments[name]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                rate = EMBEDDING_RATE if name in live else RATE
                net.p[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


class Scorer:
    """Runs a network over all windows of texts; keeps the gates of words seen."""

    def __init__(self, net: Network):
        self.net = net
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, 6 * HIDDEN), np.float32)

    def _code(self, listed: list[list[str]]) -> list[np.ndarray]:
        fresh = list(dict.fromkeys(w for ws in listed for w in ws if w not in self.index))
        if len(self.index) + len(fresh) > CACHE_WORDS:
            self.index = {}
            fresh = list(dict.fromkeys(w for ws in listed for w in ws))
        if fresh:
            n = len(self.index)
            if n + len(fresh) > len(self.table):
                grown = np.zeros((max(n + len(fresh), min(2 * (n + len(fresh)), CACHE_WORDS)), self.table.shape[1]), np.float32)
                grown[:n] = self.table[:n]
                self.table = grown
            for k in range(0, len(fresh), 20_000):
                part = fresh[k : k + 20_000]
                self.table[n + k : n + k + len(part)] = self.net.gates(*encode_words(part))[1]
            self.index.update(zip(fresh, range(n, n + len(fresh))))
        get = self.index.__getitem__
        return [np.fromiter(map(get, ws), np.int32, len(ws)) for ws in listed]

    def features(self, texts) -> np.ndarray:
        """(largest rate, sum of rates, length) in logarithms, one row a text."""
        out, group, held = [], [], 0
        for text in texts:
            ws = words(text)
            group.append(ws)
            held += len(ws)
            if held > 60_000:
                out.append(self._features(group))
                group, held = [], 0
        if group:
            out.append(self._features(group))
        return np.vstack(out) if out else np.zeros((0, 3))

    def _features(self, listed: list[list[str]]) -> np.ndarray:
        coded = self._code(listed)
        padded, starts, first, base = [], [], [], 0
        for c in coded:
            s = np.arange(0, max(1, len(c) - WINDOW + STRIDE), STRIDE)
            room = int(s[-1]) + WINDOW
            first.append(sum(map(len, starts)) if not starts else first[-1] + len(starts[-1]))
            padded.append(np.pad(c, (0, room - len(c)), constant_values=-1))
            starts.append(s + base)
            base += room
        flat, begins = np.concatenate(padded), np.concatenate(starts)
        logits = np.empty(len(begins), np.float32)
        span = np.arange(WINDOW)
        for k in range(0, len(begins), RUN_WINDOWS):
            logits[k : k + RUN_WINDOWS] = self.net.run(self.table, flat[begins[k : k + RUN_WINDOWS, None] + span])
        rate = np.logaddexp(0, logits.astype(np.float64))
        first = np.array(first)
        sizes = np.diff(np.r_[first, len(begins)])
        return np.column_stack([np.log(np.maximum.reduceat(rate, first) + 1e-9), np.log(np.add.reduceat(rate, first) + 1e-9), np.log(sizes)])


def fit(sample: list[tuple[int, str]], prior: dict[int, int]) -> dict:
    """The model: the network's parameters and calibration, or a constant."""
    rows = list(dict.fromkeys((t, y) for y, t in sample))
    y = np.array([c for _, c in rows])
    if len(set(y.tolist())) < 2:
        total = sum(prior.values())
        return {"constant": prior.get(1, 0) / total if total else 0.0}
    held = np.arange(len(rows)) % 4 == 3
    if len(set(y[~held].tolist())) < 2:  # too few texts to calibrate with others than are trained on
        held[:] = False
    net = train([t for (t, _), h in zip(rows, held) if not h], y[~held])
    x = Scorer(net).features([t for (t, _), h in zip(rows, held) if h])
    if len(set(y[held])) < 2:
        x, held = Scorer(net).features([t for t, _ in rows]), np.ones(len(rows), bool)
    return {"net": net.p, "calibration": fit_logistic(x, y[held], prior)}


def score_texts(texts, model: dict, scorer: Scorer | None = None) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    return logistic((scorer or make_scorer(model)).features(texts), model["calibration"])


def make_scorer(model: dict) -> Scorer | None:
    if "constant" in model:
        return None
    net = Network.__new__(Network)
    net.p = model["net"]
    return Scorer(net)


def score_column(model: dict, text_col: str = "text") -> Column:
    """The score of a text column as a Column."""

    def score(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = make_scorer(model)
        for s in series:
            yield pd.Series(score_texts([t if isinstance(t, str) else None for t in s], model, scorer), dtype="float64")
        del scorer
        release()

    score.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")(F.col(text_col))


def learn(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = PER_CLASS) -> dict:
    return fit(*labelled_sample(docs, labels, "toxic", usable, per_class, FIT_BYTES))


def op1_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; labels of fold 2 of 4 are held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = in_fold("doc_id", 4, 2)
    model = learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = docs.select("doc_id", held_out.alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


SQL: dict[str, str] = {}
QUERIES = {"op1_recurrent_toxicity": op1_recurrent_toxicity}
