"""Quality by compression.

Two zstandard dictionaries are trained, one on texts labelled good and one on texts
labelled bad.  A text is cut into blocks of 512 bytes, all of them, and each block
is compressed under either dictionary on its own, so that the dictionary and not
the text's own past decides.  Per byte, the difference of the two sizes says which
class a text resembles.  A logistic calibration of it, which also knows how long the
text is and how well it compresses (one word repeated does so under both), fitted on
labelled texts that the dictionaries have not seen, gives the score.

The model is fitted on at most ``PER_CLASS`` texts a class and about ``FIT_BYTES``
of text in all, every block of which takes part; scoring covers every byte of every
text and is a map without a shuffle.  The broadcast model is the two dictionaries,
``DICT_BYTES`` each at most.

A null text scores as the empty text, which has all sizes 0.  One labelled text of
either class is enough to fit with, and then serves for dictionary and calibration; without
one of each every text scores the share of class 1 (1.0 if there are none).
``score_column`` adds a column to any DataFrame, so rows, ids and other columns,
null or repeated, pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fit_logistic, in_fold, labelled_sample, logistic, release, table

PER_CLASS = 1600
FIT_BYTES = 16 << 20
DICT_BYTES = 64 << 10
BLOCK = 512
LEVEL = 3
THRESHOLD = 0.3


def blocks(raw: bytes) -> list[bytes]:
    return [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)]


def build_dictionary(texts: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary, or plain content, blocks at even distances over all texts, where there is too little to train on."""
    samples = [b for t in texts for b in blocks(t)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        fit = max(1, size // BLOCK)
        return b"".join(samples if len(samples) <= fit else [samples[k * len(samples) // fit] for k in range(fit)])[:size]


class Compressors:
    """Sizes of a text under the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.pair = []
        for content in (good, bad):
            trained = content[:4] == b"\x37\xa4\x30\xec"  # the format's magic number
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(LEVEL)
            self.pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, text: str | None) -> list[float]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        parts, n = blocks(raw), max(64, len(raw))  # a few bytes say little
        good, bad = (sum(len(c.compress(p)) for p in parts) / n for c in self.pair)
        d = bad - good
        return [d, d * d, d * float(np.log1p(len(raw))), d * good, good]


def fit(sample: list[tuple[int, str]], prior: dict[int, int]) -> dict:
    """The model as plain values: dictionaries and calibration, or a constant."""
    seen, rows = set(), []
    for y, t in sample:  # copies would sit on both sides of the split
        if t not in seen:
            seen.add(t)
            rows.append((y, t.encode("utf-8", "surrogatepass")))
    by = {y: [t for c, t in rows if c == y] for y in (0, 1)}
    if not by[0] or not by[1]:
        total = sum(prior.values())
        return {"constant": prior.get(1, 0) / total if total else 1.0}
    good, bad = build_dictionary(by[1][::2]), build_dictionary(by[0][::2])
    compressors = Compressors(good, bad)
    held = [(y, t) for y in (1, 0) for t in by[y][1::2] or by[y]]  # a single text of a class serves for both
    x = np.array([compressors.features(t.decode("utf-8", "surrogatepass")) for _, t in held])
    return {"good": good, "bad": bad, "calibration": fit_logistic(x, np.array([y for y, _ in held]), prior)}


def score_texts(texts, model: dict, compressors: Compressors | None = None) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    compressors = compressors or Compressors(model["good"], model["bad"])
    x = np.array([compressors.features(t) for t in texts]).reshape(len(texts), 5)
    return logistic(x, model["calibration"])


def score_column(model: dict, text_col: str = "text") -> Column:
    """The score of a text column as a Column."""

    def score(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compressors = None if "constant" in model else Compressors(model["good"], model["bad"])
        for s in series:
            yield pd.Series(score_texts([t if isinstance(t, str) else None for t in s], model, compressors), dtype="float64")
        del compressors
        release()

    score.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")(F.col(text_col))


def learn(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = PER_CLASS) -> dict:
    return fit(*labelled_sample(docs, labels, "quality", usable, per_class, FIT_BYTES))


def op4_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document; labels of fold 0 of 5 are held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = in_fold("doc_id", 5, 0)
    model = learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = docs.select("doc_id", held_out.alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


SQL: dict[str, str] = {}
QUERIES = {"op4_compression_quality": op4_compression_quality}
