"""Spans over texts: gaps, runs, elementary ranges, tokens and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import guid_literals

#: Letters of the Latin script that words of the documents are made of.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


def fill_gaps(spans: DataFrame, doc: str, length: str, *keep: str) -> DataFrame:
    """Spans (start, len) and the gaps around them, which together cover each text once; ``keep`` are columns of spans that gaps have not.

    The length is the same on all spans of a text.  Spans are sorted once: each brings the gap before it, and the last of a text the one behind.
    """
    w = Window.partitionBy(doc).orderBy("start", "len")
    end = F.col("start") + F.col("len")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    s = spans.withColumn("before", F.coalesce(F.lag(end).over(w), F.lit(0))).withColumn("last", F.max(end).over(so_far)).withColumn("more", F.lead(F.lit(True)).over(w))
    number = s.select((F.col("before") + F.col("start") + F.col("len") + F.col("last") + F.col(length)).alias("n")).schema["n"].dataType
    types = {c: s.schema[c].dataType for c in keep}

    def piece(start, n, gap):
        kept = [(F.lit(None).cast(types[c]) if gap else F.col(c)).alias(c) for c in keep]
        return F.struct(start.cast(number).alias("start"), n.cast(number).alias("len"), F.lit(gap).alias("gap"), *kept)

    before, last, total = F.col("before"), F.col("last"), F.col(length)
    inner = F.when(F.col("start") > before, piece(before, F.col("start") - before, True))
    tail = F.when(F.col("more").isNull() & (total > last), piece(last, total - last, True))
    return s.select(doc, F.inline(F.array_compact(F.array(piece(F.col("start"), F.col("len"), False), inner, tail))))


def merge_runs(spans: DataFrame, doc: str, mergeable: str, order: str = "start", *keep: str) -> DataFrame:
    """Neighbouring mergeable spans as one; others stay alone.  ``keep`` are columns of the first span of each run.

    Everything is a running value over one order, taken at the last span of a run, so a text's spans are sorted once and nothing is grouped.
    """
    w = Window.partitionBy(doc).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    flagged = spans.withColumn("m", F.col(mergeable))
    breaks = F.when(F.col("m") & F.coalesce(F.lag("m").over(w), F.lit(False)), 0).otherwise(1)
    broken = flagged.withColumn("b", breaks).withColumn("row", F.row_number().over(w))
    first = F.last(F.when(F.col("b") == 1, F.struct("row", *keep)), ignorenulls=True).over(so_far)
    island = broken.withColumn("island", F.sum("b").over(so_far)).withColumn("first", first).withColumn("next", F.lead("b").over(w))
    # Islands rise, so the greatest pair so far is that of the greatest value within the last one.
    low = F.max(F.struct("island", (-F.col("start")).alias("at"))).over(so_far)["at"]
    high = F.max(F.struct("island", (F.col("start") + F.col("len")).alias("end"))).over(so_far)["end"]
    runs = island.withColumn("low", -low).withColumn("high", high).filter("next is null or next = 1")
    merged = (F.col("row") - F.col("first")["row"] + 1).cast("long")
    return runs.select(doc, "island", F.col("low").alias("start"), (F.col("high") - F.col("low")).alias("len"), merged.alias("merged"), *(F.col("first")[c].alias(c) for c in keep))


def drop_repeats(spans: DataFrame, doc: str) -> DataFrame:
    """Without spans equal to the one before."""
    w = Window.partitionBy(doc).orderBy("start", "len")
    same = (F.lag("start").over(w) == F.col("start")) & (F.lag("len").over(w) == F.col("len"))
    return spans.withColumn("_same", F.coalesce(same, F.lit(False))).filter("not _same").drop("_same")


def elementary(spans: DataFrame, doc: str) -> DataFrame:
    """Spans cut at all bounds of the others of their text, each piece once."""
    bounds = spans.select(doc, F.explode(F.array("start", F.col("start") + F.col("len"))).alias("at")).distinct()
    w = Window.partitionBy(doc).orderBy("at")
    pieces = bounds.withColumn("next", F.lead("at").over(w)).filter("next is not null")
    # A running balance of what opens and closes tells which pieces lie in a span.
    change = spans.select(doc, F.col("start").alias("at"), F.lit(1).alias("d")).unionAll(spans.select(doc, (F.col("start") + F.col("len")).alias("at"), F.lit(-1).alias("d")))
    balance = change.groupBy(doc, "at").agg(F.sum("d").alias("d")).withColumn("depth", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return pieces.join(balance, [doc, "at"]).filter("depth > 0").select(doc, F.col("at").alias("start"), (F.col("next") - F.col("at")).alias("len"))


def line_starts(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Lines with number (from 0), start offset, and text; breaks are LF."""
    rows = docs.select(doc, F.posexplode(F.split(text, "\n")).alias("line", "line_text"))
    w = Window.partitionBy(doc).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.length("line_text") + 1).over(w), F.lit(0)))


def token_references(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Words with the line and number of their occurrences there."""
    lines_ = docs.select(doc, F.posexplode(F.split(text, "\n")).alias("line", "line_text"))
    words = lines_.select(doc, "line", F.explode(F.regexp_extract_all("line_text", F.lit(f"([{LETTERS}]+)"), F.lit(1))).alias("word"))
    return words.groupBy("word", doc, "line").agg(F.count(F.lit(1)).alias("n"))


def token_counts(docs: DataFrame, text: str) -> DataFrame:
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit(f"([{LETTERS}]+)"), F.lit(1))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def guid_references(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.select(doc, F.explode(guid_literals(F.col(text))).alias("guid")).groupBy("guid").agg(F.count(F.lit(1)).alias("n"))


def too_large(lines_: int = 30_000, xml_chars: int = 1_000_000):
    """Conditions beyond which a document is shown without classes: (lines, characters of XML)."""
    return F.col("lines") > lines_, F.col("chars") > xml_chars


def blame(lines_: DataFrame, hunks: DataFrame) -> DataFrame:
    """Lines with the commit that a hunk begins on them."""
    return lines_.join(hunks, ["path", "line"], "left")
