"""Spelling variants of words, by wildcard groups instead of pairs.

Two words are near if they differ by exactly one replaced, deleted or inserted code
point.  No pair of words is ever formed to find that out:

* Replacements.  A word of length L is in L groups, one for each position, of the words
  that agree with it before and behind that position.  A group keeps its size and its
  two best words.  For a member the group holds size - 1 near words, of which the best is
  the first word, or the second for the first itself.  Two words of equal length that
  differ in one place share exactly one group, so sizes add up without repeats.  A group
  has a member for each letter at most, so it is small whatever the corpus is.
* Deletions and insertions.  The distinct deletions of a word are joined with the
  vocabulary.  A match tells the longer word of the shorter one and the other way round;
  there are no more of them than there are letters in the vocabulary.

Both kinds of report are summed by word: how many words are near, and the best of them
(the most frequent, ties by code-point order).  That one is the form of the word if it is
at least ``RATIO`` times as frequent.  Forms therefore grow in frequency, have no rings
and end after log2(n) steps; pointer doubling finds the last in as many rounds as that
number has bits.

Counting combines within blocks of texts before its shuffle, so a word that a third of
the corpus repeats is a row per block.  Nothing is collected but one largest count.

Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z
lower-cased.  Where the crc32 of ``<id>:<run>`` is divisible by ``SLIP`` the run loses the
code point at that checksum modulo its length, which plants slips of the pen.  A null text
has no words, a null id counts as the empty one, repeated rows count again, an empty table
gives no rows, and other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, release, scratch, table, written
from .sharding import CRC_TABLE, crc_sql

MIN_LENGTH, MIN_COUNT, RATIO, SLIP = 5, 3, 2, 97
#: Distinct words that a task holds before it hands their counts on.
BLOCK_WORDS = 200_000
_RUN = re.compile("[a-zÀ-ÿ]+")


def runs(text: str | None) -> list[str]:
    """The runs of a text, with A-Z and no other letter lower-cased."""
    return _RUN.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def slipped(start: int, run: str) -> str:
    """The run as it was written, given the checksum of ``<id>:``."""
    h = zlib.crc32(run.encode("utf-8"), start)
    if h % SLIP:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of at least ``min_length`` code points and ``min_count`` occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(counts: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        counts: dict[str, int] = {}
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in Counter(runs(text)).items():
                    if len(run) >= min_length:
                        word = slipped(start, run)
                        if len(word) >= min_length:
                            counts[word] = counts.get(word, 0) + n
                if len(counts) >= BLOCK_WORDS:
                    yield flush(counts)
                    counts = {}
        if counts:
            yield flush(counts)
        del counts
        release()

    found = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _best(n: str, word: str):
    """Least for the most frequent word, then the first in code-point order, which is the order of its UTF-8 bytes."""
    return F.struct((-F.col(n)).alias("less"), F.col(word).alias("word"))


def _without(letter: str):
    """The word with ``letter`` in place of each code point in turn (nothing: deletions)."""
    return F.transform(F.sequence(F.lit(1), F.length("word")), lambda p: F.concat(F.expr("word").substr(F.lit(1), p - 1), F.lit(letter), F.expr("word").substr(p + 1, F.length("word"))))


def near_words(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n_near, best) of the words of the stored table (word, n) that have near words; best is (-n, word)."""
    # The gap is a control character that no word holds, so a group's name gives its position, prefix and suffix.
    groups = words.select("word", "n", F.explode(_without("\x01")).alias("grp"))
    inside = Window.partitionBy("grp")
    ranked = inside.orderBy(F.col("n").desc(), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = groups.select("word", "n", F.count(F.lit(1)).over(ranked).alias("size"), F.first(_best("n", "word")).over(ranked).alias("one"), F.nth_value(_best("n", "word"), 2).over(ranked).alias("two"))
    replaced = kept.filter("size > 1").select("word", (F.col("size") - 1).alias("k"), F.when(F.col("one.word") == F.col("word"), F.col("two")).otherwise(F.col("one")).alias("best"))

    shorter = words.filter(F.length("word") > min_length).select(F.col("word").alias("long"), F.col("n").alias("long_n"), F.explode(F.array_distinct(_without(""))).alias("word"))
    met = shorter.join(words, "word").select(
        F.explode(F.array(F.struct("word", _best("long_n", "long").alias("best")), F.struct(F.col("long").alias("word"), _best("n", "word").alias("best")))).alias("report")
    )
    moved = met.select("report.word", F.lit(1).cast("long").alias("k"), "report.best")
    return replaced.unionByName(moved).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def last_forms(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) by doubling: ``forms`` is the stored table (word, form) without rings, of chains of at most ``steps``."""
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, steps - 1).bit_length()):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        now = written(now.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root")), "spelling-roots")
    return now


def variant_groups(words: DataFrame, ratio: int = RATIO, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each row of the stored table (word, n); see the module."""
    spark = words.sparkSession
    near = near_words(words, min_length)
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.word").alias("near"), (-F.col("best.less")).alias("near_n"))
    takes = F.col("near_n") >= ratio * F.col("n")
    found = written(joined.select("word", "n", "n_near", F.when(takes, F.col("near")).alias("form"), F.when(takes, F.col("near_n")).alias("form_n")), "spelling-forms")
    most = words.agg(F.max("n")).first()[0] or 1
    with scratch() as made:
        forms = written(found.filter("form is not null").select("word", "form"), "spelling-links")
        roots = last_forms(forms, most.bit_length())
        out = written(found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word")), "spelling-result")
        discard(spark, made[:-1])
    return out


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of ``documents`` with their near words, forms and roots."""
    words = written(word_counts(table(spark, sf_dir, "documents")), "spelling-words")
    return variant_groups(words).select("word", "form", "root", "n", "n_near", "form_n")


SQL = {
    "op13_spelling_variants": f"""
with recursive {CRC_TABLE},
runs as (
  select id, run, count(*) as k
  from (select coalesce(cast(doc_id as varchar), '') as id,
               unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run
        from documents)
  where length(run) >= {MIN_LENGTH} group by id, run),
hashed as materialized (select run, k, cast({crc_sql("encode(id || ':' || run)")} as bigint) as h from runs, crc_table),
words as materialized (
  select word, cast(sum(k) as bigint) as n
  from (select case when h % {SLIP} = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, k from hashed)
  where length(word) >= {MIN_LENGTH} group by word having sum(k) >= {MIN_COUNT}),
gaps as materialized (
  select distinct word, n, left(word, p::int) || mark || substr(word, p::int + 2) as gap, mark
  from (select word, n, unnest(range(length(word))) as p from words), (values ('_'), ('')) as m(mark)),
near as (
  select a.word, b.word as other, b.n as other_n from gaps a join gaps b on a.gap = b.gap and a.word <> b.word where a.mark = '_' and b.mark = '_'
  union all select g.word, w.word, w.n from gaps g join words w on g.gap = w.word where g.mark = ''
  union all select w.word, g.word, g.n from gaps g join words w on g.gap = w.word where g.mark = ''),
best as (
  select word, other, other_n, count(*) over (partition by word) as n_near, row_number() over (partition by word order by other_n desc, other) as place from near),
formed as materialized (
  select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.other_n >= {RATIO} * w.n then b.other end as form, case when b.other_n >= {RATIO} * w.n then b.other_n end as form_n
  from words w left join best b on b.word = w.word and b.place = 1),
chain(word, root, depth) as (
  select word, word, 0 from formed
  union all select c.word, f.form, c.depth + 1 from chain c join formed f on f.word = c.root where f.form is not null),
roots as (select word, arg_max(root, depth) as root from chain group by word)
select f.word, f.form, r.root, f.n, cast(f.n_near as bigint) as n_near, f.form_n from formed f join roots r on r.word = f.word""",
}
QUERIES = {"op13_spelling_variants": op13_spelling_variants}
