"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded random order; the row of rank ``r``
among ``n`` gets the fraction ``(r - 1/2) / n``.  Sorting all rows by that
fraction interleaves the sources in proportion to their sizes, and cutting the
sequence into equal runs gives shards whose mixtures all match the whole.

The ranks are global, but no window holds a source or a shard: rows are first
dealt into buckets of the seeded hash, and the final order into buckets of the
fraction; the counts of buckets, added up block by block, give each bucket's first
rank.  Texts are read once, and what is shuffled are ids and sizes.  The hash takes
in size and checksum too, so rows without an id, and different rows of one id, spread
over the buckets; fully equal rows are spread by their number in the stored table.

Nulls and ties: a null source is a source of its own; a null text has no bytes
(size 1, crc32 0); a null id takes part like any other.  Fully equal rows are
interchangeable.  An empty table gives no rows.  Columns other than the named ones
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, tagged, written

SEED = "atlas-1"
SHARDS = 8
#: Rows of a bucket, which one window task sorts, and buckets of a block.
BUCKET_ROWS, BLOCK_BUCKETS = 2_000, 1_024


def _starts(counts: DataFrame, keys: list[str], at: str, inside: tuple[str, ...] = ()) -> DataFrame:
    """(keys, at, inside, before): how many of ``k`` come before each bucket, added up in blocks of buckets."""
    cut = counts.withColumn("block", F.floor(F.col(at) / BLOCK_BUCKETS))
    blocks = cut.groupBy(*keys, "block").agg(F.sum("k").alias("all"))
    earlier = lambda by, order, what: F.coalesce(F.sum(what).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("far", earlier(keys, ["block"], "all"))
    near = cut.withColumn("near", earlier([*keys, "block"], [at, *inside], "k"))
    return near.join(blocks.select(*keys, "block", "far"), [*keys, "block"]).select(*keys, at, *inside, (F.col("near") + F.col("far")).alias("before"))


def _split(dealt: DataFrame, bucket_rows: int) -> DataFrame:
    """``dealt`` with ``part``, the place of a row's share within its bucket.

    Rows of one hash are equal but for their number in the stored table.  Of a hash that alone has more than
    ``bucket_rows`` they are spread by that number over as many parts as its count asks for, between the rows of smaller
    and those of larger hashes.  Such hashes are looked for in buckets above twice the mean; there are at most as many
    in a bucket as it holds multiples of ``bucket_rows``.
    """
    full = dealt.groupBy("stratum", "b").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > 2 * bucket_rows).select("stratum", "b")
    hot = dealt.join(full, ["stratum", "b"], "left_semi").groupBy("stratum", "b", "h").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > bucket_rows)
    # Parts are numbered through: those of the hashes before, one for what lies between two of them.
    w = Window.partitionBy("stratum", "b").orderBy("h")
    parts = F.expr(f"(k + {bucket_rows - 1}) div {bucket_rows}")
    listed = hot.withColumn("parts", parts).withColumn("first", F.sum(F.col("parts") + 1).over(w) - F.col("parts"))
    listed = written(listed.groupBy("stratum", "b").agg(F.sort_array(F.collect_list(F.struct("h", "first", "parts"))).alias("hot")), "shards-hot")
    rows = dealt.join(listed, ["stratum", "b"], "left")
    before = F.element_at(F.filter("hot", lambda x: x["h"] <= F.col("h")), -1)
    mine = F.when(before["h"] == F.col("h"), before["first"] + F.pmod(F.xxhash64("spread"), before["parts"])).otherwise(before["first"] + before["parts"])
    some = F.exists("hot", lambda x: x["h"] <= F.col("h"))
    return rows.withColumn("part", F.when(F.col("hot").isNotNull() & some, mine).otherwise(F.lit(0)).cast("long")).drop("hot")


def stratified_shards(
    docs: DataFrame,
    n_shards: int = SHARDS,
    seed: str = SEED,
    bucket_rows: int = BUCKET_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Rows of ``docs`` as (id, size, text_crc32, stratum, shard, slot); see the module."""
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("size")
    crc = F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).alias("text_crc32")
    keyed = docs.select(F.col(id_col).alias("doc_id"), tagged(source_col).alias("stratum"), size, crc)
    hashed = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), F.col("text_crc32").cast("string"))
    keyed = written(keyed.withColumn("h", F.md5(hashed.cast("binary"))).withColumn("spread", F.monotonically_increasing_id()), "shards-keyed")
    total = keyed.count()
    buckets = max(1, -(-total // bucket_rows))
    at = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("long")
    dealt = _split(keyed.withColumn("b", at), bucket_rows)
    counts = dealt.groupBy("stratum", "b", "part").agg(F.count(F.lit(1)).alias("k"))
    n = counts.groupBy("stratum").agg(F.sum("k").alias("n"))
    firsts = _starts(counts, ["stratum"], "b", ("part",)).join(n, "stratum")
    in_bucket = Window.partitionBy("stratum", "b", "part").orderBy("h", "doc_id", "size", "text_crc32")
    ranked = (
        dealt.join(firsts, ["stratum", "b", "part"])
        .withColumn("r", F.row_number().over(in_bucket) + F.col("before"))
        .withColumn("fraction", (F.col("r") - 0.5) / F.col("n"))
        .withColumn("g", F.expr(f"((2 * r - 1) * {buckets}) div (2 * n)"))
    )
    ranked = written(ranked.select("doc_id", "stratum", "size", "text_crc32", "h", "fraction", "g"), "shards-ranked")
    starts = _starts(ranked.groupBy("g").agg(F.count(F.lit(1)).alias("k")), [], "g").withColumnRenamed("before", "start")
    in_order = Window.partitionBy("g").orderBy("fraction", "stratum", "h", "doc_id", "size", "text_crc32")
    return (
        ranked.join(starts, "g")
        .withColumn("pos", F.row_number().over(in_order) - 1 + F.col("start"))
        .withColumn("shard", F.expr(f"cast((pos * {n_shards}) div {max(total, 1)} as int)"))
        .withColumn("slot", F.expr(f"pos - (shard * {max(total, 1)}L + {n_shards - 1}) div {n_shards}"))
        .select("doc_id", "size", "text_crc32", "stratum", "shard", "slot")
    )


def op6_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in shards 0 to 7 under the law ``rows``."""
    return stratified_shards(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: CRC-32 of a blob column ``b`` with the 256-entry table in ``crc_table.tab``.
CRC_TABLE = """crc_table as materialized (
  select list(c order by i) as tab from (
    select i, list_reduce([i] || range(8), lambda a, x: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end) as c
    from range(256) t(i)))"""


def crc_sql(blob: str) -> str:
    steps = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda x: ('0x' || x)::bigint)"
    return f"xor(list_reduce([4294967295] || {steps}, lambda a, x: xor(a // 256, tab[1 + xor(a % 256, x)])), 4294967295)"


SQL = {
    "op6_stratified_shards": f"""
with {CRC_TABLE},
sized as materialized (
  select doc_id, coalesce('=' || source, '-') as stratum, cast(coalesce(strlen(text), 0) + 1 as bigint) as size,
         cast({crc_sql("encode(coalesce(text, ''))")} as bigint) as text_crc32
  from documents, crc_table),
base as (
  select *, md5('{SEED}:' || coalesce(cast(doc_id as varchar), '') || ':' || size || ':' || text_crc32) as h
  from sized),
ranked as (
  select *, (row_number() over (partition by stratum order by h, doc_id nulls first, size, text_crc32) - 0.5::double)
            / count(*) over (partition by stratum) as fraction
  from base),
placed as (
  select *, row_number() over (order by fraction, stratum, h, doc_id nulls first, size, text_crc32) - 1 as pos,
         count(*) over () as total
  from ranked)
select doc_id, size, text_crc32, 'rows' as law, cast((pos * {SHARDS}) // total as int) as shard,
       cast(pos - (((pos * {SHARDS}) // total) * total + {SHARDS - 1}) // {SHARDS} as bigint) as slot,
       cast(null as int) as grown_shard
from placed""",
}
QUERIES = {"op6_stratified_shards": op6_stratified_shards}
