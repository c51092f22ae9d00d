"""Build events as streams, and properties of builds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registered import query
from ..runtime import new_folder
from ..sources import testdata as td
from ..streaming import builds


def _stream(spark, sf_dir, columns: list[str], order: str = "ts", of=td.build_events) -> DataFrame:
    """The events as a stream of a table stored in the order of their times, some files a trigger, read to its end."""
    stored = of(spark, sf_dir).select(*{*columns, order})
    if "ts" in stored.columns:  # event times are instants
        stored = stored.withColumn("ts", F.col("ts").cast("timestamp"))
    path = new_folder(spark, "events")
    # Files come in the order of their names' ranges; each is written by one task of a sorted range, which many tasks have read.
    for k, part in enumerate(_ranges(stored, order)):
        part.select(*columns).repartition(1).write.mode("append").parquet(f"{path}/{k}")
    return spark.readStream.schema(stored.select(*columns).schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def _ranges(df: DataFrame, order: str, pieces: int = 3) -> list[DataFrame]:
    """``df`` cut into equal pieces of its span of ``order``."""
    at = F.col(order).cast("double")
    low, high = df.agg(F.min(at), F.max(at)).first()
    cuts = [low + (high - low) * k / pieces for k in range(1, pieces)] if low is not None else []
    bounds = [None, *cuts, None]
    return [df.filter((F.lit(True) if a is None else at >= a) & (F.lit(True) if b is None else at < b)) for a, b in zip(bounds, bounds[1:])]


def drained(df: DataFrame, mode: str, name: str) -> DataFrame:
    """What a stream gives until its input ends, as a table.

    Each batch has a folder of its own number, which a batch that is run again writes over, so a retry repeats no row.  In
    complete mode the last batch is the result.
    """
    spark = df.sparkSession
    path, at = new_folder(spark, name), new_folder(spark, f"{name}-offsets")
    last = [-1]

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        last[0] = batch

    df.writeStream.outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    if last[0] < 0:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(f"{path}/batch=*" if mode == "append" else f"{path}/batch={last[0]}")


@query("event_pairing_stream", "select user_id as key, event_id as seq, prev_id as start_seq from (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as pt, lag(event_id) over (partition by user_id order by ts, event_id) as prev_id from events where event_type in ('signup', 'click')) t where event_type = 'click' and pt = 'signup'")
def _(spark, sf_dir):
    """The pairs of ``event_pairing`` out of a stream with state."""
    return drained(builds.pair_stream(_stream(spark, sf_dir, ["seq", "ts", "key", "event_type"])), "append", "pairs")


def _arriving(spark, sf_dir) -> DataFrame:
    """Events with the time they come at: up to five minutes after their own, by their number."""
    return td.build_events(spark, sf_dir).withColumn("came", F.unix_micros(F.col("ts").cast("timestamp")) + F.col("seq") * 7919 % 300 * 1_000_000)


@query(
    "event_pairing_unordered",
    "with e as (select user_id, event_id, event_type, ts, lag(event_type) over w as pt, lag(event_id) over w as prev_id from events where event_type in ('signup', 'click') window w as (partition by user_id order by ts, event_id)) select user_id as key, event_id as seq, prev_id as start_seq from e where event_type = 'click' and pt = 'signup' and date_trunc('millisecond', ts) <= (select date_trunc('millisecond', max(ts)) - interval '10 minutes' from events where event_type in ('signup', 'click'))",
)
def _(spark, sf_dir):
    """Pairs out of a stream whose events come out of order; what the watermark has not passed waits."""
    events = _stream(spark, sf_dir, ["seq", "ts", "key", "event_type"], "came", _arriving)
    with builds.state_in_rocksdb(spark):
        return drained(builds.pair_unordered_stream(events), "append", "pairs")


@query(
    "target_commands_stream",
    "select s.user_id as key, s.event_id as start_seq, c.event_id as seq from events s join events c on c.user_id = s.user_id and c.ts > s.ts and c.ts <= s.ts + interval '1 hour' where s.event_type = 'signup' and c.event_type = 'click'",
)
def _(spark, sf_dir):
    """Commands within an hour of a start, by a join of two streams."""
    return drained(builds.commands_of_targets(_stream(spark, sf_dir, ["seq", "ts", "key", "event_type"])), "append", "commands")


_SESSIONS = """with e as (select user_id as key, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as b from events),
i as (select *, sum(b) over (partition by key order by ts rows unbounded preceding) as run from e)
select key, min(ts) as start, max(ts) + interval '30 minutes' as "end", count(*) as n from i group by key, run"""


@query("event_sessions", _SESSIONS)
def _(spark, sf_dir):
    """Runs of each user's events with less than half an hour between them."""
    e = td.build_events(spark, sf_dir).select("key", F.col("ts").cast("timestamp").alias("ts"))
    return _instants(builds.sessions(e))


@query("event_sessions_stream", _SESSIONS)
def _(spark, sf_dir):
    return _instants(drained(builds.sessions(_stream(spark, sf_dir, ["ts", "key"])), "complete", "sessions"))


def _instants(runs: DataFrame) -> DataFrame:
    return runs.select("key", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("property_overlay_stream", "select user_id as key, event_type, max_by(json_extract_string(props, '$.k'), event_id) as value from events where event_type not in ('signup', 'click') group by 1, 2")
def _(spark, sf_dir):
    events = _stream(spark, sf_dir, ["seq", "key", "event_type", "value"], "seq").filter(~F.col("event_type").isin(builds.START, builds.COMMAND))
    return drained(builds.property_overlay(events, ["key", "event_type"], order=("seq",)), "complete", "overlay")


@query("event_windows_stream", "select time_bucket(interval '5 minutes', ts) as start, case event_type when 'signup' then 'TargetStarted' when 'click' then 'TaskCommandLine' else event_type end as event_type, count(*) as n from events group by 1, 2")
def _(spark, sf_dir):
    counted = builds.windowed_counts(_stream(spark, sf_dir, ["ts", "event_type"]))
    return drained(counted.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n"), "complete", "windows")


@query("invocation_properties", "select o_orderkey, string_agg(event_type || '=' || v, ',' order by event_type) as properties from orders left join (select user_id, event_type, min(json_extract_string(props, '$.k')) as v from events where user_id % 3 <> 0 group by 1, 2) e on e.user_id = o_custkey % 60 group by o_orderkey")
def _(spark, sf_dir):
    """Instances with the properties of their evaluation; some have none."""
    instances = td.read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 60).alias("evaluation_id"))
    e = td.read(spark, sf_dir, "events").filter("user_id % 3 <> 0")
    values = e.groupBy(F.col("user_id").alias("evaluation_id"), F.col("event_type").alias("name")).agg(F.min(F.get_json_object("props", "$.k")).alias("value"))
    found = builds.invocation_properties(instances, values)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return found.select("o_orderkey", shown.alias("properties"))
