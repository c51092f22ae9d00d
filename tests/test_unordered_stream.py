"""Pairing of events that come out of order, over triggers and restarts."""

import random
from datetime import datetime, timedelta

import pytest

from codeatlas.streaming import builds

SCHEMA = "seq long, ts timestamp, key long, event_type string"
ZERO = datetime(2024, 1, 1)


def event(k, minute, start, key=1):
    return k, ZERO + timedelta(minutes=minute), key, builds.START if start else builds.COMMAND


class Feed:
    """A stream of one file a trigger, run to its end each time, from where it was before."""

    def __init__(self, spark, root):
        self.spark, self.root, self.files = spark, root, 0

    def run(self, *batches):
        for rows in batches:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/in/{self.files:03}")
            self.files += 1
        events = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.root}/in/*")
        with builds.state_in_rocksdb(self.spark):
            out = builds.pair_unordered_stream(events).writeStream.option("checkpointLocation", f"{self.root}/at").option("path", f"{self.root}/out").trigger(availableNow=True).start()
            out.awaitTermination()
        return sorted(tuple(r) for r in self.spark.read.schema(builds.PAIR).parquet(f"{self.root}/out").collect())


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, str(tmp_path))


def test_a_start_that_comes_behind_its_command(feed):
    assert feed.run([event(2, 5, False)], [event(1, 1, True)]) == []
    assert feed.run([event(3, 60, True)], [event(4, 61, True)]) == [(1, 2, 1)]


def test_state_lives_through_a_restart(feed):
    assert feed.run([event(1, 1, True)], [event(9, 100, True, key=2)]) == []
    # The start waits for a command of much later, while another key moves the watermark.
    assert feed.run([event(2, 300, False)], [event(10, 400, True, key=2)], [event(11, 500, True, key=2)]) == [(1, 2, 1)]


def test_what_comes_too_late_is_left_out(feed):
    feed.run([event(1, 1, True), event(2, 60, True)], [event(3, 61, True)])
    assert feed.run([event(4, 2, False)], [event(5, 62, False)], [event(6, 200, True)], [event(7, 201, True)]) == [(1, 5, 3)]


def test_against_the_batch_form(spark, feed):
    r = random.Random(3)
    rows = [event(k, r.randrange(0, 4000) / 10, r.random() < 0.5, r.randrange(4)) for k in range(300)]
    rows += [(k, ZERO + timedelta(days=9), 9, builds.START) for k in (1000, 1001)]
    came = sorted(rows, key=lambda e: (e[1] + timedelta(seconds=r.randrange(500)), e[0]))
    cuts = [0, 70, 140, 300, 301, 302]
    found = feed.run(*(came[a:b] for a, b in zip(cuts, cuts[1:])))
    batch = builds.pair_events(spark.createDataFrame(rows, SCHEMA)).collect()
    assert found and found == sorted(tuple(x) for x in batch)
