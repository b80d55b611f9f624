"""Streams over tables as Spark writes them: folders of part files, beside tables with names that begin alike."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fleetspan.streaming import streams as ST


@pytest.fixture(scope="module")
def folder(spark, events, tmp_path_factory):
    """``events`` is a folder of four part files with every tenth event twice; ``events_old`` must not be read."""
    at = str(tmp_path_factory.mktemp("stream"))
    again = events.where("event_id % 10 = 0")
    events.unionByName(again).repartition(4).write.parquet(f"{at}/events.parquet")
    events.limit(7).write.parquet(f"{at}/events_old.parquet")
    return at


def test_folder_table_is_read_whole(spark, events, folder):
    out = ST.run_to_table(ST.event_stream(spark, folder, "events").select("event_id"))
    assert out.count() == events.count() + events.where("event_id % 10 = 0").count()


def test_single_file_is_matched_by_its_exact_name(spark, events, tmp_path):
    for name, df in (("events", events), ("events_old", events.limit(7))):
        df.coalesce(1).write.parquet(f"{tmp_path}/w_{name}")
        part = next((tmp_path / f"w_{name}").glob("part-*.parquet"))
        (tmp_path / f"{name}.parquet").write_bytes(part.read_bytes())
    out = ST.run_to_table(ST.event_stream(spark, str(tmp_path), "events").select("event_id"))
    assert out.count() == events.count()


def test_repeats_of_a_folder_table_go(spark, events, folder):
    out = ST.run_to_table(ST.drop_repeats(ST.event_stream(spark, folder, "events"), ["event_id"], "ts").select("event_id"))
    assert out.count() == out.distinct().count() == events.select("event_id").distinct().count()


def test_latest_and_sessions_on_a_folder_table(spark, events, folder):
    stream = ST.event_stream(spark, folder, "events")
    latest = ST.run_to_table(ST.latest_per_key(stream, "user_id", ["ts", "event_id"], ["event_id"]), "update", ["user_id"])
    want = events.where("user_id is not null").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    assert latest.select("user_id", "event_id").exceptAll(want).isEmpty() and latest.count() == want.count()
    closed = ST.run_to_table(ST.activity_sessions(ST.event_stream(spark, folder, "events"), "user_id", "ts", "6 hours"))
    assert closed.count() > 0
