"""Streams over restarts: keys once, requests judged, retries at their due times."""

from datetime import datetime, timedelta

import pytest

from textloom.streaming import incremental as I


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", I.ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def keep(path):
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def test_a_key_of_a_later_batch_is_written_once(spark, tmp_path):
    src, out, ck, schema = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), "k long, v string"
    put(spark, src, [(1, "a"), (1, "a"), (2, "b")], schema)
    run = lambda: I.run_available(I.once(I.new_files(spark, src, schema, 1), "k"), ck, I.append_once(out, "k"))
    assert run() == 1
    put(spark, src, [(2, "again"), (3, "c")], schema)
    put(spark, src, [(1, "again"), (None, "n")], schema)
    assert run() == 2  # a restart: state is read from the checkpoint
    put(spark, src, [(None, "again"), (3, "again")], schema)
    run()
    assert sorted(str((r.k, r.v)) for r in spark.read.parquet(out).collect()) == sorted(map(str, [(1, "a"), (2, "b"), (3, "c"), (None, "n")]))


def test_keys_within_their_time(spark, tmp_path):
    src, out, ck, schema = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), "k long, at timestamp"
    start = datetime(2026, 1, 1)
    run = lambda: I.run_available(I.once(I.new_files(spark, src, schema), "k", "at", "1 hour"), ck, keep(out))
    for minutes, keys in ((0, [1, 2]), (30, [1, 3]), (50, [2, 4])):
        put(spark, src, [(k, start + timedelta(minutes=minutes)) for k in keys], schema)
        run()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]


def test_requests_over_a_restart(spark, tmp_path, rocks):
    src, out, ck, schema = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), "k string, body string, d string"
    run = lambda: I.run_available(I.by_request(I.new_files(spark, src, schema), "k", "d"), ck, keep(out))
    put(spark, src, [("a", "1", "x"), ("b", "1", "y"), ("b", "1", "y"), (None, "1", "y"), ("c", "1", None)], schema)
    run()
    put(spark, src, [("a", "1", "x"), ("b", "2", "z"), ("c", "1", "w")], schema)
    run()
    got = sorted((r.k, r.d, r.outcome) for r in spark.read.parquet(out).collect())
    assert got == [("a", "x", "replay"), ("a", "x", "stored"), ("b", "y", "replay"), ("b", "y", "stored"), ("b", "z", "conflict"), ("c", "w", "stored")]


def test_retries_fire_when_due(spark, tmp_path, rocks):
    src, out, ck, schema = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), "s string, at timestamp, ok boolean, transient boolean"
    start = datetime(2026, 1, 1, 12)
    at = lambda seconds: start + timedelta(seconds=seconds)
    run = lambda: I.run_available(I.retries(I.new_files(spark, src, schema), "s", "at", "ok", "transient"), ck, keep(out))
    read = lambda: sorted((r.source, r.attempts, r.due) for r in spark.read.parquet(out).collect())
    put(spark, src, [("once", at(0), False, True), ("fatal", at(0), False, False), ("mended", at(0), False, True), ("mended", at(60), True, None), ("twice", at(0), False, True), ("twice", at(10), False, True)], schema)
    run()
    put(spark, src, [("clock", at(299), True, None), (None, at(299), False, True)], schema)
    run()
    assert read() == []
    put(spark, src, [("clock", at(301), True, None)], schema)
    run()
    put(spark, src, [("clock", at(700), True, None)], schema)
    run()  # over a restart each timer fires once
    put(spark, src, [("clock", at(9000), True, None)], schema)
    run()
    assert read() == [("once", 1, at(300))]
