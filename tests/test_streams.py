"""Opened mail as a stream: repeats over batches, batches that run again, folding and forgetting."""

import random

import pytest
from pyspark.sql import functions as F

from lurewatch.operators import mail as M
from lurewatch.session import scratch_path
from lurewatch.sources.files import child_names, remove
from lurewatch.streaming import mail as SM

SCHEMA = "session_id string, mail_id string, ts timestamp, event_id bigint"


def events(spark, rows):
    return spark.createDataFrame(rows, "session_id string, mail_id string, event_id bigint").withColumn(
        "ts", F.timestamp_seconds(F.col("event_id") * 700)).select("session_id", "mail_id", "ts", "event_id")


def feed(spark, path, batches, **options):
    """Batches as files, one micro-batch each, all from one start of the stream or from one start each."""
    for rows in batches:
        events(spark, rows).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = SM.read_events(spark, f"{path}/in", events(spark, []).schema, format="parquet", max_files_per_trigger=1)
        SM.run_to_end(SM.write_changes(stream, f"{path}/out", f"{path}/progress", **options))
    return SM.read_changes(spark, f"{path}/out", stream.schema)


def expected(rows):
    last, kept = {}, []
    for session, mail, at in sorted(rows, key=lambda r: r[2]):
        if session not in last or last[session] != mail:
            kept.append(at)
        last[session] = mail
    return kept


@pytest.mark.parametrize("fold_every", [1, 2, 50])
def test_changes_over_batches(spark, fold_every):
    rng = random.Random(fold_every)
    rows = [(rng.choice([None, "s", "t", "u"]), rng.choice("AB"), i) for i in range(60)]
    path = scratch_path(spark, "stream")
    batches = [rows[:1], rows[1:20], rows[20:21], rows[21:45], rows[45:]]
    found = feed(spark, path, batches, fold_every=fold_every)
    assert sorted(r["event_id"] for r in found.collect()) == expected(rows)
    assert sorted(r["event_id"] for r in M.drop_repeats(events(spark, rows)).collect()) == expected(rows)
    names = sorted(child_names(spark, f"{path}/out/open"))
    assert names == {1: ["all_3", "all_4", "changed_4"], 2: ["all_2", "all_4", "changed_3", "changed_4"]}.get(
        fold_every, [f"changed_{i}" for i in range(5)])


def test_a_batch_that_runs_again_gives_the_same(spark):
    """The files of a batch, and of a fold it made, do not change what its second run finds."""
    path = scratch_path(spark, "stream")
    batches = [[("s", "A", 1), ("t", "A", 2)], [("s", "A", 3), ("t", "B", 4)], [("s", "B", 5), ("t", "B", 6)]]
    feed(spark, path, batches[:2], fold_every=1)
    remove(spark, f"{path}/progress/commits/1")  # as if it had failed before it was committed
    remove(spark, f"{path}/progress/commits/.1.crc")
    found = feed(spark, path, batches[2:], fold_every=1)
    assert sorted(r["event_id"] for r in found.collect()) == [1, 2, 4, 5]


def test_silent_sessions_are_forgotten(spark):
    path = scratch_path(spark, "stream")
    found = feed(spark, path, [[("s", "A", 1)], [("s", "A", 2)]], expire_after_ms=0)
    assert found.count() == 2


def test_no_python_in_the_plan(spark):
    """What a batch does is the batch operator with the table of open mail."""
    rows = events(spark, [("s", "A", 1), ("s", "A", 2)])
    state = SM.OpenMail(spark, scratch_path(spark, "open"), "session_id", "mail_id", rows.schema, 50, None)
    state.keep(M.open_at_end(rows), 0)
    plan = M.drop_repeats(rows, before=state.before(rows, 1))
    assert plan.count() == 0 and "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def test_empty_and_null(spark):
    rows = events(spark, [])
    assert M.drop_repeats(rows, before=M.open_at_end(rows)).count() == 0
    late = events(spark, [(None, "A", 5), (None, "B", 6)])
    before = M.open_at_end(events(spark, [(None, "A", 1)]))
    assert [r["event_id"] for r in M.drop_repeats(late, before=before).collect()] == [6]


def test_captured_mail_of_one_file_is_scored_by_several_tasks(spark):
    """A file of one row group was one task, whatever its size."""
    path, parts = scratch_path(spark, "stream"), []
    rows = spark.range(1000).select(F.col("id").alias("event_id"), F.struct(F.format_string("see https://example.com/%d", "id").alias("content")).alias("payload"))
    rows.coalesce(1).write.parquet(f"{path}/in")

    class Scorer:
        def analyze_all(self, messages):
            parts.append([r["count"] for r in messages.groupBy(F.spark_partition_id()).count().collect()])
            return messages.select("msg_id"), messages.select("msg_id").filter("msg_id < 0")

        def drop_scratch(self):
            pass

    stream = SM.read_events(spark, f"{path}/in", rows.schema, format="parquet")
    SM.run_to_end(SM.write_scores(stream, Scorer(), f"{path}/out", f"{path}/progress"))
    assert sorted(r["msg_id"] for r in spark.read.parquet(f"{path}/out/verdicts").collect()) == list(range(1000))
    assert len(parts[0]) > 1 and max(parts[0]) < 1000 / 2
