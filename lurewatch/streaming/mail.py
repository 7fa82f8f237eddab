"""Opened mail as a stream: capture, consecutive repeats, scoring."""

from pyspark.sql import functions as F

from lurewatch.operators.mail import as_messages, drop_repeats, only_opened, open_at_end
from lurewatch.sources.files import child_names, exists, remove


def read_events(spark, path, schema, format="json", max_files_per_trigger=1000):
    """A stream of event files. The files per trigger bound what one micro-batch holds."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.format(format).load(path)


def write_capture(events, path, checkpoint, trigger=None):
    """Append opened-mail messages to a parquet store, each exactly once."""
    writer = only_opened(events).writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)


class OpenMail:
    """The mail each session has open, as files: what a batch changed, and now and then all of it.

    Batch n writes its sessions as ``changed_n``; every ``fold_every`` batches the newest row of every session is
    written as ``all_n``. A batch reads the files before its own, so one that runs again finds what it found the
    first time; files that an earlier ``all`` replaces are removed once the batch that wrote it is over. With
    ``expire_after_ms`` sessions that were silent so long are forgotten.
    """

    def __init__(self, spark, path, session, mail_id, kinds, fold_every, expire_after_ms):
        self.spark, self.path, self.session, self.mail_id = spark, path.rstrip("/"), session, mail_id
        fields = ", ".join(f"`{c}` {kinds[c].dataType.simpleString()}" for c in (session, mail_id))
        self.schema = f"{fields}, _seen timestamp, _batch bigint"
        self.fold_every, self.expire_after_ms = fold_every, expire_after_ms

    def _written(self, batch_id):
        """(names of the files to read, names of those no batch needs any more) before a batch."""
        names = [(int(n.split("_")[1]), n) for n in child_names(self.spark, self.path) if "_" in n]
        names = [(n, f) for n, f in names if n < batch_id and exists(self.spark, f"{self.path}/{f}/_SUCCESS")]
        last = max((n for n, f in names if f.startswith("all_")), default=-1)
        needed = [f for n, f in names if n > last or f == f"all_{last}"]
        return needed, [f for _, f in names if f not in needed]

    def _rows(self, names):
        if not names:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{n}" for n in names])
        if self.expire_after_ms is None:
            return rows
        limit = F.current_timestamp() - F.make_interval(secs=F.lit(self.expire_after_ms / 1000).cast("decimal(18,6)"))
        return rows.filter(F.col("_seen") >= limit)

    def _newest(self, rows):
        newest = F.max_by(F.struct(self.mail_id, "_seen", "_batch"), "_batch").alias("_n")
        return rows.groupBy(self.session).agg(newest).select(self.session, "_n.*")

    def before(self, batch, batch_id):
        """The open mail of the sessions of a batch. Other rows are left out before anything is shuffled."""
        needed, old = self._written(batch_id)
        for name in old:
            remove(self.spark, f"{self.path}/{name}")
        asked = batch.select(F.col(self.session).alias("_asked")).distinct()
        rows = self._rows(needed)
        return self._newest(rows.join(asked, F.col(self.session).eqNullSafe(F.col("_asked")), "left_semi"))

    def keep(self, ends, batch_id):
        """Write what a batch leaves open."""
        rows = ends.select(self.session, self.mail_id, F.current_timestamp().alias("_seen"), F.lit(batch_id).cast("bigint").alias("_batch"))
        rows.write.mode("overwrite").parquet(f"{self.path}/changed_{batch_id}")
        if batch_id and batch_id % self.fold_every == 0:
            every = self._rows([*self._written(batch_id)[0], f"changed_{batch_id}"])
            self._newest(every).write.mode("overwrite").parquet(f"{self.path}/all_{batch_id}")


def write_changes(events, path, checkpoint, session="session_id", mail_id="mail_id", order=("ts", "event_id"), unit="hour",
                  columns=None, fold_every=50, expire_after_ms=None, trigger=None):
    """Streaming form of ``drop_repeats``: the events that change a session's open mail, below ``path/changes``.

    Each micro-batch goes through the batch operator, which cuts sessions into time buckets; what was open before
    comes from ``path/open`` (``OpenMail``). Everything runs in the JVM, and no task holds a session. A batch that is
    run again replaces its own output only. Events are put in order inside a micro-batch; late ones of earlier
    batches are not. Read the result with ``read_changes``.
    """
    columns = list(columns or events.columns)
    state = OpenMail(events.sparkSession, f"{path}/open", session, mail_id, events.schema, fold_every, expire_after_ms)

    def keep_changes(batch, batch_id):
        batch = batch.persist()
        try:
            changes = drop_repeats(batch, session, mail_id, order, unit, state.before(batch, batch_id))
            changes.select(columns).write.mode("overwrite").parquet(f"{path}/changes/batch_id={batch_id}")
            state.keep(open_at_end(batch, session, mail_id, order), batch_id)
        finally:
            batch.unpersist()

    writer = events.writeStream.foreachBatch(keep_changes).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_changes(spark, path, schema):
    """The table that ``write_changes`` has written so far."""
    return spark.read.schema(schema).parquet(f"{path}/changes").select(*schema.names)


def write_scores(captured, analyzer, path, checkpoint, ids="event_id", trigger=None, **options):
    """Score captured mail batch by batch: verdicts below ``path/verdicts``, refused mail below ``path/rejects``.

    A batch that is run again replaces its own output only. Its scratch tables go when it is written. Captured mail may be
    few files of one row group, which Spark cannot split, so its rows are dealt out before they are scored.
    """

    def score_batch(batch, batch_id):
        parallel = 2 * batch.sparkSession.sparkContext.defaultParallelism
        verdicts, rejects = analyzer.analyze_all(as_messages(batch, ids).repartition(parallel), **options)
        verdicts.write.mode("overwrite").parquet(f"{path}/verdicts/batch_id={batch_id}")
        rejects.write.mode("overwrite").parquet(f"{path}/rejects/batch_id={batch_id}")
        analyzer.drop_scratch()

    writer = captured.writeStream.foreachBatch(score_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def run_to_end(query):
    """Wait for a query with an ``availableNow`` trigger; its failure is raised here."""
    query.awaitTermination()
    return query
