"""Streaming jobs over the event log (OP-01..03, 05..07, 46a, 46b).

The same rules as the batch jobs, on streaming frames: the as-of step is the
keyed-state processor, everything else is the unchanged Column logic. Sinks
are append-only and checkpointed (exactly-once for file sinks); on a cluster
the checkpoint must be in the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from eventfold.operators.decisions import command_events, decide
from eventfold.operators.derive import Rule, derive
from eventfold.operators.state import snapshot_events
from eventfold.schema import SNAPSHOT_TYPES
from eventfold.session import checkpoint_dir
from eventfold.sources.log import StreamPolicy, split_malformed, stream_event_log
from eventfold.streaming.asof_state import stream_attach_last_before


def stream_derive(log: DataFrame, ops: Iterable[str | Rule] | None = None,
                  snapshot_types: Sequence[str] = SNAPSHOT_TYPES, as_of: Column | None = None) -> DataFrame:
    """OP-46a on a stream: derived events of each arriving row."""
    return derive(log, ops, snapshot_types, as_of, attach=stream_attach_last_before)


def _start(df: DataFrame, name: str, fmt: str, path: str | None, policy: StreamPolicy) -> StreamingQuery:
    ckpt = policy.checkpoint or os.path.join(checkpoint_dir(df.sparkSession), "streams", name)
    w = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", ckpt).queryName(name)
    if policy.trigger_ms:
        w = w.trigger(processingTime=f"{policy.trigger_ms} milliseconds")
    return w.start(path) if path else w.start()


def start_snapshot_sink(log: DataFrame, path: str | None, fmt: str = "parquet",
                        policy: StreamPolicy = StreamPolicy(), name: str = "snapshot_sink",
                        snapshot_types: Sequence[str] = SNAPSHOT_TYPES) -> StreamingQuery:
    """OP-05: final events appended to the snapshot table."""
    return _start(snapshot_events(log, snapshot_types), name, fmt, path, policy)


def start_derived_sink(log: DataFrame, path: str | None, fmt: str = "parquet",
                       policy: StreamPolicy = StreamPolicy(), name: str = "derived_sink") -> StreamingQuery:
    """OP-06: every derived event appended back to the log (one sink keyed by item)."""
    return _start(stream_derive(log), name, fmt, path, policy)


def start_command_events_sink(commands: DataFrame, state: DataFrame, path: str | None, fmt: str = "parquet",
                              policy: StreamPolicy = StreamPolicy(), name: str = "command_events_sink"
                              ) -> StreamingQuery:
    """OP-07: accepted commands of a command stream, decided against a state
    table (stream-static join), appended to the log."""
    return _start(command_events(decide(commands, state)), name, fmt, path, policy)


def start_lifecycle_loop(spark: SparkSession, external_path: str, derived_path: str,
                         policy: StreamPolicy = StreamPolicy(),
                         name: str = "lifecycle_loop", snapshot_types: Sequence[str] = SNAPSHOT_TYPES,
                         fmt: str = "parquet") -> StreamingQuery:
    """OP-46b on a stream: derived events are appended to ``derived_path``,
    which is also a source of the same query, so a derived event is processed
    like any other in a later micro-batch (arrival order, as when the original
    writes back to its input topic). External rows carry hop 0.

    Each micro-batch writes its derived rows to ``derived_path/batch=<id>``
    (overwritten if the batch is retried) and writes nothing when empty, so
    the loop goes quiet once no rule fires."""
    from pyspark.sql import functions as F

    from eventfold.operators.closure import RELAY_RULES
    from eventfold.operators.derive import RULES
    from eventfold.schema import DERIVED, EVENT_COLUMNS

    ext = stream_event_log(spark, external_path, policy, fmt).select(F.lit(0).alias("hop"), *EVENT_COLUMNS)
    reader = spark.readStream.format(fmt).schema(DERIVED).option("recursiveFileLookup", "true")
    if policy.max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", policy.max_files_per_trigger)
    back = reader.load(derived_path)
    derived = derive(ext.unionByName(back), list(RULES) + RELAY_RULES, snapshot_types,
                     attach=stream_attach_last_before)

    def write_back(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # the stateful plan runs once, whether or not there is something to write
        if not batch.isEmpty():
            batch.write.mode("overwrite").format(fmt).save(f"{derived_path}/batch={batch_id}")
        batch.unpersist()

    ckpt = policy.checkpoint or os.path.join(checkpoint_dir(spark), "streams", name)
    w = derived.writeStream.foreachBatch(write_back).option("checkpointLocation", ckpt).queryName(name)
    if policy.trigger_ms:
        w = w.trigger(processingTime=f"{policy.trigger_ms} milliseconds")
    return w.start()


def start_split_sink(source: DataFrame, text_col: str, schema: T.StructType, good_path: str, quarantine_path: str,
                     policy: StreamPolicy = StreamPolicy(), name: str = "split_sink", fmt: str = "parquet",
                     wrote: Callable[[str, int], None] | None = None) -> StreamingQuery:
    """OP-04 on a stream: decoded rows and undecodable ones are two outputs of one micro-batch. Each is written to
    ``<path>/batch=<id>``, and a batch that is repeated (a failure between the writes, or before the batch is
    committed) overwrites both, so neither loses or doubles a row. ``wrote`` is told each write."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # both outputs come from one computation
        good, bad = split_malformed(batch, text_col, schema)
        for kind, rows, path in (("good", good, good_path), ("quarantine", bad, quarantine_path)):
            rows.write.mode("overwrite").format(fmt).save(f"{path}/batch={batch_id}")
            if wrote is not None:
                wrote(kind, batch_id)
        batch.unpersist()

    ckpt = policy.checkpoint or os.path.join(checkpoint_dir(source.sparkSession), "streams", name)
    w = source.writeStream.foreachBatch(write).option("checkpointLocation", ckpt).queryName(name)
    if policy.trigger_ms:
        w = w.trigger(processingTime=f"{policy.trigger_ms} milliseconds")
    return w.start()


class FailureAlerts:
    """Failure watch for streaming queries: calls ``on_failure(query_id,
    message)`` when a query terminates with an error (the original alerts and
    closes its stream on an uncaught error). Register with :func:`watch_failures`."""

    def __init__(self, on_failure):
        from pyspark.sql.streaming import StreamingQueryListener

        outer = on_failure

        class _Listener(StreamingQueryListener):
            def onQueryStarted(self, event):
                pass

            def onQueryProgress(self, event):
                pass

            def onQueryIdle(self, event):
                pass

            def onQueryTerminated(self, event):
                if event.exception:
                    outer(str(event.id), event.exception)

        self.listener = _Listener()


def watch_failures(spark: SparkSession, on_failure) -> FailureAlerts:
    alerts = FailureAlerts(on_failure)
    spark.streams.addListener(alerts.listener)
    return alerts
