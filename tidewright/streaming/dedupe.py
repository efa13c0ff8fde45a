"""Streams of replies and events: exactly-once receipts and state folds.

The batch operators in ``operators.ledger`` are applied to micro-batches; what has
been seen is kept in stream state or in a receipts table, so that replays change
nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewright.operators.ledger import TRANSITIONS, receipts
from tidewright.stored import Scratch


def new_replies(stream: DataFrame, job: str, payload: str, time: str, late: str = "1 hour") -> DataFrame:
    """Replies by job and content, each once; state older than the watermark is dropped."""
    digest = F.sha2(F.col(payload).cast("binary"), 256)
    return stream.withWatermark(time, late).withColumn("digest", digest).dropDuplicatesWithinWatermark([job, "digest"])


def import_batch(batch: DataFrame, stored_path: str, job: str, payload: str, batch_id: int) -> DataFrame:
    """One micro-batch against the receipts at a path: new ones are stored, all come back with outcomes.

    Of several payloads for one new job the one of least digest is NEW, the others are a CONFLICT.
    Receipts are stored by batch: a batch that is run again after a failure overwrites its own and is judged
    against those of the other batches, so it gives the same outcomes.
    """
    spark = batch.sparkSession
    kind = batch.schema[job].dataType.simpleString()
    folder = spark._jvm.org.apache.hadoop.fs.Path(stored_path)
    schema = f"{job} {kind}, digest string, batch long"
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    stored = spark.read.schema(schema).parquet(stored_path) if there else spark.createDataFrame([], schema)
    out = receipts(batch.dropDuplicates([job, payload]), stored.filter(F.col("batch") != batch_id).select(job, "digest"), job, payload)
    least = out.filter("outcome = 'NEW'").groupBy(job).agg(F.min("digest").alias("_least"))
    out = out.join(least, job, "left").withColumn("outcome", F.when((F.col("outcome") == "NEW") & (F.col("digest") != F.col("_least")), "CONFLICT").otherwise(F.col("outcome"))).drop("_least")
    out = Scratch(spark, "replies").save(out, "judged")
    out.filter("outcome = 'NEW'").select(job, "digest").write.mode("overwrite").parquet(f"{stored_path}/batch={batch_id}")
    return out


def folded_stream(stream: DataFrame, key: str, order: str, event: str, initial: str = "PENDING") -> DataFrame:
    """(key, state, applied): each key's state after every micro-batch with events of it."""
    kind = stream.schema[key].dataType.simpleString()
    table = dict(TRANSITIONS)

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, applied = state.get if state.exists else (initial, 0)
        events = pd.concat(list(batches)).sort_values(order)
        for e in events[event]:
            new = table.get((now, e))
            if new is not None:
                now, applied = new, applied + 1
        state.update((now, applied))
        yield pd.DataFrame({key: [k[0]], "state": [now], "applied": [applied]})

    return stream.select(key, order, event).groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, state string, applied long", "state string, applied long", "update", GroupStateTimeout.NoTimeout)
