"""Streams: incremental work by signature, a running gate, progress, enrichment; and the ledger of requests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fabula.operators.ordered import RunningMedian, gate_step, keyed_pass
from fabula.session import fresh_path


def incremental(stream: DataFrame, done: str, keys: list[str], signature: str, work: Callable[[DataFrame], DataFrame], checkpoint: str) -> None:
    """ST-1: works only on rows whose (keys, signature) the table at ``done`` doesn't have, and appends what it did.

    A batch that is replayed after a failure finds its rows done and does nothing again. The table is made, empty, before the
    stream starts.
    """
    spark = stream.sparkSession
    work(spark.createDataFrame([], stream.schema)).write.mode("append").parquet(done)

    def batch(df: DataFrame, _: int) -> None:
        ident = [*keys, signature]
        known = df.sparkSession.read.parquet(done).select(*ident)
        fresh = df.dropDuplicates(ident).join(known, ident, "left_anti")
        work(fresh).write.mode("append").parquet(done)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def running_gate(rows: DataFrame, key: str, order: str, value: str, low=0.6, high=1.45, least=5) -> DataFrame:
    """ST-2 in batch: (key, order, value, accepted). One pass over a key's rows in order; keys run in parallel."""

    def step(state: RunningMedian, batch: pa.RecordBatch):
        values = batch.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False).tolist()
        return (pa.array(gate_step(state, values, low, high, least)),)

    return keyed_pass(rows.select(key, order, value), [key], [order], RunningMedian, step, "accepted boolean")


def running_gate_stream(stream: DataFrame, key: str, order: str, value: str, low=0.6, high=1.45, least=5) -> DataFrame:
    """ST-2 as a stream: a key's state is the two heaps of all its accepted values, so the stream accepts what the batch does."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = dict(stream.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = RunningMedian(*(bytes(h) for h in state.get)) if state.exists else RunningMedian()
        arrived = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")  # a key's rows of one micro-batch
        arrived["accepted"] = gate_step(seen, arrived[value].astype(float).tolist(), low, high, least)
        yield arrived[[key, order, value, "accepted"]]
        state.update(seen.saved())

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {value} {kinds[value]}, accepted boolean"
    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(step, schema, "low binary, high binary", "append", GroupStateTimeout.NoTimeout)


def progress(stream: DataFrame, key: str, value: str) -> DataFrame:
    """ST-3: counters per key."""
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.max(value).alias("latest"))


def enrich(stream: DataFrame, lexicon: DataFrame, col: str) -> DataFrame:
    """ST-4: stream-static join; unknown words stay."""
    return stream.join(lexicon.select(F.col("key").alias(col), "value"), col, "left").withColumn("value", F.coalesce("value", col))


def run_available(spark: SparkSession, streamed: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and returns its last result as a table."""
    out, checkpoint = fresh_path(spark, "stream"), fresh_path(spark, "stream-state")

    def batch(df: DataFrame, n: int) -> None:
        df.withColumn("_batch", F.lit(n)).write.mode("append").parquet(out)

    streamed.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out)
    if mode == "append":
        return got.drop("_batch")
    last = got.agg(F.max("_batch").alias("_batch"))
    return got.join(last, "_batch").drop("_batch")


def request_ledger(requests: DataFrame, replies: DataFrame, key: str, budget: str, valid: str, truncated: str, attempts=3, cap=80_000) -> DataFrame:
    """ST-5: each request's state: done, pending (with its next budget, doubled after a cut-off answer), or failed."""
    w = W.partitionBy(key).orderBy(F.desc("attempt"))
    last = replies.withColumn("_n", F.row_number().over(w)).withColumn("tries", F.count("*").over(W.partitionBy(key))).withColumn("_ok", F.max(F.col(valid).cast("int")).over(W.partitionBy(key))).where("_n = 1")
    got = requests.join(last.select(key, "tries", "_ok", F.col(truncated).alias("_cut")), key, "left")
    state = F.when(F.col("_ok") == 1, "done").when(F.coalesce("tries", F.lit(0)) >= attempts, "failed").otherwise("pending")
    following = F.when(F.col("_cut"), F.least(F.lit(cap), F.col(budget) * F.pow(F.lit(2), F.col("tries")).cast("long"))).otherwise(F.col(budget))
    return got.withColumn("state", state).withColumn("next_budget", F.when(state == "pending", following)).drop("_ok", "_cut")
