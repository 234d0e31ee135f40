"""Streaming re-aims (B7, B8): keep bills and paid totals current from
micro-batches, with checkpoints under the shared ``spark.checkpoint.dir``.

What a stream has to remember is Structured Streaming state: running costs and paid
totals are sums in update mode, delivered event ids are ``dropDuplicates`` without a
watermark, so nothing is dropped for being late and Spark restores both after a
failure. A micro-batch gets the changed sums of its own keys and never reads what
earlier batches wrote. For states beyond the executors' memory set
``spark.sql.streaming.stateStore.providerClass`` to Spark's RocksDB provider.

The sinks hold one folder for each micro-batch (``batch=<id>``, overwritten when the batch is
replayed) with the whole rows it changed; the current table is the newest row of each key
and the base rows that no batch touched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from wardbook.functions.money import cents, from_cents
from wardbook.operators.billing import NO_BILL, TOTAL_RANGE, derive_billing, merge_billing, payment_fault
from wardbook.operators.changes import latest_per_key
from wardbook.schema import MONEY
from wardbook.session import scratch_path


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a parquet table exists at ``path`` (restart-safe: no driver state).
    Only a missing path, or a folder without a single data file (a batch of no
    rows), means no; an unreadable table is an error."""
    try:
        spark.read.parquet(path).schema
        return True
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def current_table(spark: SparkSession, base: DataFrame, deltas_path: str, key: str,
                  has_deltas: bool) -> DataFrame:
    """Merge-on-read: the latest row per key over the base and batch folders.

    A batch folder holds whole rows for the keys it touched, so the result is
    the newest batch row per key plus the base rows no batch touched. Only
    the batch rows are aggregated; the (large) base is filtered by an
    anti-join on the batch keys and never shuffled as a whole.
    """
    if not has_deltas:
        return base
    deltas = spark.read.parquet(deltas_path)  # partition column: batch
    cols = [c for c in base.columns if c != key]
    newest = latest_per_key(deltas.select(*base.columns, F.col("batch").cast("long")), key, cols,
                            seq="batch")
    untouched = base.join(newest.select(key), key, "left_anti")
    return untouched.unionByName(newest.select(*base.columns))


def _drained(stream: DataFrame, per_batch: Callable, checkpoint: str, trigger: dict | None, mode: str) -> None:
    q = (stream.writeStream.outputMode(mode).foreachBatch(per_batch)
         .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
    q.awaitTermination()


def touched_bills(costs: DataFrame, T: dict[str, DataFrame], last_id: int) -> DataFrame:
    """The bills of the appointments in ``costs`` (AppointmentID, TreatmentCost: the whole cost),
    merged with the bills at the stream's start. A new bill's id is the highest id at the
    start plus its AppointmentID: the same in every batch and replay, so no batch has to look up
    what an earlier one gave."""
    keys = costs.select("AppointmentID")
    old = T["BillingRecord"].join(keys, "AppointmentID", "left_semi")
    derived = derive_billing({**T, "Treatment": costs}, existing=old, keys=keys)
    return merge_billing(old, derived, new_id=F.lit(last_id) + F.col("AppointmentID"))


def stream_billing(spark: SparkSession, T: dict[str, DataFrame], treatment_stream: DataFrame,
                   root: str | None = None, trigger: dict | None = None,
                   to_treatment: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Treatment micro-batches keep billing current.

    ``T`` holds the tables at stream start (its Treatment and BillingRecord are the
    base). The cost of each appointment is a running sum in the stream's state, which
    the first batch fills with the base treatments' sums; a batch derives (B3) and
    writes the bills of the appointments it changes. A treatment without a cost that
    fits the column counts nothing. Returns the current billing after the stream
    drained (``availableNow`` by default).
    """
    root = root or scratch_path(spark, "stream-billing")
    base_path, start_path, bill_path = f"{root}/costs", f"{root}/start", f"{root}/bills"
    key, base_bill = "AppointmentID", T["BillingRecord"]
    kind = T["Treatment"].schema[key].dataType
    cost = cents(F.col("TreatmentCost").try_cast(MONEY)).alias("cents")
    if not _exists(spark, start_path):  # written last: a start that died before is done again
        T["Treatment"].select(key, cost).groupBy(key).agg(F.sum("cents").alias("cents")).write.mode("overwrite").parquet(base_path)
        base_bill.agg(F.coalesce(F.max("BillingID"), F.lit(0)).cast("long").alias("last_id")).write.mode("overwrite").parquet(start_path)
    last_id = spark.read.parquet(start_path).first()["last_id"]

    base = spark.readStream.schema(spark.read.parquet(base_path).schema).parquet(base_path)
    rows = to_treatment(treatment_stream) if to_treatment else treatment_stream
    added = rows.select(F.col(key).cast(kind).alias(key), cost, F.lit(True).alias("_new"))
    running = (base.withColumn("_new", F.lit(False)).unionByName(added).groupBy(key)
               .agg(F.sum("cents").alias("cents"), F.max("_new").alias("_new")))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        # written before it is used several times, so the state is updated once
        path = f"{root}/touched/batch={batch_id}"
        touched = batch.filter("_new").select(key, from_cents(F.col("cents")).alias("TreatmentCost"))
        touched.write.mode("overwrite").parquet(path)
        costs = spark.read.schema(touched.schema).parquet(path)
        touched_bills(costs, T, last_id).write.mode("overwrite").parquet(f"{bill_path}/batch={batch_id}")

    _drained(running, per_batch, f"{root}/_checkpoint", trigger, "update")
    return current_table(spark, base_bill, bill_path, key, _exists(spark, bill_path))


def stream_payments(spark: SparkSession, payment_stream: DataFrame, root: str | None = None,
                    key: str = "AppointmentID", trigger: dict | None = None) -> DataFrame:
    """Running paid total per bill from a payment event stream.

    No payment is dropped for being late: there is no watermark. A re-delivered
    event (same bill and ``event_id``) is known from the stream's state; an event
    without an id cannot be recognised and always counts. An event without a bill or
    an amount that fits its column, and a total that does not, stop nothing: they
    are rejects with a reason (``stream_payment_rejects``), and the bill keeps its last
    total that fits. Returns the current totals (key, AmountPaid) after the stream
    drained.
    """
    root = root or scratch_path(spark, "stream-payments")
    total_path = f"{root}/totals"
    rows = payment_stream.select("event_id", key, "Amount")
    fault = F.coalesce(F.when(F.col(key).isNull(), F.lit(NO_BILL)), payment_fault(F.col("Amount")))
    event = F.coalesce(F.col("event_id").cast("string"), F.expr("uuid()"))
    totals = (rows.filter(fault.isNull()).select(key, event.alias("_event"), cents(F.col("Amount").try_cast(MONEY)).alias("cents"))
              .dropDuplicates([key, "_event"]).groupBy(key).agg(F.sum("cents").alias("cents")))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        path = f"{root}/sums/batch={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        total = from_cents(F.col("cents"))
        sums = spark.read.schema(batch.schema).parquet(path).select(key, total.alias("total"), total.try_cast(MONEY).alias("AmountPaid"))
        sums.filter("AmountPaid IS NOT NULL").select(key, "AmountPaid").write.mode("overwrite").parquet(f"{total_path}/batch={batch_id}")
        (sums.filter("AmountPaid IS NULL").select(key, F.lit(None).cast("string").alias("event_id"), F.col("total").cast("string").alias("Amount"), F.lit(TOTAL_RANGE).alias("reason"))
         .write.mode("overwrite").parquet(f"{root}/over/batch={batch_id}"))

    def rejects(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rejects/batch={batch_id}")

    faulty = rows.withColumn("reason", fault).filter(F.col("reason").isNotNull()).select(key, F.col("event_id").cast("string").alias("event_id"), F.col("Amount").cast("string").alias("Amount"), "reason")
    _drained(faulty, rejects, f"{root}/_checkpoint_rejects", trigger, "append")
    _drained(totals, per_batch, f"{root}/_checkpoint", trigger, "update")
    empty = spark.createDataFrame([], f"{key} {payment_stream.schema[key].dataType.simpleString()}, AmountPaid decimal(10,2)")
    return current_table(spark, empty, total_path, key, _exists(spark, total_path))


def stream_payment_rejects(spark: SparkSession, root: str, key: str = "AppointmentID") -> DataFrame:
    """What ``stream_payments`` could not count under ``root``: (key, event_id, Amount as text, reason)."""
    out = None
    for name in ("rejects", "over"):
        if _exists(spark, f"{root}/{name}"):
            rows = spark.read.parquet(f"{root}/{name}").select(key, "event_id", "Amount", "reason")
            out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], f"{key} long, event_id string, Amount string, reason string")


def compact(spark: SparkSession, base: DataFrame, deltas_path: str, key: str,
            out_path: str | None = None) -> str:
    """Fold the batch folders into a new base table (latest row per key) and
    return its path. Run now and then so per-batch reads stay proportional to
    the changes, not to the number of batches; restart the stream with the
    new base and an empty delta folder."""
    out_path = out_path or scratch_path(spark, "compacted")
    current_table(spark, base, deltas_path, key, _exists(spark, deltas_path)) \
        .write.mode("overwrite").parquet(out_path)
    return out_path
