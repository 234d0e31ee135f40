"""Streaming billing over several micro-batches, payments stream, table I/O."""

from decimal import Decimal

from pyspark.sql import functions as F

from wardbook.functions import scalars as S
from wardbook.operators import billing as B
from wardbook.operators.changes import with_defaults
from wardbook.session import scratch_path
from wardbook.sources.tables import load_tables, save_tables
from wardbook.streaming.billing_stream import stream_billing, stream_payments

COLS = ["BillingID", "PatientID", "AppointmentID", "TotalCost", "InsuranceCoverage",
        "AmountOwed", "AmountPaid", "PaymentStatus", "BillingDate"]


def test_stream_billing_in_three_batches(spark, seed):
    src_dir = scratch_path(spark, "treat-src")
    treat = seed["Treatment"]
    for i, lo in enumerate((1, 11, 21)):
        (treat.filter((F.col("TreatmentID") >= lo) & (F.col("TreatmentID") < lo + 10))
         .coalesce(1).write.parquet(f"{src_dir}/part{i}"))
    base = dict(seed)
    base["Treatment"] = treat.limit(0)
    # bills exist for appointments 1..20 only; 21..30 must be inserted with new ids
    base["BillingRecord"] = seed["BillingRecord"].filter("AppointmentID <= 20")
    stream = (spark.readStream.schema(treat.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src_dir))
    got = stream_billing(spark, base, stream)
    expect_t = dict(seed)
    expect_t["BillingRecord"] = base["BillingRecord"]
    expect = B.derive_billing(expect_t, existing=base["BillingRecord"])
    cols = [c for c in COLS if c != "BillingID"]
    assert got.select(cols).exceptAll(expect.select(cols)).count() == 0
    assert expect.select(cols).exceptAll(got.select(cols)).count() == 0
    ids = sorted(r["BillingID"] for r in got.collect())
    assert len(set(ids)) == 30  # new bills never reuse an existing id


def test_stream_payments_dedupes(spark):
    src_dir = scratch_path(spark, "pay-src")
    rows = [(1, 10, Decimal("5.00")), (2, 10, Decimal("2.50")), (2, 10, Decimal("2.50")),
            (3, 11, Decimal("1.00"))]
    df = spark.createDataFrame(rows, "event_id long, AppointmentID long, Amount decimal(12,2)")
    df = df.withColumn("ts", F.to_timestamp(F.lit("2026-01-01 10:00:00")))
    df.coalesce(1).write.parquet(src_dir)
    stream = spark.readStream.schema(df.schema).parquet(src_dir)
    got = {r["AppointmentID"]: r["AmountPaid"] for r in stream_payments(spark, stream).collect()}
    assert got == {10: Decimal("7.50"), 11: Decimal("1.00")}


def test_late_payments_count(spark):
    """Two runs over one checkpoint: an older, different payment counts; a re-delivery does not."""
    src, root = scratch_path(spark, "pay-late"), scratch_path(spark, "pay-root")
    schema = "event_id long, AppointmentID long, Amount decimal(12,2), ts timestamp"

    def deliver(rows):
        (spark.createDataFrame([(i, k, Decimal(a)) for i, k, a, _ in rows], "event_id long, AppointmentID long, Amount decimal(12,2)")
         .withColumn("ts", F.to_timestamp(F.lit(rows[0][3]))).coalesce(1).write.mode("append").parquet(src))
        stream = spark.readStream.schema(schema).parquet(src)
        return {r["AppointmentID"]: r["AmountPaid"] for r in stream_payments(spark, stream, root=root).collect()}

    assert deliver([(1, 10, "5.00", "2026-01-10")]) == {10: Decimal("5.00")}
    assert deliver([(2, 10, "7.00", "2026-01-05")]) == {10: Decimal("12.00")}
    assert deliver([(1, 10, "5.00", "2026-01-10"), (None, 10, "0.50", "2026-01-10"), (None, 10, "0.50", "2026-01-10"), (1, 11, "1.00", "")]) == {
        10: Decimal("13.00"), 11: Decimal("1.00")}


def test_a_poison_payment_stops_nothing(spark):
    """Payments that do not fit are rejects, in every batch; the stream goes on, and goes on after a restart."""
    from wardbook.streaming.billing_stream import stream_payment_rejects
    src, root = scratch_path(spark, "pay-poison"), scratch_path(spark, "pay-root")
    schema = "event_id long, AppointmentID long, Amount decimal(30,2)"

    def deliver(*rows):
        spark.createDataFrame([(i, k, None if a is None else Decimal(a)) for i, k, a in rows], schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        return {r["AppointmentID"]: r["AmountPaid"] for r in stream_payments(spark, stream, root=root).collect()}

    assert deliver((1, 10, "5.00"), (2, 10, "123456789012345678.00"), (3, 11, None), (4, None, "1.00")) == {10: Decimal("5.00")}
    assert deliver((5, 10, "99999999.00"), (6, 12, "1.00")) == {10: Decimal("5.00"), 12: Decimal("1.00")}  # together beyond the column
    assert deliver((7, 10, "-50.00")) == {10: Decimal("99999954.00"), 12: Decimal("1.00")}
    rejects = {(r["AppointmentID"], r["event_id"], r["Amount"], r["reason"]) for r in stream_payment_rejects(spark, root).collect()}
    assert rejects == {(10, "2", "123456789012345678.00", "amount out of range"), (11, "3", None, "no amount"), (None, "4", "1.00", "unknown bill"),
                       (10, None, "100000004.00", "total out of range")}


def test_batch_rejects_of_payments(spark, seed):
    """One oversized payment leaves its bill as it was, and all others go on."""
    rows = [(1, "1.00"), (1, "99999999999999.99"), (2, "99999999.99"), (2, "99999999.99"), (3, None), (999, "1.00"), (4, "2.00")]
    ledger = spark.createDataFrame([(b, None if a is None else Decimal(a)) for b, a in rows], "BillingID int, Amount decimal(30,2)")
    bills = seed["BillingRecord"]
    before = {r["BillingID"]: r["AmountPaid"] for r in bills.collect()}
    after = {r["BillingID"]: r["AmountPaid"] for r in B.apply_payments(bills, ledger).collect()}
    assert {k: v - before[k] for k, v in after.items() if v != before[k]} == {1: Decimal("1.00"), 4: Decimal("2.00")}
    reasons = sorted((r["BillingID"], r["reason"]) for r in B.payment_rejects(bills, ledger).collect())
    assert reasons == [(1, "amount out of range"), (2, "total out of range"), (2, "total out of range"), (3, "no amount"), (999, "unknown bill")]
    paid = {r["BillingID"]: r["AmountPaid"] for r in B.paid_per_appointment(ledger, key="BillingID").collect()}
    assert paid == {1: Decimal("1.00"), 2: None, 3: None, 4: Decimal("2.00"), 999: Decimal("1.00")}


def test_billing_batches_stay_alike(spark, seed):
    """Ten batches over one appointment, with a restart between: the cost runs on, new bills keep
    their ids, and no batch reads what the batches before it wrote."""
    from wardbook.streaming.billing_stream import touched_bills
    src, root = scratch_path(spark, "ten-src"), scratch_path(spark, "ten-root")
    base = dict(seed)
    base["BillingRecord"] = seed["BillingRecord"].filter("AppointmentID <> 6")
    treat = seed["Treatment"].filter("TreatmentID = 6").withColumn("AppointmentID", F.lit(6))
    start = {r["AppointmentID"]: r["s"] for r in seed["Treatment"].groupBy("AppointmentID").agg(F.sum("TreatmentCost").alias("s")).collect()}
    last = base["BillingRecord"].agg(F.max("BillingID")).first()[0]

    def run(n):
        for _ in range(n):
            treat.withColumn("TreatmentCost", F.lit("1.50").cast("decimal(10,2)")).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(treat.schema).option("maxFilesPerTrigger", 1).parquet(src)
        got = stream_billing(spark, base, stream, root=root)
        assert got.count() == seed["BillingRecord"].count()
        return [(r["BillingID"], r["TotalCost"]) for r in got.filter("AppointmentID = 6").collect()]

    assert run(5) == [(last + 6, start[6] + Decimal("7.50"))]
    assert run(5) == [(last + 6, start[6] + Decimal("15.00"))]
    assert spark.read.parquet(f"{root}/bills").groupBy("batch").count().filter("count = 1").count() == 10
    costs = spark.createDataFrame([(6, Decimal("3.00"))], "AppointmentID int, TreatmentCost decimal(20,2)")
    assert not [f for f in touched_bills(costs, base, last).inputFiles() if root in f]


def test_a_treatment_that_does_not_fit(spark, seed):
    src = scratch_path(spark, "treat-poison")
    rows = seed["Treatment"].select(*[F.col(c).cast("decimal(30,2)").alias(c) if c == "TreatmentCost" else F.col(c) for c in seed["Treatment"].columns])
    one = rows.filter("TreatmentID = 1")
    one.withColumn("TreatmentCost", F.lit("12345678901234567.00").cast("decimal(30,2)")).unionByName(one.withColumn("TreatmentCost", F.lit("2.00").cast("decimal(30,2)"))).write.parquet(src)
    got = stream_billing(spark, seed, spark.readStream.schema(rows.schema).parquet(src))
    key = one.first()["AppointmentID"]
    old = seed["Treatment"].filter(F.col("AppointmentID") == key).agg(F.sum("TreatmentCost")).first()[0]
    assert got.filter(F.col("AppointmentID") == key).first()["TotalCost"] == old + Decimal("2.00")


def test_registered_streams_read_part_files(spark, tmp_path):
    """Tables stored as folders of part files give the same as single files."""
    import os

    from wardbook.plans.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    for name in os.listdir(sf):
        os.symlink(f"{sf}/{name}", tmp_path / name) if name not in ("lineitem.parquet", "events.parquet") else \
            spark.read.parquet(f"{sf}/{name}").repartition(3).write.parquet(str(tmp_path / name))
    for q in ("stream_billing", "stream_payments"):
        one, parts = (QUERIES[q](spark, d) for d in (sf, str(tmp_path)))
        cols = [c for c in one.columns if c != "UpdatedAt"]
        assert one.count() == parts.count() > 0
        assert one.select(cols).exceptAll(parts.select(cols)).count() == 0
    batch = QUERIES["billing_derive"](spark, sf).agg(F.sum("TotalCost")).first()[0]
    assert abs(QUERIES["stream_billing"](spark, str(tmp_path)).agg(F.sum("TotalCost")).first()[0] - batch) < 0.01


def test_save_refuses_an_existing_folder(spark, seed):
    """Loading a version, changing it and saving over it must not destroy what is read."""
    import pytest
    root = scratch_path(spark, "versions")
    save_tables({"Department": seed["Department"]}, f"{root}/v1")
    changed = load_tables(spark, f"{root}/v1", names=["Department"])["Department"].where("DepartmentID > 2")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        save_tables({"Department": changed}, f"{root}/v1")
    save_tables({"Department": changed}, f"{root}/v2")
    assert spark.read.parquet(f"{root}/v1/Department").count() == seed["Department"].count()


def test_save_and_load_tables(spark, seed):
    root = scratch_path(spark, "tables")
    paths = save_tables({k: seed[k] for k in ("Patient", "BillingRecord")}, root)
    assert set(paths) == {"Patient", "BillingRecord"}
    back = load_tables(spark, root, names=["Patient", "BillingRecord"])
    assert back["Patient"].count() == 30
    assert back["BillingRecord"].select(COLS).exceptAll(seed["BillingRecord"].select(COLS)).count() == 0
    # an older layout without a column comes back with it as NULL
    seed["Patient"].drop("Gender").write.parquet(f"{root}/old/Patient")
    old = load_tables(spark, f"{root}/old", names=["Patient"])["Patient"]
    assert "Gender" in old.columns and old.filter(F.col("Gender").isNotNull()).count() == 0


def test_defaults_and_small_scalars(spark, seed):
    appts = seed["Appointment"].withColumn(
        "Status", F.when(F.col("AppointmentID") == 1, F.lit(None)).otherwise(F.col("Status")))
    filled = with_defaults(appts, "Appointment")
    assert filled.filter("AppointmentID = 1").collect()[0]["Status"] == "Scheduled"
    df = spark.createDataFrame([(None, "", "admin"), ("Card", "x", "janitor")], "m string, e string, r string")
    got = df.select(S.default_if_missing(F.col("m"), "Cash"), S.default_if_empty(F.col("e"), "old"),
                    S.role_allowed(F.col("r"))).collect()
    assert tuple(got[0]) == ("Cash", "old", True) and tuple(got[1]) == ("Card", "x", False)


def test_partitioned_save_and_compact(spark, seed):
    from wardbook.streaming.billing_stream import compact
    root = scratch_path(spark, "parts")
    save_tables({"Appointment": seed["Appointment"]}, root,
                partition_by={"Appointment": ["AppointmentDate"]})
    back = spark.read.parquet(f"{root}/Appointment")
    assert back.filter("AppointmentDate = DATE'2026-04-21'").count() == 2
    deltas = scratch_path(spark, "deltas")
    seed["BillingRecord"].filter("BillingID = 4").withColumn("PaymentStatus", F.lit("Unpaid")) \
        .write.parquet(f"{deltas}/batch=0")
    out = spark.read.parquet(compact(spark, seed["BillingRecord"], deltas, "AppointmentID"))
    assert out.count() == 30
    assert out.filter("AppointmentID = 1").collect()[0]["PaymentStatus"] == "Unpaid"


def test_register_views(spark, seed):
    from wardbook.sources.tables import register_views
    assert "BillingRecord" in register_views(seed)
    got = {r[0]: r[1] for r in spark.sql(
        "SELECT PaymentStatus, COUNT(*) FROM BillingRecord GROUP BY PaymentStatus").collect()}
    assert got == {"Paid": 15, "Unpaid": 8, "Partial": 4, "Canceled": 3}


def test_command_line(spark, seed):
    from wardbook.__main__ import main
    root = scratch_path(spark, "cli")
    save_tables(seed, f"{root}/tables")
    assert main(["reports", "--tables", f"{root}/tables", "--out", f"{root}/reports"]) == 0
    kpi = spark.read.json(f"{root}/reports/kpis").collect()[0]
    assert kpi["TotalBillings"] == 30 and kpi["InsuredSharePct"] == 77
    assert spark.read.json(f"{root}/reports/billing_by_status").count() == 4
    spark.createDataFrame([(6,)], "AppointmentID int").write.parquet(f"{root}/changes")
    assert main(["refresh-billing", "--tables", f"{root}/tables", "--changes", f"{root}/changes",
                 "--out", f"{root}/v2"]) == 0
    assert spark.read.parquet(f"{root}/v2/BillingRecord").count() == 30
