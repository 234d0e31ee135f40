"""Billing derivation, merge, refresh, payments: self-check, edge cases, properties."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from wardbook.operators import billing as B

COLS = ["PatientID", "AppointmentID", "TotalCost", "InsuranceCoverage", "AmountOwed",
        "AmountPaid", "PaymentStatus", "BillingDate"]


def by_appt(df):
    return {r["AppointmentID"]: r.asDict() for r in df.collect()}


def test_derivation_reproduces_seed_bills(seed):
    d = B.derive_billing(seed, existing=seed["BillingRecord"]).select(COLS)
    stored = seed["BillingRecord"].select(COLS)
    assert d.exceptAll(stored).count() == 0 and stored.exceptAll(d).count() == 0


def test_owed_plus_coverage_is_total(seed):
    d = B.derive_billing(seed)
    bad = d.filter(F.col("AmountOwed") + F.col("InsuranceCoverage") != F.col("TotalCost"))
    assert bad.count() == 0


def _tables(spark, seed, appts, treats, patients=None, bills=None):
    t = dict(seed)
    t["Appointment"] = spark.createDataFrame(appts, seed["Appointment"].schema)
    t["Treatment"] = spark.createDataFrame(treats, seed["Treatment"].schema)
    if patients is not None:
        t["Patient"] = spark.createDataFrame(patients, seed["Patient"].schema)
    t["BillingRecord"] = spark.createDataFrame(bills or [], seed["BillingRecord"].schema)
    return t


D1 = dt.date(2026, 6, 1)


def _appt(aid, pid, status="Completed", date=D1):
    return (aid, pid, 1, 1, date, 32400, status, "x")


def _treat(tid, aid, cost):
    return (tid, None, aid, "t", None, Decimal(cost))


def _bill(bid, pid, aid, total, cov, owed, paid, status):
    return (bid, pid, aid, Decimal(total), Decimal(cov), Decimal(owed), Decimal(paid), status,
            None, D1, None)


def _patient(pid, provider):
    return (pid, "A", "B", None, None, None, None, provider)


def test_edge_cases_of_derivation(spark, seed):
    patients = [_patient(100, None), _patient(101, 1), _patient(102, 4)]
    appts = [_appt(1000, 100), _appt(1001, 101), _appt(1002, 101, "Canceled"),
             _appt(1003, 101, "Canceled"), _appt(1004, 101, "Canceled"), _appt(1005, 102),
             _appt(1006, None), _appt(1007, 101, date=None)]
    treats = [_treat(1, 1000, "100.00"), _treat(2, 1002, "100.00"), _treat(3, 1003, "100.00"),
              _treat(4, 1004, "100.00"), _treat(5, 1005, "7.15")]
    bills = [_bill(1, 101, 1002, "100.00", "80.00", "20.00", "5.00", "Canceled"),
             _bill(2, 101, 1003, "100.00", "80.00", "20.00", "20.00", "Canceled")]
    t = _tables(spark, seed, appts, treats, patients, bills)
    got = by_appt(B.derive_billing(t, existing=t["BillingRecord"]))
    # no provider: 70 % coverage
    assert got[1000]["InsuranceCoverage"] == Decimal("70.00") and got[1000]["AmountOwed"] == Decimal("30.00")
    # no treatments: total 0, Paid
    assert got[1001]["TotalCost"] == Decimal("0.00") and got[1001]["PaymentStatus"] == "Paid"
    # a payment overrides Canceled
    assert got[1002]["AmountOwed"] == Decimal("20.00") and got[1002]["PaymentStatus"] == "Partial"
    assert got[1003]["PaymentStatus"] == "Paid"
    assert got[1004]["PaymentStatus"] == "Canceled"
    # 5.005 rounds away from zero
    assert got[1005]["InsuranceCoverage"] == Decimal("5.01")
    # rejected rows
    assert 1006 not in got and 1007 not in got
    rej = {r["AppointmentID"]: r["RejectReason"] for r in B.billing_rejects(
        t, keys=spark.createDataFrame([(1006,), (1007,), (9999,)], "AppointmentID int")).collect()}
    assert rej == {1006: "no patient", 1007: "no billing date", 9999: "unknown appointment"}


def test_merge_keeps_patient_and_paid_and_is_idempotent(spark, seed):
    bills = seed["BillingRecord"].withColumn(
        "PatientID", F.when(F.col("AppointmentID") == 1, F.lit(2)).otherwise(F.col("PatientID")))
    t = dict(seed)
    t["BillingRecord"] = bills
    d = B.derive_billing(t, existing=bills)
    once = B.merge_billing(bills, d, now=F.lit(None))
    r = by_appt(once)[1]
    assert r["PatientID"] == 2 and r["AmountPaid"] == Decimal("30.00") and r["PaymentMethod"] == "Card"
    t2 = dict(t)
    t2["BillingRecord"] = once
    twice = B.merge_billing(once, B.derive_billing(t2, existing=once), now=F.lit(None))
    cols = [c for c in once.columns if c != "UpdatedAt"]
    assert once.select(cols).exceptAll(twice.select(cols)).count() == 0


def test_merge_inserts_new_bills_with_next_ids(spark, seed):
    bills = seed["BillingRecord"].filter(F.col("AppointmentID") <= 20)
    d = B.derive_billing(seed, existing=bills)
    merged = by_appt(B.merge_billing(bills, d, now=F.lit(None)))
    assert len(merged) == 30
    new_ids = sorted(merged[a]["BillingID"] for a in range(21, 31))
    max_kept = max(r["BillingID"] for r in bills.collect())  # 21: ids follow file order
    assert new_ids == list(range(max_kept + 1, max_kept + 11))
    assert all(merged[a]["AmountPaid"] == Decimal("0.00") for a in range(21, 31))


def test_refresh_on_changed_keys_equals_full_derivation(spark, seed):
    t = dict(seed)
    extra = spark.createDataFrame([_treat(31, 5, "40.00"), _treat(32, 9, "10.00")],
                                  seed["Treatment"].schema)
    t["Treatment"] = seed["Treatment"].unionByName(extra)
    refreshed = B.refresh_billing(t, extra, now=F.lit(None)).select(COLS)
    full = B.derive_billing(t, existing=seed["BillingRecord"]).select(COLS)
    assert refreshed.exceptAll(full).count() == 0 and full.exceptAll(refreshed).count() == 0
    assert by_appt(refreshed)[5]["TotalCost"] == Decimal("160.00")


def test_apply_payments(spark, seed):
    bills = spark.createDataFrame(
        [_bill(1, 1, 1, "0.00", "0.00", "0.00", "0.00", "Paid"),
         _bill(2, 1, 2, "100.00", "80.00", "20.00", "0.00", "Canceled"),
         _bill(3, 1, 3, "100.00", "80.00", "20.00", "0.00", "Unpaid"),
         _bill(4, 1, 4, "100.00", "80.00", "20.00", "0.00", "Unpaid")],
        seed["BillingRecord"].schema).withColumn("PaymentMethod", F.lit("Cash"))
    ledger = spark.createDataFrame(
        [(1, Decimal("0.00"), "", 1), (2, Decimal("25.00"), "Card", 2),
         (3, Decimal("5.00"), "", 3), (3, Decimal("1.00"), "Card", 4), (3, Decimal("1.00"), "", 5)],
        "BillingID int, Amount decimal(10,2), PaymentMethod string, seq int")
    got = {r["BillingID"]: r for r in B.apply_payments(bills, ledger, seq="seq").collect()}
    assert got[1]["PaymentStatus"] == "Paid" and got[1]["PaymentMethod"] == "Cash"
    assert got[2]["PaymentStatus"] == "Paid" and got[2]["AmountPaid"] == Decimal("25.00")
    assert got[3]["PaymentStatus"] == "Partial" and got[3]["AmountPaid"] == Decimal("7.00")
    assert got[3]["PaymentMethod"] == "Card"
    assert got[4]["PaymentStatus"] == "Unpaid"


def test_set_status_and_approve(spark, seed):
    ch = spark.createDataFrame([(4, "Paid", None), (8, None, "")],
                               "BillingID int, PaymentStatus string, PaymentMethod string")
    got = {r["BillingID"]: r for r in B.set_status(seed["BillingRecord"], ch).collect()}
    assert got[4]["PaymentStatus"] == "Paid"
    assert got[8]["PaymentStatus"] == "Partial" and got[8]["PaymentMethod"] == "Cash"
    appts = seed["Appointment"].withColumn(
        "Status", F.when(F.col("AppointmentID") == 3, F.lit("Requested")).otherwise(F.col("Status")))
    assert B.approve_requests(appts).filter(F.col("Status") == "Requested").count() == 0


def test_regenerate_repairs_stale_bills(spark, seed):
    stale = seed["BillingRecord"].withColumn(
        "TotalCost", F.when(F.col("AppointmentID") == 6, F.lit(Decimal("1.00"))).otherwise(F.col("TotalCost")))
    t = dict(seed)
    t["BillingRecord"] = stale
    keys = spark.createDataFrame([(6,)], "AppointmentID int")
    got = by_appt(B.regenerate_billing(t, keys, now=F.lit(None)))
    assert got[6]["TotalCost"] == Decimal("300.00") and len(got) == 30


def test_unmatched_changes(spark, seed):
    ledger = spark.createDataFrame([(4, Decimal("1.00")), (99, Decimal("2.00"))],
                                   "BillingID int, Amount decimal(10,2)")
    assert [r["BillingID"] for r in B.unmatched_changes(seed["BillingRecord"], ledger).collect()] == [99]
    assert B.apply_payments(seed["BillingRecord"], ledger).count() == 30


def test_cents_are_exact_for_doubles_and_wider_scales(spark):
    from wardbook.functions.money import money_sum
    d = spark.createDataFrame([(0.29, Decimal("1.2399")), (0.57, Decimal("0.0050"))], "x double, y decimal(12,4)")
    r = d.select(money_sum(F.col("x")), money_sum(F.col("y"))).first()
    assert (r[0], r[1]) == (Decimal("0.86"), Decimal("1.25"))


def test_one_oversized_bill_is_rejected_alone(spark, seed):
    T = dict(seed)
    huge = seed["Treatment"].where("AppointmentID = 1").limit(1).withColumn("TreatmentCost", F.lit("99999999.00").cast("decimal(10,2)"))
    T["Treatment"] = seed["Treatment"].unionByName(huge).unionByName(huge.withColumn("TreatmentID", F.col("TreatmentID") + 1000))
    assert B.derive_billing(T).count() == 29
    assert [tuple(r) for r in B.billing_rejects(T).collect()] == [(1, "total out of range")]


def test_payment_method_rule(spark, seed):
    """The last non-empty method by seq; NULL seq first; ties and no seq by the method itself."""
    bills = seed["BillingRecord"].where("BillingID <= 2")
    ledger = spark.createDataFrame([(1, Decimal("1"), "Cash", 2), (1, Decimal("1"), "Card", 2), (1, Decimal("1"), "", 9), (1, Decimal("1"), "Wire", None), (2, Decimal("1"), "Wire", None)],
                                   "BillingID long, Amount decimal(10,2), PaymentMethod string, seq int")
    got = {r["BillingID"]: r["PaymentMethod"] for r in B.apply_payments(bills, ledger, seq="seq").collect()}
    assert got == {1: "Cash", 2: "Wire"}
    assert {r["BillingID"]: r["PaymentMethod"] for r in B.apply_payments(bills, ledger.drop("seq")).collect()}[1] == "Wire"


def test_statuses_without_regard_to_case(spark, seed):
    from wardbook.operators.listings import payable_bills
    a = seed["Appointment"].where("AppointmentID = 1").withColumn("Status", F.lit("requested "))
    assert B.approve_requests(a).first()["Status"] == "requested " and B.approve_requests(a, ci=True).first()["Status"] == "Scheduled"
    b = seed["BillingRecord"].where("AmountOwed > AmountPaid").limit(1).withColumn("PaymentStatus", F.lit("CANCELED"))
    assert payable_bills(b).count() == 1 and payable_bills(b, ci=True).count() == 0
