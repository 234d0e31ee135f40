"""Bucketed catalog tables: joins and folds on the bucket key need no shuffle."""

import uuid

import pytest
from pyspark.sql import functions as F

from wardbook.operators import billing as B
from wardbook.sources.tables import load_bucketed, save_bucketed

COLS = ["BillingID", "PatientID", "AppointmentID", "TotalCost", "InsuranceCoverage", "AmountOwed", "AmountPaid", "PaymentStatus", "BillingDate"]


@pytest.fixture()
def database(spark):
    name = f"clinic_{uuid.uuid4().hex[:8]}"
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # tables as large as they are meant to be
    yield name
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def exchanged(df, column):
    """The exchanges by ``column`` in the plan before any of it has run."""
    plan = df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan[1].splitlines() if "Exchange hashpartitioning" in line and f"({column}#" in line]


def test_bills_without_a_shuffle_by_appointment(spark, seed, database):
    save_bucketed(seed, database, buckets=4)
    T = load_bucketed(spark, database)
    assert set(T) == set(seed)
    for name in ("Appointment", "Treatment", "BillingRecord"):
        cols = seed[name].columns
        assert T[name].select(cols).exceptAll(seed[name].select(cols)).count() == 0 and T[name].count() == seed[name].count()
    derived = B.derive_billing(T, existing=T["BillingRecord"])
    assert not exchanged(derived, "AppointmentID") and len(exchanged(derived, "PatientID")) <= 2
    assert exchanged(B.derive_billing(seed, existing=seed["BillingRecord"]), "AppointmentID")
    plain = B.derive_billing(seed, existing=seed["BillingRecord"])
    assert derived.select(COLS).exceptAll(plain.select(COLS)).count() == 0 and derived.count() == plain.count()
    # B2: bills and derived bills meet in one full outer join
    merged = B.merge_billing(T["BillingRecord"], T["BillingRecord"], new_id=F.col("AppointmentID"))
    assert not exchanged(merged, "AppointmentID")


def test_a_new_version_replaces_nothing(spark, seed, database):
    save_bucketed({"Doctor": seed["Doctor"]}, database, buckets=2)
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        save_bucketed({"Doctor": seed["Doctor"]}, database, buckets=2)
    assert load_bucketed(spark, database, ["Doctor"])["Doctor"].count() == seed["Doctor"].count()
