"""Hot keys: a third of all appointments on one doctor and on one patient.

Broadcasts are off and the skew thresholds low, so the shuffled and split
paths run; the reports must equal a plain fold of the same rows in pandas.
"""

import pytest
from pyspark.sql import functions as F

from wardbook.operators import billing as B
from wardbook.operators import reports as R

N = 60_000


@pytest.fixture()
def skewed(spark, seed):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    t = dict(seed)
    t["Patient"] = spark.range(0, 2000).select(
        F.col("id").cast("int").alias("PatientID"), F.lit("A").alias("FirstName"),
        F.lit("B").alias("LastName"), F.lit(None).cast("date").alias("DOB"),
        F.lit(None).cast("string").alias("Gender"), F.lit(None).cast("string").alias("Phone"),
        F.lit(None).cast("string").alias("Address"),
        F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 5 + 1).cast("int").alias("ProviderID"))
    t["Appointment"] = spark.range(0, N).select(
        F.col("id").cast("int").alias("AppointmentID"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 2000).cast("int").alias("PatientID"),
        F.when(F.col("id") % 3 == 1, F.lit(1)).otherwise(F.col("id") % 10 + 1).cast("int").alias("DoctorID"),
        F.lit(1).alias("NurseID"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 300).cast("int"))
        .alias("AppointmentDate"), F.lit(0).alias("AppointmentTime"),
        F.when(F.col("id") % 11 == 0, F.lit("Canceled")).otherwise(F.lit("Completed")).alias("Status"),
        F.lit(None).cast("string").alias("Purpose"))
    t["Treatment"] = spark.range(0, 2 * N).select(
        F.col("id").cast("int").alias("TreatmentID"), F.lit(None).cast("int").alias("DiagnosisID"),
        (F.col("id") % N).cast("int").alias("AppointmentID"), F.lit("t").alias("TreatmentName"),
        F.lit(None).cast("string").alias("Description"),
        ((F.col("id") * 37 % 100000) / 100).cast("decimal(10,2)").alias("TreatmentCost"))
    t["BillingRecord"] = B.derive_billing(t)
    yield t
    for k, v in old.items():
        spark.conf.set(k, v)


def folded(df, by, column):
    """{key: (rows, sum, mean, least, largest)} of a pandas column."""
    return {k: (len(v), v.sum(), v.mean(), v.min(), v.max()) for k, v in df.groupby(by)[column]}


def test_reports_equal_a_plain_fold_under_skew(skewed):
    appts = skewed["Appointment"].select("AppointmentID", "DoctorID").toPandas()
    bills = skewed["BillingRecord"].select("AppointmentID", "PatientID", *[F.col(c).cast("double") for c in ("TotalCost", "InsuranceCoverage", "AmountOwed")]).toPandas()
    doctors = skewed["Doctor"].toPandas().set_index("DoctorID")
    departments = skewed["Department"].toPandas().set_index("DepartmentID")["DepartmentName"]

    want = folded(bills.merge(appts, on="AppointmentID"), "DoctorID", "TotalCost")
    got = {r["DoctorName"]: r for r in R.doctor_workload(skewed).collect()}
    for d, (n, total, mean, least, most) in want.items():
        r = got[f"{doctors.FirstName[d]} {doctors.LastName[d]}"]
        assert r["TotalAppointments"] == n and (r["MinBill"], r["MaxBill"]) == (least, most)
        assert r["TotalRevenue"] == pytest.approx(total) and r["AvgRevenue"] == pytest.approx(mean)

    patients = skewed["Patient"].select("PatientID", "ProviderID").toPandas().dropna()
    providers = skewed["InsuranceProvider"].toPandas().set_index("ProviderID")["ProviderName"]
    want = folded(bills.merge(patients, on="PatientID"), "ProviderID", "InsuranceCoverage")
    got = {r["ProviderName"]: r for r in R.insurance_analysis(skewed).collect()}
    for p, (n, total, mean, least, most) in want.items():
        r = got[providers[p]]
        assert (r["TotalPatients"], r["TotalClaims"], r["MinCoverage"], r["MaxCoverage"]) == ((patients.ProviderID == p).sum(), n, least, most)
        assert r["TotalCovered"] == pytest.approx(total) and r["AvgCoverage"] == pytest.approx(mean)

    costs = skewed["Treatment"].select("AppointmentID", F.col("TreatmentCost").cast("double")).toPandas().merge(appts, on="AppointmentID")
    costs["name"] = costs.DoctorID.map(doctors.DepartmentID).map(departments)
    want = folded(costs.dropna(), "name", "TreatmentCost")
    got = {r["DepartmentName"]: r for r in R.treatment_by_dept(skewed).collect()}
    assert set(got) == set(want)
    for k, (n, total, mean, least, most) in want.items():
        r = got[k]
        assert (r["TotalTreatments"], r["MinCost"], r["MaxCost"]) == (n, least, most)
        assert r["TotalCost"] == pytest.approx(total) and r["AvgCost"] == pytest.approx(mean)
    assert skewed["BillingRecord"].count() == N
    hot = sum(1 for i in range(N) if i % 3 == 0 or i % 2000 == 7)  # a third, plus its own share
    assert skewed["BillingRecord"].filter("PatientID = 7").count() == hot
