"""One quality profile of a table's column rules, counted while its rows are written."""

from pyspark.sql import functions as F

from wardbook.operators import checks as V
from wardbook.session import scratch_path


def test_counts_equal_the_single_checks(spark, seed):
    p = seed["Patient"].withColumn("LastName", F.when(F.col("PatientID") % 4 > 0, F.col("LastName"))).withColumn("Phone", F.repeat(F.lit("5"), F.col("PatientID")))
    path = scratch_path(spark, "profiled")
    got = {r["rule"]: r["broken"] for r in V.quality_profile(p, "Patient", path).collect()}
    assert got["LastName is NULL"] == V.null_violations(p, ["LastName"]).count() > 0
    assert got["Phone longer than 15"] == V.too_long(p, {"Phone": 15}).count() > 0
    assert sum(got.values()) == got["LastName is NULL"] + got["Phone longer than 15"]
    back = spark.read.parquet(path)
    assert back.exceptAll(p).count() == 0 and back.count() == p.count()


def test_one_job_for_all_rules(spark, seed):
    """The rules are columns of one aggregate over the rows on their way: nothing is scanned twice."""
    rows, seen = V.observed(seed["BillingRecord"], "BillingRecord", {"paid too much": F.col("AmountPaid") > F.col("AmountOwed")})
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CollectMetrics") == 1 and "Exchange" not in plan
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == 30 and seen.get["paid too much"] == 0 and len(seen.get) == 2 + len(V.column_rules("BillingRecord", rows.columns))


def test_an_empty_table(spark, seed):
    assert {(r["rows"], r["broken"]) for r in V.quality_profile(seed["Doctor"].limit(0), "Doctor").collect()} == {(0, 0)}
