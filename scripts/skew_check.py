"""Skew check: one patient holds a third of all appointments.

usage: python scripts/skew_check.py [n_appointments]

Builds synthetic clinic tables (3M appointments by default, a third of them
on patient 7), disables broadcasts so the shuffled path is taken, derives
the bills and runs the insurance report, and reports whether AQE's final
plan split the hot partition (``SortMergeJoin(skew=true)`` in the event log,
written to a fresh scratch folder). Also checks that no bill went missing.
"""

from __future__ import annotations

import glob
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from wardbook.operators import billing as B  # noqa: E402
from wardbook.operators import reports as R  # noqa: E402
from wardbook.session import ensure_defaults  # noqa: E402
from wardbook.sources.seed import sample_tables  # noqa: E402


def main() -> None:
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 3_000_000
    log_dir = tempfile.mkdtemp(prefix="run-skew-")
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
             .config("spark.eventLog.compress", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.shuffle.partitions", "32").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ensure_defaults(spark)
    for k, v in {"spark.sql.autoBroadcastJoinThreshold": "-1",
                 "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                 "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4MB",
                 "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4MB"}.items():
        spark.conf.set(k, v)
    T = dict(sample_tables(spark))
    T["Patient"] = spark.range(0, 1_000_000).select(
        F.col("id").alias("PatientID"), F.lit("A").alias("FirstName"), F.lit("B").alias("LastName"),
        F.lit(None).cast("date").alias("DOB"), F.lit(None).cast("string").alias("Gender"),
        F.lit(None).cast("string").alias("Phone"), F.lit(None).cast("string").alias("Address"),
        (F.col("id") % 6).cast("int").alias("ProviderID"))
    T["Appointment"] = spark.range(0, n).select(
        F.col("id").alias("AppointmentID"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 1_000_000).alias("PatientID"),
        (F.col("id") % 10 + 1).cast("int").alias("DoctorID"), F.lit(1).alias("NurseID"),
        F.lit("2026-01-01").cast("date").alias("AppointmentDate"), F.lit(0).alias("AppointmentTime"),
        F.lit("Completed").alias("Status"), F.lit(None).cast("string").alias("Purpose"))
    T["Treatment"] = spark.range(0, 2 * n).select(
        F.col("id").alias("TreatmentID"), F.lit(None).cast("long").alias("DiagnosisID"),
        (F.col("id") % n).alias("AppointmentID"), F.lit("t").alias("TreatmentName"),
        F.lit(None).cast("string").alias("Description"),
        ((F.col("id") % 50000) / 100).cast("decimal(10,2)").alias("TreatmentCost"))
    bills = B.derive_billing(T)
    t0 = time.perf_counter()
    bills.write.format("noop").mode("overwrite").save()
    t_derive = time.perf_counter() - t0
    T["BillingRecord"] = bills
    t0 = time.perf_counter()
    R.insurance_analysis(T).write.format("noop").mode("overwrite").save()
    t_r5 = time.perf_counter() - t0
    total = bills.count()
    spark.stop()
    text = "".join(open(f).read() for f in glob.glob(f"{log_dir}/**/*", recursive=True)
                   if os.path.isfile(f))
    print({"appointments": n, "bills": total, "derive_sec": round(t_derive, 2),
           "report_sec": round(t_r5, 2), "skew_split_joins": text.count("SortMergeJoin(skew=true")})


if __name__ == "__main__":
    main()
