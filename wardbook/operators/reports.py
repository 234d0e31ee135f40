"""The standard reports.

Plan shape: every report aggregates the big fact tables *before* joining
them to the dimensions (treatments per appointment, appointments per
doctor, bills per patient). Partial aggregation folds hot keys map-side, so
a doctor holding a third of all appointments costs one row per map task,
and the dimension joins see one row per dimension key. Spark picks
broadcast or sort-merge for those joins by its own size check.

``report_folds`` makes all these folds in one pass: one row for each appointment with its
bill and its treatments' sums, and GROUPING SETS over it by status, doctor, patient and
in total. Every report takes such ``folds`` instead of folding its tables itself.

Money stays exact DECIMAL inside; averages are returned as
``CAST(SUM(x) AS DOUBLE) / COUNT(x)``, and money leaves as DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardbook.functions.money import cents_sum, from_cents
from wardbook.functions.scalars import text_key
from wardbook.operators.billing import derive_billing
from wardbook.session import cut_lineage

Tables = dict[str, DataFrame]
Folds = dict[str, DataFrame]


def _money(c: Column) -> Column:
    return c.cast("double")


def _money_cents(c: Column) -> Column:
    """A BIGINT cents total leaves as DOUBLE dollars (exact decimal in between)."""
    return from_cents(c).cast("double")


def _avg_cents(cents_col: Column, cnt_col: Column) -> Column:
    return F.when(cnt_col > 0, from_cents(cents_col).cast("double") / cnt_col)


def _count_if_known(cond: Column, value: Column) -> Column:
    """SUM(boolean) semantics: 1/0 per row, NULL when the value is NULL."""
    return F.when(cond, F.lit(1)).when(value.isNotNull(), F.lit(0))


def treatment_sums(treatments: DataFrame) -> DataFrame:
    """The treatments of each appointment: counts, exact cost in cents, smallest and largest."""
    return treatments.groupBy("AppointmentID").agg(
        F.count("TreatmentID").alias("_n_id"), F.count("TreatmentCost").alias("_n_cost"),
        cents_sum(F.col("TreatmentCost")).alias("_sum"), F.min("TreatmentCost").alias("_min"),
        F.max("TreatmentCost").alias("_max"))


def _visits(s: Column) -> list[Column]:
    return [F.count("AppointmentID").alias("_cnt"),
            F.sum(_count_if_known(s == "Completed", s)).alias("_completed"),
            F.sum(_count_if_known(s.isin("Scheduled", "Requested"), s)).alias("_scheduled"),
            F.sum(_count_if_known(s == "Canceled", s)).alias("_canceled"),
            F.min("AppointmentDate").alias("_first"),
            F.max("AppointmentDate").alias("_last")]


def report_folds(T: Tables, ci: bool = False, paid: DataFrame | None = None) -> Folds:
    """The folds that R1 to R8 start from, by one scan of Treatment, Appointment and BillingRecord.

    Appointments, their bills (at most one each) and their treatments' sums meet in one full
    outer join on AppointmentID; GROUPING SETS then fold the rows by payment status, doctor,
    the bill's patient, and in total. The folds (a row for each group) are stored once in the
    checkpoint folder. With ``paid`` (AppointmentID, AmountPaid) the bills are derived (B1)
    from the same sums of treatments instead of read from ``T``.
    """
    sums = treatment_sums(T["Treatment"])
    if paid is None:
        bills = T["BillingRecord"]
    else:
        sums = cut_lineage(sums)  # read twice
        costs = sums.select("AppointmentID", from_cents(F.col("_sum")).alias("TreatmentCost"))
        bills = derive_billing({**T, "Treatment": costs}, existing=paid)
    money = ["TotalCost", "InsuranceCoverage", "AmountOwed", "AmountPaid"]
    b = bills.select("AppointmentID", "BillingID", F.col("PatientID").alias("_payer"), "PaymentStatus", *money)
    a = T["Appointment"].select("AppointmentID", F.col("AppointmentID").alias("_appt"), "DoctorID", "Status", "AppointmentDate")
    rows = a.join(b, "AppointmentID", "full_outer").join(sums, "AppointmentID", "full_outer").drop("AppointmentID")
    rows = rows.withColumnRenamed("_appt", "AppointmentID").withColumn("PaymentStatus", F.when(F.col("BillingID").isNotNull(), F.col("PaymentStatus")))
    by = ["PaymentStatus", "DoctorID", "_payer"]
    g = cut_lineage(rows.groupingSets([[c] for c in by] + [[]], *by).agg(
        F.grouping_id().alias("_set"), F.count("BillingID").alias("_bills"),
        *[cents_sum(F.col(c)).alias(f"_c_{c}") for c in money],
        cents_sum(F.col("AmountOwed") - F.col("AmountPaid")).alias("_out"),
        F.count("TotalCost").alias("_n"), F.min("TotalCost").alias("_min"), F.max("TotalCost").alias("_max"),
        F.count("InsuranceCoverage").alias("_n_cov"), F.min("InsuranceCoverage").alias("_min_cov"), F.max("InsuranceCoverage").alias("_max_cov"),
        *_visits(text_key(F.col("Status"), ci)),
        *[F.sum(c).alias(f"_t{c}") for c in ("_n_id", "_n_cost", "_sum")], F.count("_n_id").alias("_t_rows"),
        F.min("_min").alias("_t_min"), F.max("_max").alias("_t_max")))
    # one bit for each column that is not grouped by
    part = lambda bits: g.filter(F.col("_set") == bits)
    c = lambda name, to: F.col(f"_c_{name}").alias(to)
    doctors = part(0b101).filter("DoctorID IS NOT NULL")
    owed = [c("AmountOwed", "_owed"), c("AmountPaid", "_paid"), "_out"]
    return {
        "status": part(0b011).filter("_bills > 0").select("PaymentStatus", F.col("_bills").alias("TotalRecords"), c("TotalCost", "_billed"), c("InsuranceCoverage", "_covered"), *owed, "_n", "_min", "_max"),
        "doctor_visits": doctors.select("DoctorID", "_cnt", "_completed", "_scheduled", "_canceled", "_first", "_last"),
        "doctor_treatments": doctors.filter("_t_rows > 0").select("DoctorID", *[F.col(f"_t{x}").alias(x) for x in ("_n_id", "_n_cost", "_sum", "_min", "_max")]),
        "doctor_bills": doctors.select("DoctorID", "_cnt", c("TotalCost", "_sum"), "_n", "_min", "_max", F.col("_first").alias("EarliestAppt"), F.col("_last").alias("LatestAppt")),
        "patient_bills": part(0b110).filter("_bills > 0").select(F.col("_payer").alias("PatientID"), F.col("_bills").alias("_claims"), c("TotalCost", "_billed"), c("InsuranceCoverage", "_covered"),
                                                                 c("AmountOwed", "_owed"), "_n_cov", F.col("_min_cov").alias("_min"), F.col("_max_cov").alias("_max")),
        "total": part(0b111).select(F.col("_bills").alias("TotalBillings"), c("TotalCost", "_billed"), "_n", "_min", "_max", c("InsuranceCoverage", "_cov"), *owed),
    }


def billing_by_status(T: Tables, ci: bool = False, folds: Folds | None = None) -> DataFrame:
    """Bills grouped by PaymentStatus, largest total billed first.
    With ``ci`` spellings that differ only in case, accents or trailing
    spaces form one group, shown by their smallest spelling."""
    b = None if folds else T["BillingRecord"]
    # folded by the raw spelling first: the buffers are of fixed width, so no task sorts its bills
    sums = ["_billed", "_covered", "_owed", "_paid", "_out"]
    g = folds["status"] if folds else b.groupBy("PaymentStatus").agg(
        F.count(F.lit(1)).alias("TotalRecords"),
        cents_sum(F.col("TotalCost")).alias("_billed"),
        cents_sum(F.col("InsuranceCoverage")).alias("_covered"),
        cents_sum(F.col("AmountOwed")).alias("_owed"),
        cents_sum(F.col("AmountPaid")).alias("_paid"),
        cents_sum(F.col("AmountOwed") - F.col("AmountPaid")).alias("_out"),
        F.count("TotalCost").alias("_n"),
        F.min("TotalCost").alias("_min"),
        F.max("TotalCost").alias("_max"))
    if ci:  # then the few spellings by their collated key
        g = g.groupBy(text_key(F.col("PaymentStatus"), ci).alias("_status")).agg(
            F.min("PaymentStatus").alias("PaymentStatus"), F.sum("TotalRecords").alias("TotalRecords"),
            *[F.sum(c).alias(c) for c in sums], F.sum("_n").alias("_n"),
            F.min("_min").alias("_min"), F.max("_max").alias("_max"))
    return (g.select("PaymentStatus", "TotalRecords",
                _money_cents(F.col("_billed")).alias("TotalBilled"),
                _money_cents(F.col("_covered")).alias("TotalCovered"),
                _money_cents(F.col("_owed")).alias("TotalOwed"),
                _money_cents(F.col("_paid")).alias("TotalCollected"),
                _money_cents(F.col("_out")).alias("OutstandingBalance"),
                _avg_cents(F.col("_billed"), F.col("_n")).alias("AvgCost"),
                _money(F.col("_min")).alias("MinCost"),
                _money(F.col("_max")).alias("MaxCost"))
        .orderBy(F.desc("TotalBilled"), F.asc("PaymentStatus")))


def _appointments_per_doctor(T: Tables, ci: bool = False) -> DataFrame:
    return T["Appointment"].filter(F.col("DoctorID").isNotNull()).groupBy("DoctorID").agg(*_visits(text_key(F.col("Status"), ci)))


def appointments_by_dept(T: Tables, ci: bool = False, folds: Folds | None = None) -> DataFrame:
    """R2: every department; empty ones keep count 0 and NULL sums and dates.
    Scheduled counts Scheduled and Requested."""
    per_doc = folds["doctor_visits"] if folds else _appointments_per_doctor(T, ci)
    docs = T["Doctor"].select("DoctorID", "DepartmentID").filter(F.col("DepartmentID").isNotNull())
    per_dept = (docs.join(per_doc, "DoctorID", "left").groupBy("DepartmentID").agg(
        F.sum("_cnt").alias("_cnt"), F.sum("_completed").alias("Completed"),
        F.sum("_scheduled").alias("Scheduled"), F.sum("_canceled").alias("Canceled"),
        F.min("_first").alias("EarliestAppt"), F.max("_last").alias("LatestAppt")))
    return (T["Department"].select("DepartmentID", "DepartmentName")
            .join(per_dept, "DepartmentID", "left")
            .select("DepartmentName",
                    F.coalesce(F.col("_cnt"), F.lit(0)).cast("long").alias("TotalAppointments"),
                    F.col("Completed").cast("long").alias("Completed"),
                    F.col("Scheduled").cast("long").alias("Scheduled"),
                    F.col("Canceled").cast("long").alias("Canceled"),
                    "EarliestAppt", "LatestAppt", "DepartmentID")
            .orderBy(F.desc("TotalAppointments"), "DepartmentName", "DepartmentID")
            .drop("DepartmentID"))


def _treatments_per_doctor(T: Tables) -> DataFrame:
    return (treatment_sums(T["Treatment"]).join(T["Appointment"].select("AppointmentID", "DoctorID"), "AppointmentID")
            .groupBy("DoctorID").agg(
                F.sum("_n_id").alias("_n_id"), F.sum("_n_cost").alias("_n_cost"),
                F.sum("_sum").alias("_sum"), F.min("_min").alias("_min"),
                F.max("_max").alias("_max")))


def treatment_by_dept(T: Tables, folds: Folds | None = None) -> DataFrame:
    """Treatments through appointment, doctor and department (inner chain)."""
    per_doc = folds["doctor_treatments"] if folds else _treatments_per_doctor(T)
    per_dept = (per_doc.join(T["Doctor"].select("DoctorID", "DepartmentID"), "DoctorID")
                .groupBy("DepartmentID").agg(
                    F.sum("_n_id").alias("_n_id"), F.sum("_n_cost").alias("_n_cost"),
                    F.sum("_sum").alias("_sum"), F.min("_min").alias("_min"),
                    F.max("_max").alias("_max")))
    return (per_dept.join(T["Department"].select("DepartmentID", "DepartmentName"), "DepartmentID")
            .select("DepartmentName", F.col("_n_id").cast("long").alias("TotalTreatments"),
                    _money_cents(F.col("_sum")).alias("TotalCost"),
                    _avg_cents(F.col("_sum"), F.col("_n_cost")).alias("AvgCost"),
                    _money(F.col("_min")).alias("MinCost"),
                    _money(F.col("_max")).alias("MaxCost"), "DepartmentID")
            .orderBy(F.desc("TotalCost"), "DepartmentName", "DepartmentID")
            .drop("DepartmentID"))


def _bills_per_doctor(T: Tables) -> DataFrame:
    bills = T["BillingRecord"].select("AppointmentID", "TotalCost")
    return (T["Appointment"].select("AppointmentID", "DoctorID", "AppointmentDate")
            .filter(F.col("DoctorID").isNotNull())
            .join(bills, "AppointmentID", "left")
            .groupBy("DoctorID").agg(
                F.count("AppointmentID").alias("_cnt"), cents_sum(F.col("TotalCost")).alias("_sum"),
                F.count("TotalCost").alias("_n"), F.min("TotalCost").alias("_min"),
                F.max("TotalCost").alias("_max"),
                F.min("AppointmentDate").alias("EarliestAppt"),
                F.max("AppointmentDate").alias("LatestAppt")))


def doctor_workload(T: Tables, folds: Folds | None = None) -> DataFrame:
    """Every doctor (namesakes stay apart); revenue from the bills of
    their appointments; AVG ignores unbilled appointments; dates not coalesced."""
    per_doc = folds["doctor_bills"] if folds else _bills_per_doctor(T)
    zero = F.lit(0)
    return (T["Doctor"].select("DoctorID", "FirstName", "LastName", "Specialty", "DepartmentID")
            .join(T["Department"].select("DepartmentID", "DepartmentName"), "DepartmentID", "left")
            .join(per_doc, "DoctorID", "left")
            .select(F.concat(F.col("FirstName"), F.lit(" "), F.col("LastName")).alias("DoctorName"),
                    "Specialty", "DepartmentName",
                    F.coalesce(F.col("_cnt"), zero).cast("long").alias("TotalAppointments"),
                    F.coalesce(_money_cents(F.col("_sum")), zero.cast("double")).alias("TotalRevenue"),
                    F.coalesce(_avg_cents(F.col("_sum"), F.col("_n")), zero.cast("double")).alias("AvgRevenue"),
                    F.coalesce(_money(F.col("_min")), zero.cast("double")).alias("MinBill"),
                    F.coalesce(_money(F.col("_max")), zero.cast("double")).alias("MaxBill"),
                    "EarliestAppt", "LatestAppt", "DoctorID")
            .orderBy(F.desc("TotalAppointments"), "DoctorID")
            .drop("DoctorID"))


def _bills_per_patient(T: Tables) -> DataFrame:
    return (T["BillingRecord"].groupBy("PatientID").agg(
        F.count("BillingID").alias("_claims"), cents_sum(F.col("TotalCost")).alias("_billed"),
        cents_sum(F.col("InsuranceCoverage")).alias("_covered"), cents_sum(F.col("AmountOwed")).alias("_owed"),
        F.count("InsuranceCoverage").alias("_n_cov"),
        F.min("InsuranceCoverage").alias("_min"), F.max("InsuranceCoverage").alias("_max")))


def insurance_analysis(T: Tables, folds: Folds | None = None) -> DataFrame:
    """Per provider: distinct patients, claims (a patient's bills fan out),
    coverage totals. Uninsured patients appear nowhere.

    COUNT(DISTINCT PatientID) in two phases: provider and patient first, so that a
    patient whose row is repeated (also under several names or addresses) is one
    patient of a provider and has each bill once; then the count. Bills are folded per
    patient before they join. One shuffle by PatientID serves both.
    """
    per_patient = folds["patient_bills"] if folds else _bills_per_patient(T)
    per_provider = (T["Patient"].select("PatientID", "ProviderID")
                    .filter(F.col("ProviderID").isNotNull())
                    .repartition("PatientID").distinct()
                    .join(per_patient, "PatientID", "left")
                    .groupBy("ProviderID").agg(
                        F.count("PatientID").alias("_patients"),
                        F.sum("_claims").alias("_claims"), F.sum("_billed").alias("_billed"),
                        F.sum("_covered").alias("_covered"), F.sum("_owed").alias("_owed"),
                        F.sum("_n_cov").alias("_n_cov"), F.min("_min").alias("_min"),
                        F.max("_max").alias("_max")))
    zero = F.lit(0).cast("double")
    return (T["InsuranceProvider"].select("ProviderID", "ProviderName", "CoveragePercent")
            .join(per_provider, "ProviderID", "left")
            .select("ProviderName", F.col("CoveragePercent").cast("double").alias("CoveragePercent"),
                    F.coalesce(F.col("_patients"), F.lit(0)).cast("long").alias("TotalPatients"),
                    F.coalesce(F.col("_claims"), F.lit(0)).cast("long").alias("TotalClaims"),
                    F.coalesce(_money_cents(F.col("_billed")), zero).alias("TotalBilled"),
                    F.coalesce(_money_cents(F.col("_covered")), zero).alias("TotalCovered"),
                    F.coalesce(_money_cents(F.col("_owed")), zero).alias("TotalPatientOwe"),
                    F.coalesce(_avg_cents(F.col("_covered"), F.col("_n_cov")), zero).alias("AvgCoverage"),
                    F.coalesce(_money(F.col("_min")), zero).alias("MinCoverage"),
                    F.coalesce(_money(F.col("_max")), zero).alias("MaxCoverage"), "ProviderID")
            .orderBy(F.desc("TotalCovered"), "ProviderID")
            .drop("ProviderID"))


def billing_summary(T: Tables, folds: Folds | None = None) -> DataFrame:
    """One row over all bills; on an empty table count 0 and the rest NULL."""
    total = folds["total"] if folds else T["BillingRecord"].agg(
        F.count("BillingID").alias("TotalBillings"),
        cents_sum(F.col("TotalCost")).alias("_billed"), F.count("TotalCost").alias("_n"),
        F.min("TotalCost").alias("_min"), F.max("TotalCost").alias("_max"),
        cents_sum(F.col("InsuranceCoverage")).alias("_cov"), cents_sum(F.col("AmountOwed")).alias("_owed"),
        cents_sum(F.col("AmountPaid")).alias("_paid"),
        cents_sum(F.col("AmountOwed") - F.col("AmountPaid")).alias("_out"))
    return (total
            .select("TotalBillings", _money_cents(F.col("_billed")).alias("TotalBilled"),
                    _avg_cents(F.col("_billed"), F.col("_n")).alias("AvgBill"),
                    _money(F.col("_min")).alias("MinBill"), _money(F.col("_max")).alias("MaxBill"),
                    _money_cents(F.col("_cov")).alias("TotalInsuranceCoverage"),
                    _money_cents(F.col("_owed")).alias("TotalOwed"),
                    _money_cents(F.col("_paid")).alias("TotalCollected"),
                    _money_cents(F.col("_out")).alias("OutstandingBalance")))


def kpis(T: Tables) -> DataFrame:
    """The summary row plus the insured share (rounded percent, 0 when
    nothing is billed) and the number of doctors in the workload report."""
    s = billing_summary(T)
    n_doctors = T["Doctor"].select(F.count("DoctorID")).scalar()
    share = F.when(F.coalesce(F.col("TotalBilled"), F.lit(0.0)) != 0,
                   F.round(F.col("TotalInsuranceCoverage") / F.col("TotalBilled") * 100)
                   ).otherwise(F.lit(0.0)).cast("long")
    return s.select("*", share.alias("InsuredSharePct"), n_doctors.alias("ActiveDoctors"))


def _bars(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` (``by``, label, value) is stored once; the maximum of each ``by`` joins back (a row each)."""
    df = cut_lineage(df)
    v = F.coalesce(F.col("value").cast("double"), F.lit(0.0))
    rows = df.select(*by, "label", v.alias("value"))
    top = F.greatest(F.max("value"), F.lit(1.0)).alias("_top")
    rows = rows.join(rows.groupBy(*by).agg(top), by) if by else rows.withColumn("_top", rows.select(top).scalar())
    return rows.select(*by, "label", "value", F.greatest(F.lit(4.0), F.round(F.col("value") / F.col("_top") * 100)).cast("long").alias("pct"))


def bar_share(df: DataFrame, label: str, value: str) -> DataFrame:
    """Each value as a percent of the largest (NULL as 0), at least 4.

    The report (a row for each bar) is computed once and stored; the maximum is
    a scalar subquery over that copy.
    """
    return _bars(df.select(F.col(label).alias("label"), F.col(value).alias("value")), [])


def dashboard_bars(T: Tables, folds: Folds | None = None) -> DataFrame:
    """R8 for the five charts of the reports screen: (chart, label, value, pct), over
    ``folds`` (made here in one pass if not given)."""
    folds = folds or report_folds(T)
    charts = [("billing", billing_by_status(T, folds=folds), "PaymentStatus", "TotalBilled"),
              ("appointments", appointments_by_dept(T, folds=folds), "DepartmentName", "TotalAppointments"),
              ("treatments", treatment_by_dept(T, folds), "DepartmentName", "TotalCost"),
              ("doctors", doctor_workload(T, folds), "DoctorName", "TotalAppointments"),
              ("insurance", insurance_analysis(T, folds), "ProviderName", "TotalCovered")]
    out = None
    for name, df, label, value in charts:
        bars = df.select(F.lit(name).alias("chart"), F.col(label).alias("label"), F.col(value).cast("double").alias("value"))
        out = bars if out is None else out.unionByName(bars)
    return _bars(out, ["chart"])


def all_reports(T: Tables, ci: bool = False) -> dict[str, DataFrame]:
    """R1-R6 over one pass of the tables (``report_folds``)."""
    folds = report_folds(T, ci)
    return {"billing_by_status": billing_by_status(T, ci, folds),
            "appointments_by_dept": appointments_by_dept(T, ci, folds),
            "treatment_by_dept": treatment_by_dept(T, folds),
            "doctor_workload": doctor_workload(T, folds),
            "insurance_analysis": insurance_analysis(T, folds),
            "billing_summary": billing_summary(T, folds)}
