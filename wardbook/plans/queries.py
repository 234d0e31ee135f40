"""Registered queries: one per operator, over the driver's test tables.

Each callable takes (spark, sf_dir) and returns a DataFrame over the whole
mapped tables (``sources.tables.from_testdata``). Exact decimals leave as
DOUBLE at this boundary, so results compare with the SQL oracle in
``plans.oracle``. Change scenarios (which rows a batch touches) are fixed
by rule on the keys; the result is always the whole new table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardbook.functions import scalars as S
from wardbook.operators import billing as B
from wardbook.operators import changes as D
from wardbook.operators import checks as V
from wardbook.operators import listings as L
from wardbook.operators import reports as R
from wardbook.operators import scope as X
from wardbook.sources import json_io
from wardbook.session import cut_lineage, scratch_path
from wardbook.sources.tables import from_testdata, load_tables, max_key, payments_from_events, save_tables, with_month

Query = Callable[[SparkSession, str], DataFrame]

def _out(df: DataFrame) -> DataFrame:
    """Result boundary: decimals leave as doubles."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name)
                       if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
                       for f in df.schema.fields])


_TABLE_CACHE: dict[tuple[str, int, str], dict[str, DataFrame]] = {}


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The mapped tables (lazy plans, no data) built once per session and folder.

    Building them costs about a second of driver-side analysis; the plans are
    immutable, so every query reuses them. Callers get their own dict.
    """
    key = (spark.sparkContext.applicationId, id(spark._jsparkSession), sf_dir)
    if key not in _TABLE_CACHE:
        _TABLE_CACHE[key] = from_testdata(spark, sf_dir)
    return dict(_TABLE_CACHE[key])


def _raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _bills(df: DataFrame) -> DataFrame:
    return _out(df.drop("UpdatedAt"))


# FIXED VALUES: the viewers used by the scoping queries (two unlinked).
VIEWERS = [
    (1, "admin", None, None),
    (2, "receptionist", None, None),
    (3, "doctor", 1, None),
    (4, "doctor", 7, None),
    (5, "doctor", None, None),
    (6, "nurse", 2, None),
    (7, "nurse", 0, 5),
    (8, "patient", None, 1),
    (9, "patient", None, 42),
    (10, "patient", None, None),
    (11, "patient", 0, 100),
    (12, "nurse", 9, None),
]
VIEWER_SCHEMA = "viewer_id int, role string, linked_record_id bigint, patient_record_id bigint"


def viewers(spark: SparkSession) -> DataFrame:
    """The fixed viewers as a DataFrame."""
    return spark.createDataFrame(VIEWERS, VIEWER_SCHEMA)


# ---------------------------------------------------------------------------
# scans, sources, projections, filters
# ---------------------------------------------------------------------------

def scan_patients(spark, d):
    """The Patient table, all columns."""
    return _out(_tables(spark, d)["Patient"])


def scan_doctors(spark, d):
    """The Doctor table, all columns."""
    return _out(_tables(spark, d)["Doctor"])


def scan_nurses(spark, d):
    """The Nurse table, all columns."""
    return _out(_tables(spark, d)["Nurse"])


def load_mixed_layouts(spark, d):
    """S1 + S5: a Patient folder of files from before and after two migrations (a new column,
    wider keys), read as one table."""
    p = _tables(spark, d)["Patient"]
    root = scratch_path(spark, "layouts")
    first = p.where("PatientID % 3 = 0").select(F.col("PatientID").cast("int"), "FirstName", "LastName")
    second = p.where("PatientID % 3 = 1").select("PatientID", "FirstName", "LastName", F.col("ProviderID").cast("int"))
    third = p.where("PatientID % 3 = 2").select("ProviderID", "PatientID", "LastName", "FirstName", F.lit("web").alias("Channel"))
    for part in (first, second, third):
        part.write.mode("append").parquet(f"{root}/Patient")
    return load_tables(spark, root, ["Patient"])["Patient"].select("PatientID", "FirstName", "LastName", "DOB", "ProviderID", "Channel")


def save_and_load(spark, d):
    """S6 + S1: all bills saved in folders by payment status and read back."""
    root = scratch_path(spark, "saved")
    save_tables({"BillingRecord": _tables(spark, d)["BillingRecord"]}, root, partition_by={"BillingRecord": ["PaymentStatus"]})
    return _bills(load_tables(spark, root, ["BillingRecord"])["BillingRecord"])


def ingest_json_props(spark, d):
    """S3: the JSON text of every event's props parsed to its field k."""
    ev = _raw(spark, d, "events")
    schema = T.StructType([T.StructField("k", T.LongType())])
    return json_io.read_json_batch(ev, "props", schema, keep=["event_id"])


def _json_bodies(spark, d) -> tuple[DataFrame, T.StructType]:
    """Event props as JSON bodies, some broken, of a wrong type, empty, or lists with bad items."""
    k = F.col("event_id") % 7
    body = (F.when(k == 1, F.expr("left(props, length(props) - 1)")).when(k == 2, F.lit('{"k": "abc"}')).when(k == 3, F.lit("[]"))
             .when(k == 4, F.lit('[{"k": "12", "note": "x"}, {"note": "y"}, {"k": 1.5}, {"k": 7}, 8]')).otherwise(F.col("props")))
    schema = T.StructType([T.StructField("k", T.LongType(), False), T.StructField("note", T.StringType())])
    return _raw(spark, d, "events").select("event_id", body.alias("body")), schema


def json_items(spark, d):
    """S3: the sound items of bodies with one object or a list each."""
    bodies, schema = _json_bodies(spark, d)
    return json_io.read_json_batch(bodies, "body", schema, keep=["event_id"], position="item")


def json_rejects(spark, d):
    """S3: the bodies and items that can't be read, each with its reason."""
    bodies, schema = _json_bodies(spark, d)
    return json_io.json_rejects(bodies, "body", schema, keep=["event_id"])


def billing_json(spark, d):
    """Every bill as one JSON object (numbers for money, ISO dates)."""
    return json_io.to_json_rows(_tables(spark, d)["BillingRecord"])


def project_public(spark, d):
    """Customers without the secret-standing column c_acctbal."""
    return L.public_users(_raw(spark, d, "customer"), secret="c_acctbal")


def balance_due(spark, d):
    """Each bill's balance, owed minus paid."""
    b = L.with_balance(_tables(spark, d)["BillingRecord"])
    return _out(b.select("AppointmentID", "BalanceDue"))


def appts_by_doctor(spark, d):
    """The appointments of doctor 1."""
    return L.by_key(_tables(spark, d)["Appointment"], "DoctorID", 1)


def appts_sorted(spark, d):
    """O1: all appointments, newest date and time first."""
    return L.appointments_sorted(_tables(spark, d)["Appointment"])


def appts_of_days(spark, d):
    """P4 + O1 over folders by month: all appointments on the dates of doctor 1's canceled ones."""
    appts, root = _tables(spark, d)["Appointment"], scratch_path(spark, "months")
    save_tables({"Appointment": with_month(appts)}, root, partition_by={"Appointment": ["AppointmentMonth"]})
    stored = load_tables(spark, root, ["Appointment"])["Appointment"]
    days = appts.where((F.col("DoctorID") == 1) & (F.col("Status") == "Canceled")).select("AppointmentDate")
    return L.appointments_sorted(L.by_days(stored, days).select(*appts.columns))


def treatments_list(spark, d):
    """J1 + P5: the treatments of appointment 1 with diagnosis names."""
    return _out(L.treatments_with_diagnosis(_tables(spark, d), appointment_id=1))


def empty_scope(spark, d):
    """What each patient account sees; accounts without a record (customer keys that
    end in 5) have the empty scope, and see nothing."""
    t = _tables(spark, d)
    accounts = t["Patient"].select(
        F.col("PatientID").alias("account"),
        F.when(F.col("PatientID") % 10 != 5, F.col("PatientID")).alias("record"))
    linked = accounts.where(F.col("record").isNotNull())
    visible = t["Appointment"].groupBy("PatientID").agg(F.count(F.lit(1)).alias("n"))
    seen = linked.join(visible, linked["record"] == visible["PatientID"], "left").select("account", F.coalesce("n", F.lit(0)).alias("n"))
    nothing = L.empty_like(visible)
    none = accounts.where(F.col("record").isNull())
    none = none.join(nothing, none["account"] == nothing["PatientID"], "left").select("account", F.coalesce("n", F.lit(0)).alias("n"))
    return seen.unionByName(none)


def cancellable_appts(spark, d):
    """Appointments still Requested or Scheduled."""
    return L.cancellable_appointments(_tables(spark, d)["Appointment"])


def payable_bills(spark, d):
    """Bills not Canceled with a positive balance."""
    return _bills(L.payable_bills(_tables(spark, d)["BillingRecord"]))


def search_customers(spark, d):
    """P10: customers whose name and segment text contains 'build' in any case."""
    return L.search_rows(_raw(spark, d, "customer"), "build", ["c_name", "c_mktsegment"])


def search_customers_many(spark, d):
    """P10 for many searches: customers found by regions, the nations' first two letters, the
    suppliers' last four digits and the market segments' last five letters."""
    searches = (_raw(spark, d, "region").select(F.col("r_name").alias("q"))
                .union(_raw(spark, d, "nation").select(F.substring("n_name", 1, 2)))
                .union(_raw(spark, d, "supplier").select(F.substring("s_name", -4, 4)))
                .union(_raw(spark, d, "customer").select(F.substring("c_mktsegment", -5, 5))))
    return L.search_many(_raw(spark, d, "customer"), searches, "q", ["c_name", "c_mktsegment"])


# ---------------------------------------------------------------------------
# joins and lookups
# ---------------------------------------------------------------------------

def treatments_with_diagnosis(spark, d):
    """Every treatment with its diagnosis name."""
    return _out(L.treatments_with_diagnosis(_tables(spark, d)))


def billing_for_patient(spark, d):
    """Patient 1's bills with the patient's name, newest first."""
    return _bills(L.billing_for_patient(_tables(spark, d), 1))


def billing_with_patient(spark, d):
    """Every bill with its patient's name, newest first."""
    return _bills(L.billing_with_patient(_tables(spark, d)))


def my_patients(spark, d):
    """The patients of doctor 1's appointments."""
    t = _tables(spark, d)
    mine = L.by_key(t["Appointment"], "DoctorID", 1)
    return L.my_patients(mine, t["Patient"])


def appts_with_names(spark, d):
    """Appointments with patient, doctor and nurse display names."""
    return L.appointments_with_names(_tables(spark, d))


def patient_provider_label(spark, d):
    """Patients with their provider's name (or the raw id)."""
    return L.patients_with_provider_label(_tables(spark, d))


def choice_labels(spark, d):
    """pick-list labels of every patient, doctor and nurse."""
    return L.choice_labels(_tables(spark, d))


def assign_nurse(spark, d):
    """A nurse for every Requested appointment."""
    t = _tables(spark, d)
    req = t["Appointment"].filter(F.col("Status") == "Requested")
    return L.assign_nurse(req, t["Doctor"], t["Nurse"])


def assign_ids(spark, d):
    """Pending orders as new rows keyed after the largest order key, by date and key."""
    o = _raw(spark, d, "orders")
    new = (o.filter(F.col("o_orderstatus") == "P")
           .select(F.lit(None).cast("long").alias("new_key"), "o_orderkey", "o_custkey",
                   "o_orderdate", "o_totalprice"))
    target = o.select(F.col("o_orderkey").alias("new_key"))
    return D.assign_ids(new, target, "new_key", order=["o_orderdate", "o_orderkey"])


def assign_ids_stored(spark, d):
    """D1 + A9 from the footers: as ``assign_ids``, the largest key taken from the file's statistics."""
    new = (_raw(spark, d, "orders").filter(F.col("o_orderstatus") == "P")
           .select(F.lit(None).cast("long").alias("new_key"), "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"))
    top = max_key(spark, f"{d.rstrip('/')}/orders.parquet", "o_orderkey")
    return D.assign_ids(new, top, "new_key", order=["o_orderdate", "o_orderkey"])


# ---------------------------------------------------------------------------
# reports
# ---------------------------------------------------------------------------

def report_billing_by_status(spark, d):
    """Bills by payment status."""
    return R.billing_by_status(_tables(spark, d))


def report_appointments_by_dept(spark, d):
    """R2: appointments by department."""
    return R.appointments_by_dept(_tables(spark, d))


def report_treatment_by_dept(spark, d):
    """Treatments by department."""
    return R.treatment_by_dept(_tables(spark, d))


def report_doctor_workload(spark, d):
    """Workload and revenue per doctor."""
    return R.doctor_workload(_tables(spark, d))


def report_insurance_analysis(spark, d):
    """Patients, claims and coverage per provider."""
    return R.insurance_analysis(_tables(spark, d))


def report_billing_summary(spark, d):
    """The one-row billing summary."""
    return R.billing_summary(_tables(spark, d))


def report_kpis(spark, d):
    """The summary plus insured share and number of doctors."""
    return R.kpis(_tables(spark, d))


def report_bar_share(spark, d):
    """Bar widths for R3's total cost per department."""
    return R.bar_share(R.treatment_by_dept(_tables(spark, d)), "DepartmentName", "TotalCost")


def report_dashboard_bars(spark, d):
    """R8 for all five charts of the reports screen."""
    t = _tables(spark, d)
    return R.dashboard_bars(t, R.report_folds(t, paid=B.paid_per_appointment(t["Payments"])))


def report_insurance_repeats(spark, d):
    """R5 over a Patient table in which rows are repeated, some under another name."""
    t = _tables(spark, d)
    p = t["Patient"]
    t["Patient"] = p.unionByName(p.where("PatientID % 3 = 0")).unionByName(p.where("PatientID % 5 = 0").withColumn("LastName", F.lit("moved")))
    return R.insurance_analysis(t)


def _moves(t: dict[str, DataFrame]) -> DataFrame:
    """A mapping of provider keys with rows that can't be followed."""
    p = F.col("ProviderID")
    ip = t["InsuranceProvider"]
    new = F.when(p % 4 == 1, p + 1).when(p % 8 == 4, F.lit(500)).otherwise(p + 100)
    parts = [ip.select(p.alias("old_key"), new.alias("new_key")), ip.where(p % 6 == 0).select(p, p + 200),
             ip.where(p % 7 == 0).select(p + 1000, p + 300), ip.where(p == 3).select(p, F.lit(None).cast("long"))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def rekey_rejects(spark, d):
    """The rows of a key mapping that can't be followed."""
    t = _tables(spark, d)
    return D.rekey_rejects(t, "InsuranceProvider", _moves(t))


def rekey_sound(spark, d):
    """The patients after a mapping of which only the sound rows count."""
    t = _tables(spark, d)
    return D.cascade_rekey(t, "InsuranceProvider", _moves(t))["Patient"]


# ---------------------------------------------------------------------------
# scalars
# ---------------------------------------------------------------------------

def fmt_money_pct(spark, d):
    """order totals as money, percent and integer text."""
    o = _raw(spark, d, "orders")
    return o.select("o_orderkey", S.fmt_money(F.col("o_totalprice")).alias("money"),
                    S.fmt_pct(F.col("o_totalprice") / 1000000).alias("pct"),
                    S.fmt_int(F.col("o_custkey") * 1000).alias("count_text"))


def split_names(spark, d):
    """part names split into first and last name."""
    p = _raw(spark, d, "part")
    first, last = S.split_full_name(F.col("p_name"), F.col("p_brand"))
    return p.select("p_partkey", first.alias("first_name"), last.alias("last_name"))


def status_class(spark, d):
    """the badge class of every bill's status."""
    b = _tables(spark, d)["BillingRecord"]
    return b.select("BillingID", "PaymentStatus", S.status_class(F.col("PaymentStatus")).alias("css"))


def parse_amounts(spark, d):
    """lenient number parsing of priorities and brands."""
    o = _raw(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        S.parse_lenient(F.substring("o_orderpriority", 1, 1)).alias("amount"),
        S.parse_lenient(F.col("o_orderpriority")).alias("amount_full"))
    p = _raw(spark, d, "part").select(
        (F.col("p_partkey") + 10000000).alias("id"), S.parse_lenient(F.col("p_brand")).alias("amount"),
        S.parse_lenient(F.col("p_size").cast("string")).alias("amount_full"))
    return o.unionByName(p)


# ---------------------------------------------------------------------------
# table changes
# ---------------------------------------------------------------------------

def _customer_changes(c: DataFrame) -> DataFrame:
    base = c.filter(F.col("c_custkey") % 7 == 0)
    v1 = base.select("c_custkey", "c_name", "c_acctbal",
                     F.lit("OLD").alias("c_mktsegment"), F.lit(1).alias("seq"))
    v2 = base.select("c_custkey", "c_name", (F.col("c_acctbal") + 1).alias("c_acctbal"),
                     F.lower("c_mktsegment").alias("c_mktsegment"), F.lit(2).alias("seq"))
    return v1.unionByName(v2)


def update_customers(spark, d):
    """Customers with key % 7 = 0 replaced by the later of two versions."""
    c = _raw(spark, d, "customer")
    return D.update_by_key(c, _customer_changes(c), "c_custkey", seq="seq")


def cancel_orders(spark, d):
    """D3: appointments with key % 11 = 0 set to Canceled."""
    a = _tables(spark, d)["Appointment"]
    ch = a.filter(F.col("AppointmentID") % 11 == 0).select("AppointmentID",
                                                            F.lit("Canceled").alias("Status"))
    return D.update_column(a, ch, "AppointmentID", "Status")


def delete_orders(spark, d):
    """Appointments minus those with key % 13 = 0."""
    a = _tables(spark, d)["Appointment"]
    return D.delete_by_key(a, a.filter(F.col("AppointmentID") % 13 == 0), "AppointmentID")


def _upsert_source(c: DataFrame) -> DataFrame:
    base = c.filter(F.col("c_custkey") % 5 == 0)
    old = base.select("c_custkey", F.concat(F.lit("new "), F.col("c_name")).alias("c_name"),
                      "c_nationkey", F.lit(0.0).alias("c_acctbal"),
                      F.lit("UPSERTED").alias("c_mktsegment"), F.lit(1).alias("seq"))
    fresh1 = base.select((F.col("c_custkey") + 1000000).alias("c_custkey"), "c_name", "c_nationkey",
                         "c_acctbal", F.lit("NEW1").alias("c_mktsegment"), F.lit(1).alias("seq"))
    fresh2 = base.select((F.col("c_custkey") + 1000000).alias("c_custkey"), "c_name", "c_nationkey",
                         "c_acctbal", F.lit("NEW2").alias("c_mktsegment"), F.lit(2).alias("seq"))
    return old.unionByName(fresh1).unionByName(fresh2)


def upsert_customers(spark, d):
    """Existing keys get a new segment; new keys are inserted (latest wins)."""
    c = _raw(spark, d, "customer")
    return D.merge_upsert(c, _upsert_source(c), "c_custkey", ["c_mktsegment"], seq="seq")


def insert_ignore(spark, d):
    """New keys are inserted (first wins); existing rows stay."""
    c = _raw(spark, d, "customer")
    return D.insert_ignore(c, _upsert_source(c), "c_custkey", seq="seq")


def _after_patient_delete(spark, d) -> dict[str, DataFrame]:
    t = _tables(spark, d, )
    keys = t["Patient"].filter(F.col("PatientID") % 10 == 3).select("PatientID")
    return D.cascade_delete(t, "Patient", keys)


def cascade_delete_orders(spark, d):
    """The appointments left after deleting customers with key % 10 = 3."""
    return _after_patient_delete(spark, d)["Appointment"]


def cascade_delete_lineitems(spark, d):
    """The treatments left after the same delete."""
    return _out(_after_patient_delete(spark, d)["Treatment"])


def rekey_nation(spark, d):
    """Provider keys + 100 carried into the patients."""
    t = _tables(spark, d)
    mapping = t["InsuranceProvider"].select(F.col("ProviderID").alias("old_key"),
                                            (F.col("ProviderID") + 100).alias("new_key"))
    return D.cascade_rekey(t, "InsuranceProvider", mapping)["Patient"]


# ---------------------------------------------------------------------------
# checks
# ---------------------------------------------------------------------------

def dup_lineitem_keys(spark, d):
    """V1: (order, line number) pairs held by more than one line item."""
    return V.duplicate_keys(_raw(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def null_checks(spark, d):
    """V2: appointments without a doctor."""
    a = _tables(spark, d)["Appointment"]
    return V.null_violations(a, ["DoctorID"]).select("AppointmentID", "reason")


def orphan_rows(spark, d):
    """V3: treatments whose appointment is gone (deleted without a cascade)."""
    t = _tables(spark, d)
    kept = D.delete_by_key(t["Appointment"], t["Appointment"].filter(
        F.col("AppointmentID") % 13 == 0), "AppointmentID")
    return _out(V.orphan_rows(t["Treatment"], "AppointmentID", kept, "AppointmentID"))


def too_long(spark, d):
    """V4: diagnosis names longer than 10 characters."""
    dg = _tables(spark, d)["Diagnosis"]
    return V.too_long(dg, {"DiagnosisName": 10}).select("DiagnosisID", "DiagnosisName", "reason")


def validate_patients(spark, d):
    """V1-V4 on a batch of new patients built from the customers: new keys,
    keys that exist, unknown providers, and two hot repeated keys. Every row
    comes back, with its reason or NULL when it may be inserted."""
    t = _tables(spark, d)
    c = _raw(spark, d, "customer")
    k = F.col("c_custkey")
    pid = (F.when(k % 4 == 0, k + 1000000).when(k % 4 == 1, k)
            .when(k % 8 == 2, k + 2000000).otherwise(F.lit(3000000) + k % 16))
    prov = F.when(k % 8 == 2, F.col("c_nationkey") + 100).otherwise(F.col("c_nationkey")).cast("bigint")
    batch = c.select(pid.alias("PatientID"), F.col("c_name").alias("FirstName"),
                     F.col("c_mktsegment").alias("LastName"), F.lit(None).cast("date").alias("DOB"),
                     F.lit(None).cast("string").alias("Gender"), F.lit(None).cast("string").alias("Phone"),
                     F.lit(None).cast("string").alias("Address"), prov.alias("ProviderID"))
    good, bad = V.validate_insert(batch, "Patient", t)
    cols = ["PatientID", "FirstName", "ProviderID"]
    return (good.select(*cols, F.lit(None).cast("string").alias("reason"))
            .unionByName(bad.select(*cols, "reason")))


def quality_profile(spark, d):
    """V2 and V4 of three tables, each in one job over its rows, some of which break the rules."""
    t = _tables(spark, d)
    k = F.col("PatientID")
    patients = (t["Patient"].withColumn("FirstName", F.when(k % 13 > 0, F.col("FirstName"))).withColumn("Phone", F.when(k % 17 == 0, F.repeat(F.lit("5"), F.lit(16))).otherwise(F.lit("555")))
                .withColumn("Address", F.repeat(F.lit("é"), (k % 120).cast("int"))))
    bills = t["BillingRecord"].withColumn("PaymentStatus", F.when(F.col("BillingID") % 19 > 0, F.col("PaymentStatus")))
    out = V.quality_profile(patients, "Patient").unionByName(V.quality_profile(bills, "BillingRecord", more={"AmountPaid beyond TotalCost": F.col("AmountPaid") > F.col("TotalCost")}))
    return out.unionByName(V.quality_profile(t["Appointment"], "Appointment"))


def batch_reject(spark, d):
    """V7: line items batched by order; a batch with any quantity below 2 is rejected."""
    li = _raw(spark, d, "lineitem")
    return V.batch_flags(li, "l_orderkey", F.col("l_quantity") < 2)


# ---------------------------------------------------------------------------
# billing
# ---------------------------------------------------------------------------

def billing_derive(spark, d):
    """B1: the bills derived from treatments, coverage and payments."""
    return _bills(_tables(spark, d)["BillingRecord"])


def billing_rejects(spark, d):
    """B1.1/B2: appointments whose patient row is gone (removed without a
    cascade) or whose date is missing cannot be billed; each gets a reason."""
    t = _tables(spark, d)
    t["Patient"] = t["Patient"].filter(F.col("PatientID") % 10 != 3)
    t["Appointment"] = t["Appointment"].withColumn(
        "AppointmentDate", F.when(F.col("AppointmentID") % 97 == 0, F.lit(None).cast("date"))
        .otherwise(F.col("AppointmentDate")))
    return B.billing_rejects(t)


def _account_feed(spark, d) -> DataFrame:
    c = _raw(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("seq"),
        F.when(k % 3 == 0, F.lit("register")).otherwise(F.lit("admin")).alias("source"),
        F.concat(F.lit("user"), k.cast("string")).alias("username"),
        F.when(k % 3 == 1, F.when(k % 5 == 4, F.lit("patient")).otherwise(F.lit("doctor")))
         .when(k % 3 == 2, F.when(k % 5 == 4, F.lit("janitor")).otherwise(F.lit("nurse"))).alias("role"),
        F.when(k % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.col("c_name"), F.lit(" "), F.col("c_mktsegment"))).alias("full_name"),
        F.lit(None).cast("string").alias("specialty"), F.lit(None).cast("string").alias("phone"),
        (F.col("c_nationkey") % 5).cast("long").alias("department_id"))


def expand_accounts(spark, d):
    """An account feed (self-registrations and admin-created staff) as new
    Users rows linked to new Patient, Doctor and Nurse keys; rows with an
    unknown role are rejected."""
    return D.expand_accounts(_account_feed(spark, d), _tables(spark, d))["Users"]


def expand_accounts_ties(spark, d):
    """A feed of which four rows each share a sequence number, some have none, and names recur."""
    k = F.col("seq")
    feed = _account_feed(spark, d).withColumn("username", F.concat(F.lit("user"), F.when(k % 9 == 4, k - 1).otherwise(k).cast("string")))
    feed = feed.withColumn("seq", F.when(k % 11 > 0, F.floor(k / 4)))
    return D.expand_accounts(feed, _tables(spark, d))["Users"]


def expand_accounts_rejects(spark, d):
    """What a feed with empty and repeated usernames and unknown roles has rejected."""
    k = F.col("seq")
    feed = _account_feed(spark, d).withColumn(
        "username", F.when(k % 50 == 7, F.lit("")).when(k % 20 == 3, F.concat(F.lit("user"), (k - 1).cast("string")))
        .otherwise(F.col("username")))
    return D.expand_accounts(feed, _tables(spark, d))["Rejected"]


def expand_accounts_staff(spark, d):
    """The Doctor and Nurse rows the same feed creates (names split at the
    first space, or the username when there is no name)."""
    out = D.expand_accounts(_account_feed(spark, d), _tables(spark, d))
    doc = out["Doctor"].select(F.lit("doctor").alias("kind"), F.col("DoctorID").alias("id"),
                               "FirstName", "LastName", "DepartmentID")
    nur = out["Nurse"].select(F.lit("nurse").alias("kind"), F.col("NurseID").alias("id"),
                              "FirstName", "LastName", "DepartmentID")
    return doc.unionByName(nur)


def _old_bills(t: dict[str, DataFrame]) -> DataFrame:
    """Bills as they were before the 'R' treatments arrived, with PatientID
    shifted (to show a regenerate keeps it). Stored once, as the billing
    table the merge and refresh then work on."""
    old_t = dict(t)
    old_t["Treatment"] = t["Treatment"].filter(F.col("TreatmentName") != "R")
    from wardbook.operators.billing import paid_per_appointment
    old = B.derive_billing(old_t, existing=paid_per_appointment(t["Payments"]))
    return cut_lineage(old.withColumn("PatientID", F.col("PatientID") + 1))


def billing_merge(spark, d):
    """B2: re-derived bills merged into older ones (ids, payer and payments kept)."""
    t = _tables(spark, d)
    old = _old_bills(t).filter(F.col("AppointmentID") % 9 != 0)
    derived = B.derive_billing(t, existing=old)
    return _bills(B.merge_billing(old, derived, now=F.lit(None)))


def billing_refresh(spark, d):
    """Only the appointments with 'R' treatments re-derived."""
    t = _tables(spark, d)
    t["BillingRecord"] = _old_bills(t)
    changed = t["Treatment"].filter(F.col("TreatmentName") == "R")
    return _bills(B.refresh_billing(t, changed, now=F.lit(None)))


def _treatment_requests(spark, d):
    """Tables before the 'R' line items, and these as JSON requests; ids of even keys
    are sent as strings, and keys divisible by 101, 97, 89, 83, 79 or 73 (the first
    that fits) make faulty bodies."""
    t = _tables(spark, d)
    t["BillingRecord"] = _old_bills(t)
    t["Treatment"] = t["Treatment"].filter(F.col("TreatmentName") != "R")
    li = _raw(spark, d, "lineitem").filter(F.col("l_returnflag") == "R")
    key = F.col("l_orderkey")
    by = lambda n: key % n == 0
    appointment = F.when(by(101), F.lit(None)).when(by(97), -key).otherwise(key)
    cost = F.col("l_extendedprice").cast("decimal(10,2)").cast("string")
    fields = F.concat(
        F.lit('{"DiagnosisID": '), F.col("l_partkey").cast("string"),
        F.coalesce(F.concat(F.lit(', "AppointmentID": '), F.when(key % 2 == 0, F.concat(F.lit('"'), appointment.cast("string"), F.lit('"'))).otherwise(appointment.cast("string"))), F.lit("")),
        F.lit(', "TreatmentName": "R", "TreatmentCost": '), F.when(by(89), F.lit('"abc"')).when(by(83), F.lit("null")).otherwise(cost), F.lit("}"))
    sound = ~(by(101) | by(97) | by(89) | by(83))
    body = F.when(sound & by(79), F.lit("[]")).when(sound & by(73), F.lit('{"AppointmentID": ')).otherwise(fields)
    return t, li.select((key * 8 + F.col("l_linenumber")).alias("request_id"), body.alias("body"))


def add_treatments_flow(spark, d):
    """The add-treatments flow: every 'R' line item arrives as a JSON request against
    bills built without them; faulty ones are rejected whole. Result: the new bills."""
    from wardbook.operators.flows import add_treatments
    t, reqs = _treatment_requests(spark, d)
    out, _rejected = add_treatments(t, reqs)
    return _bills(out["BillingRecord"])


def add_treatments_rejects(spark, d):
    """The same flow's rejected requests with their reasons."""
    from wardbook.operators.flows import check_treatments
    t, reqs = _treatment_requests(spark, d)
    return check_treatments(t, reqs)[1]


def remove_treatments_flow(spark, d):
    """Every 'A' treatment of an order with key % 3 = 0 removed, its bills re-derived."""
    from wardbook.operators.flows import remove_treatments
    t = _tables(spark, d)
    gone = t["Treatment"].filter((F.col("TreatmentName") == "A") & (F.col("AppointmentID") % 3 == 0))
    return _bills(remove_treatments(t, gone.select("TreatmentID"))["BillingRecord"])


def diagnosis_mismatches(spark, d):
    """V6: line items whose part's diagnosis is tied to another order (each part to the
    order with the part's key)."""
    from wardbook.operators.checks import diagnosis_mismatch
    t = _tables(spark, d)
    t["Diagnosis"] = t["Diagnosis"].withColumn("AppointmentID", F.col("DiagnosisID"))
    return diagnosis_mismatch(t).select("TreatmentID", "DiagnosisID", "AppointmentID")


def book_appointments_rejects(spark, d):
    """The booking flow's rejected requests with their reasons."""
    from wardbook.operators.flows import book_appointments
    return book_appointments(*_bookings(spark, d))[1].select("seq", "reason")


def cascade_delete_doctors(spark, d):
    """D7, SET NULL: doctors with key % 4 = 1 deleted; the appointments stay without a doctor."""
    t = _tables(spark, d)
    keys = t["Doctor"].filter(F.col("DoctorID") % 4 == 1).select("DoctorID")
    return D.cascade_delete(t, "Doctor", keys)["Appointment"].select("AppointmentID", "DoctorID", "NurseID")


def _bookings(spark, d):
    """Every low-priority order re-booked 30 days later, by its patient (even keys; no
    linked record when the customer key ends in 5) or by reception (odd keys); some
    name unknown doctors."""
    t = _tables(spark, d)
    o = _raw(spark, d, "orders").filter(F.col("o_orderpriority") == "5-LOW")
    n_supp = _raw(spark, d, "supplier").select(F.count(F.lit(1))).scalar()
    return t, o.select(
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("patient")).otherwise(F.lit("receptionist")).alias("role"),
        F.when(F.col("o_custkey") % 10 == 5, F.lit(None)).otherwise(F.col("o_custkey"))
         .alias("patient_record_id"),
        F.col("o_custkey").alias("PatientID"), (F.col("o_orderkey") % (n_supp + 3)).alias("DoctorID"),
        (F.col("o_custkey") % n_supp).alias("NurseID"),
        F.date_add(F.col("o_orderdate").cast("date"), 30).alias("AppointmentDate"),
        F.lit(36000).alias("AppointmentTime"), F.lit(None).cast("string").alias("Status"),
        F.col("o_orderpriority").alias("Purpose"))


def book_appointments_flow(spark, d):
    """The booking flow over ``_bookings``: the new appointment rows with their keys and nurses."""
    from wardbook.operators.flows import book_appointments
    t, reqs = _bookings(spark, d)
    out, _rejected = book_appointments(t, reqs)
    return out["Appointment"].join(t["Appointment"].select("AppointmentID"), "AppointmentID", "left_anti")


def _ledger(t: dict[str, DataFrame]) -> DataFrame:
    p = t["Payments"]
    return p.select("AppointmentID", "Amount", F.col("event_id").alias("seq"),
                    F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.lit("Card"))
                    .alias("PaymentMethod"))


def payments_apply(spark, d):
    """The purchase ledger applied to fresh bills."""
    t = _tables(spark, d)
    bills = B.derive_billing(t)
    return _bills(B.apply_payments(bills, _ledger(t), key="AppointmentID", seq="seq"))


def _faulty_ledger(t: dict[str, DataFrame]) -> DataFrame:
    """The ledger with some payments that can't be booked, alone or with the bill's others."""
    amount = F.col("Amount").cast("decimal(22,2)")
    return _ledger(t).select(
        F.when(F.col("seq") % 389 == 11, F.lit(-1)).otherwise(F.col("AppointmentID")).alias("AppointmentID"), "seq",
        F.when(F.col("seq") % 97 == 3, amount * 1000000000).when(F.col("seq") % 101 == 7, F.lit(None))
         .when(F.col("seq") % 409 == 5, F.lit("99999999.99").cast("decimal(22,2)")).otherwise(amount).cast("decimal(33,2)").alias("Amount"), "PaymentMethod")


def payments_rejects(spark, d):
    """The payments that can't be booked, each with its reason."""
    t = _tables(spark, d)
    out = B.payment_rejects(B.derive_billing(t), _faulty_ledger(t), key="AppointmentID")
    return out.select("AppointmentID", "seq", F.col("Amount").cast("double").alias("Amount"), "reason")


def payments_apply_faulty(spark, d):
    """All bills after a ledger of which some payments can't be booked."""
    t = _tables(spark, d)
    return _bills(B.apply_payments(B.derive_billing(t), _faulty_ledger(t), key="AppointmentID", seq="seq"))


def billing_set_status(spark, d):
    """Bills with key % 17 = 0 set to Paid by hand."""
    b = _tables(spark, d)["BillingRecord"]
    ch = b.filter(F.col("BillingID") % 17 == 0).select("BillingID", F.lit("Paid").alias("PaymentStatus"))
    return _bills(B.set_status(b, ch))


def approve_requests(spark, d):
    """Requested appointments become Scheduled."""
    return B.approve_requests(_tables(spark, d)["Appointment"])


# ---------------------------------------------------------------------------
# scoping
# ---------------------------------------------------------------------------

def scope_appointments(spark, d):
    """Appointments visible to each of twelve viewers."""
    return X.scope_appointments(_tables(spark, d)["Appointment"], viewers(spark))


def scope_billing(spark, d):
    """Bills visible to each of twelve viewers."""
    return _bills(X.scope_billing(_tables(spark, d), viewers(spark)))


def role_matrix(spark, d):
    """Every role x table x verb with its permission and readable rows."""
    return X.role_matrix(_tables(spark, d))


# ---------------------------------------------------------------------------
# streaming
# ---------------------------------------------------------------------------

def _stream(spark, d: str, name: str, schema):
    """A table's files as a stream, whether it is one file or a folder of part files
    (a pattern, as a plain path to one file is refused by the file stream)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{d}/{name}[.]parquet")


def stream_billing(spark, d):
    """Line items streamed as treatment batches keep the bills current."""
    from wardbook.streaming.billing_stream import stream_billing as run
    t = _tables(spark, d)
    li_schema = _raw(spark, d, "lineitem").schema
    base = dict(t)
    base["Treatment"] = t["Treatment"].where(F.lit(False))  # nothing treated yet; all comes by the stream
    # every appointment, nothing billed yet; stored once, as a billing table would be
    base["BillingRecord"] = cut_lineage(B.derive_billing(base))
    src = _stream(spark, d, "lineitem", li_schema)

    def to_treatment(li: DataFrame) -> DataFrame:
        return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("TreatmentID"),
                         F.col("l_partkey").alias("DiagnosisID"),
                         F.col("l_orderkey").alias("AppointmentID"),
                         F.col("l_returnflag").alias("TreatmentName"),
                         F.lit(None).cast("string").alias("Description"),
                         F.col("l_extendedprice").cast("decimal(10,2)").alias("TreatmentCost"))

    return _bills(run(spark, base, src, to_treatment=to_treatment))


def stream_payments(spark, d):
    """Purchase events streamed into running paid totals."""
    from wardbook.streaming.billing_stream import stream_payments as run
    ev_schema = _raw(spark, d, "events").schema
    src = _stream(spark, d, "events", ev_schema)
    return _out(run(spark, payments_from_events(src)))


QUERIES: dict[str, Query] = {name: fn for name, fn in list(globals().items())
                             if callable(fn) and getattr(fn, "__module__", None) == __name__
                             and not name.startswith("_") and name not in ("viewers",)}
