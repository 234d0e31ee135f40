"""Listings, lookups, scoping and JSON."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardbook.functions import scalars as S
from wardbook.operators import listings as L
from wardbook.operators import scope as X
from wardbook.sources import json_io
from wardbook.sources.tables import ensure_columns

VIEWERS = "viewer_id int, role string, linked_record_id int, patient_record_id int"


def test_assign_nurse(spark, seed):
    doctors = seed["Doctor"].unionByName(spark.createDataFrame(
        [(11, "No", "Dept", None, None, None)], seed["Doctor"].schema))
    nurses = seed["Nurse"].unionByName(spark.createDataFrame(
        [(11, "Null", "Dept", None, None, None)], seed["Nurse"].schema))
    req = spark.createDataFrame([(1, 1), (2, 11), (3, 99), (4, 6)], "AppointmentID int, DoctorID int")
    got = {r["AppointmentID"]: r["NurseID"] for r in L.assign_nurse(req, doctors, nurses).collect()}
    # dept 3 -> nurse 1; NULL dept matches the NULL-dept nurse; unknown doctor -> lowest overall
    assert got == {1: 1, 2: 11, 3: 1, 4: 7}
    no_dept_nurse = seed["Nurse"].filter("DepartmentID <> 1")
    got = {r["AppointmentID"]: r["NurseID"] for r in L.assign_nurse(req, doctors, no_dept_nurse).collect()}
    assert got[4] == 1


def test_names_and_search(spark, seed):
    a = seed["Appointment"].unionByName(spark.createDataFrame(
        [(99, 77, None, 0, None, 0, "Requested", None)], seed["Appointment"].schema))
    got = {r["AppointmentID"]: r for r in L.appointments_with_names(seed, a).collect()}
    assert got[1]["DoctorName"] == "Dr. House" and got[1]["NurseName"] == "Carla Espinosa"
    assert got[1]["TimeHHMM"] == "09:00"
    assert got[99]["PatientName"] == "#77" and got[99]["DoctorName"] == "—"
    assert got[99]["NurseName"] == "—" and got[99]["TimeHHMM"] == "00:00"
    hits = L.search_rows(seed["Patient"], "DOEJ", ["LastName", "FirstName"]).collect()
    assert [r["PatientID"] for r in hits] == [1]  # match spans two cells


def test_filters(seed):
    assert L.cancellable_appointments(seed["Appointment"]).count() == 0
    payable = L.payable_bills(seed["BillingRecord"])
    assert payable.count() == 12
    assert L.empty_like(seed["Appointment"]).count() == 0
    assert L.by_key(seed["Appointment"], "DoctorID", [1, 2]).count() == 6


def test_scope_appointments(spark, seed):
    v = spark.createDataFrame([(1, "patient", None, 3), (2, "patient", None, None),
                               (3, "doctor", 1, None), (4, "nurse", None, None),
                               (5, "doctor", 0, 2)], VIEWERS)
    got = X.scope_appointments(seed["Appointment"], v)
    per = {r["viewer_id"]: r["n"] for r in got.groupBy("viewer_id").count()
           .withColumnRenamed("count", "n").collect()}
    assert per[1] == 1 and 2 not in per and per[3] == 3 and per[5] == 3
    assert per[None] == 30  # the whole table once, for the unlinked nurse
    scopes = {r["viewer_id"]: r["scope"] for r in X.viewer_scopes(v).collect()}
    assert scopes == {1: "patient", 2: "none", 3: "doctor", 4: "all", 5: "doctor"}
    strict = X.scope_appointments(seed["Appointment"], v, unlinked="none")
    assert strict.filter(F.col("viewer_id").isNull()).count() == 0


def test_scope_billing(spark, seed):
    v = spark.createDataFrame([(1, "patient", None, 5), (2, "patient", None, None)], VIEWERS)
    got = X.scope_billing(seed, v).collect()
    assert len(got) == 1 and got[0]["FirstName"] == "Charlie" and float(got[0]["BalanceDue"]) == 16.0
    v2 = spark.createDataFrame([(3, "receptionist", None, None)], VIEWERS)
    assert X.scope_billing(seed, v2).count() == 30
    assert X.allowed("doctor", "Treatment", "POST") and not X.allowed("nurse", "Treatment", "POST")


def test_scalars(spark):
    df = spark.createDataFrame([(1234.5, 0.8, "Paid", "12abc", 3600 * 9 + 60 * 5),
                                (None, None, None, "x", None)],
                               "m double, f double, s string, p string, t int")
    got = df.select(S.fmt_money(F.col("m")), S.fmt_pct(F.col("f")), S.status_class(F.col("s")),
                    S.parse_lenient(F.col("p")), S.hhmm(F.col("t"))).collect()
    assert tuple(got[0]) == ("$1,234.50", "80.0%", "badge-paid", 12.0, "09:05")
    assert tuple(got[1]) == ("—", "—", "", 0.0, None)
    strict = spark.createDataFrame([("12.5",)], "p string").select(S.parse_strict(F.col("p"))).collect()
    assert strict[0][0] == 12.5


def test_json_roundtrip(spark, seed):
    df = spark.createDataFrame([(1, '{"AppointmentID": 5, "TreatmentCost": 9.5}'),
                                (2, '[{"AppointmentID": 6}, {"AppointmentID": 7}]')],
                               "req int, body string")
    schema = T.StructType([T.StructField("AppointmentID", T.IntegerType()),
                           T.StructField("TreatmentCost", T.DecimalType(10, 2))])
    items = json_io.read_json_batch(df, "body", schema, keep=["req"]).collect()
    assert sorted((r["req"], r["AppointmentID"]) for r in items) == [(1, 5), (2, 6), (2, 7)]
    js = json_io.to_json_rows(seed["BillingRecord"].filter("BillingID = 4")).collect()[0]["json"]
    assert '"TotalCost":150.0' in js and '"BillingDate":"2026-04-20"' in js


def test_ensure_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    out = ensure_columns(df, [("a", T.IntegerType()), ("b", T.StringType())])
    assert out.columns == ["a", "b"] and out.collect()[0]["b"] is None
    assert ensure_columns(out, [("b", T.StringType())]).columns == ["a", "b"]


def test_json_files_roundtrip(spark, seed):
    from wardbook.session import scratch_path
    path = scratch_path(spark, "json")
    json_io.write_json(seed["Appointment"], path)
    schema = T.StructType([T.StructField("AppointmentID", T.IntegerType()),
                           T.StructField("AppointmentTime", T.StringType()),
                           T.StructField("AppointmentDate", T.StringType())])
    back = {r["AppointmentID"]: r for r in json_io.read_json_files(spark, path, schema).collect()}
    assert len(back) == 30
    assert back[1]["AppointmentTime"] == "09:00" and back[1]["AppointmentDate"] == "2026-04-20"


def test_choice_labels(seed):
    got = {(r["kind"], r["id"]): r["label"] for r in L.choice_labels(seed).collect()}
    assert got[("patient", 1)] == "John Doe"
    assert got[("doctor", 1)] == "Dr. Gregory House — Diagnostic Medicine"
    assert got[("nurse", 1)] == "Carla Espinosa (RN)"


def test_json_that_can_not_be_read_is_reported(spark, tmp_path):
    """Bad text, wrong types, absent fields, empty lists and items that are no objects come out with a reason."""
    from pyspark.sql import types as T

    from wardbook.sources import json_io
    schema = T.StructType([T.StructField("a", T.IntegerType(), False), T.StructField("d", T.DateType()), T.StructField("l", T.ArrayType(T.IntegerType()))])
    bodies = ['{"a": 1, "d": "2026-01-02", "l": [1, 2]}', '[{"a": "2"}, {"a": "x"}, {"d": "2026-01-01"}, 5, null, {"a": 3, "d": "soon"}, {"a": 4, "l": 7}]', "[]", "{}", "no json", '[{"a": 1}, {', None, '{"a": 2.5}']
    df = spark.createDataFrame(list(enumerate(bodies)), "req int, body string")
    rows = {(r["req"], r["at"], r["a"], str(r["d"]), tuple(r["l"] or ())) for r in json_io.read_json_batch(df, "body", schema, keep=["req"], position="at").collect()}
    assert rows == {(0, 0, 1, "2026-01-02", (1, 2)), (1, 0, 2, "None", ())}
    bad = {(r["req"], r["item"], r["reason"]) for r in json_io.json_rejects(df, "body", schema, keep=["req"]).collect()}
    assert bad == {(1, 1, "a is not a int"), (1, 2, "a is missing"), (1, 3, json_io.NO_OBJECT), (1, 4, json_io.NO_OBJECT), (1, 5, "d is not a date"), (1, 6, "l is not a array<int>"),
                   (2, 0, json_io.EMPTY), (3, 0, "a is missing"), (4, 0, json_io.UNREADABLE), (5, 0, json_io.UNREADABLE), (6, 0, json_io.UNREADABLE), (7, 0, "a is not a int")}
    (tmp_path / "part.json").write_text("\n".join(b for b in bodies if b is not None) + "\n\n")
    assert json_io.read_json_files(spark, str(tmp_path), schema).count() == 2
    files = json_io.json_file_rejects(spark, str(tmp_path), schema).collect()
    assert len(files) == len(bad) - 1 and all(r["file"].endswith("part.json") for r in files)
