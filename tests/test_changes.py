"""Keyed changes, key assignment, cascades and checks."""

from pyspark.sql import functions as F

from wardbook.functions.scalars import split_full_name
from wardbook.operators import changes as D
from wardbook.operators import checks as V
from wardbook.session import cut_lineage


def test_assign_ids_matches_global_row_number(spark):
    df = spark.range(0, 5000).select(F.lit(None).cast("long").alias("id"),
                                     ((F.col("id") * 7919) % 5000).alias("k"))
    target = spark.createDataFrame([(10,), (42,)], "id long")
    got = D.assign_ids(df, target, "id", order=["k"], num_partitions=7)
    rows = sorted((r["k"], r["id"]) for r in got.collect())
    assert [i for _, i in rows] == list(range(43, 43 + 5000))


def test_assign_ids_keeps_given_keys(spark):
    df = spark.createDataFrame([(None, 1), (7, 2), (None, 3)], "id long, k int")
    got = sorted((r["k"], r["id"]) for r in D.assign_ids(df, None, "id", ["k"]).collect())
    assert got == [(1, 1), (2, 7), (3, 2)]


def test_update_latest_wins_and_absent_becomes_null(spark):
    t = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, name string, n int")
    ch = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (3, "z", 1)], "k int, name string, seq int")
    got = {r["k"]: r for r in D.update_by_key(t, ch, "k", seq="seq").collect()}
    assert got[1]["name"] == "y" and got[1]["n"] is None
    assert got[2]["name"] == "b" and got[2]["n"] == 20 and 3 not in got


def test_upsert_and_insert_ignore(spark):
    t = spark.createDataFrame([(1, "a", 10)], "k int, name string, n int")
    src = spark.createDataFrame([(1, "x", 99, 1), (2, "first", 1, 1), (2, "second", 2, 2)],
                                "k int, name string, n int, seq int")
    up = {r["k"]: r for r in D.merge_upsert(t, src, "k", ["name"], seq="seq").collect()}
    assert up[1]["name"] == "x" and up[1]["n"] == 10 and up[2]["name"] == "second"
    ig = {r["k"]: r for r in D.insert_ignore(t, src, "k", seq="seq").collect()}
    assert ig[1]["name"] == "a" and ig[2]["name"] == "first"


def test_cascade_delete_patient(spark, seed):
    keys = spark.createDataFrame([(1,)], "PatientID int")
    out = D.cascade_delete(seed, "Patient", keys)
    assert out["Patient"].filter("PatientID = 1").count() == 0
    assert out["Appointment"].filter("AppointmentID = 1").count() == 0
    assert out["Diagnosis"].filter("AppointmentID = 1").count() == 0
    assert out["Treatment"].filter("AppointmentID = 1").count() == 0
    assert out["BillingRecord"].filter("PatientID = 1").count() == 0
    assert out["Treatment"].count() == 29
    for (child, col), orphans in V.all_orphans(out).items():
        assert orphans.count() == 0, (child, col)


def test_cascade_set_null_edges(spark, seed):
    out = D.cascade_delete(seed, "Diagnosis", spark.createDataFrame([(3,)], "DiagnosisID int"))
    t = out["Treatment"].filter("TreatmentID = 3").collect()
    assert len(t) == 1 and t[0]["DiagnosisID"] is None
    out = D.cascade_delete(seed, "Doctor", spark.createDataFrame([(1,)], "DoctorID int"))
    a = out["Appointment"].filter("AppointmentID IN (1, 11, 21)").collect()
    assert len(a) == 3 and all(r["DoctorID"] is None for r in a)


def test_cascade_rekey(spark, seed):
    m = spark.createDataFrame([(1, 101)], "old_key int, new_key int")
    out = D.cascade_rekey(seed, "InsuranceProvider", m)
    assert out["Patient"].filter("ProviderID = 101").count() == 7
    assert out["InsuranceProvider"].filter("ProviderID = 101").count() == 1


def test_checks(spark, seed):
    li = spark.createDataFrame([(1, 1, 1.0), (1, 1, 5.0), (2, 1, 3.0)], "o long, ln int, q double")
    assert [tuple(r) for r in V.duplicate_keys(li, ["o", "ln"]).collect()] == [(1, 1, 2)]
    flags = {r["o"]: r["rejected"] for r in V.batch_flags(li, "o", F.col("q") < 2).collect()}
    assert flags == {1: True, 2: False}
    assert V.accept_batches(li, "o", F.col("q") < 2).count() == 1
    long_name = seed["Department"].withColumn("DepartmentName", F.lit("x" * 51))
    assert V.too_long(long_name, {"DepartmentName": 50}).count() == 5
    good, bad = V.validate(long_name, "Department")
    assert good.count() == 0 and bad.count() == 5
    assert V.diagnosis_mismatch(seed).count() == 0


def test_split_full_name(spark):
    df = spark.createDataFrame([("Ann",), ("Ann Lee",), ("Ann van Lee",), (None,), ("",)], "n string")
    first, last = split_full_name(F.col("n"), F.lit("user"))
    got = [tuple(r) for r in df.select(first, last).collect()]
    assert got == [("Ann", ""), ("Ann", "Lee"), ("Ann", "van Lee"), ("user", ""), ("user", "")]


def test_expand_accounts(spark, seed):
    feed = spark.createDataFrame(
        [(1, "register", "ann", None, "Ann Lee", None, None, None),
         (2, "admin", "doc", "doctor", "Meredith Grey", "Surgery", "555", 1),
         (3, "admin", "pat", "patient", "Bob", None, None, None),
         (4, "admin", "nur", "nurse", "Nina", None, None, 2),
         (5, "register", "zed", None, None, None, None, None),
         (6, "admin", "doc2", "doctor", None, None, None, 0),
         (7, "admin", "jan", "janitor", "Jo", None, None, None),
         (8, "register", "ann", None, "Ann Again", None, None, None),
         (9, "admin", "taken", "nurse", "T", None, None, None)],
        "seq int, source string, username string, role string, full_name string, "
        "specialty string, phone string, department_id int")
    t = dict(seed)
    t["Users"] = spark.createDataFrame([(1, "taken", "x", "admin", None, None, None)],
                                       "id int, username string, password_hash string, role string, "
                                       "full_name string, patient_record_id int, linked_record_id int")
    out = D.expand_accounts(feed, t)
    users = {r["username"]: r for r in out["Users"].collect()}
    assert users["ann"]["role"] == "patient" and users["ann"]["patient_record_id"] == 31
    assert users["doc"]["linked_record_id"] == 11 and users["nur"]["linked_record_id"] == 11
    assert users["pat"]["patient_record_id"] is None and users["pat"]["linked_record_id"] is None
    assert users["zed"]["full_name"] is None and users["doc2"]["full_name"] == ""
    assert sorted(u["id"] for u in users.values()) == [2, 3, 4, 5, 6, 7]
    rejected = {r["seq"]: r["reason"] for r in out["Rejected"].collect()}
    assert rejected == {7: "role not known", 8: "username taken", 9: "username taken"}
    patients = {r["PatientID"]: r for r in out["Patient"].collect()}
    assert (patients[31]["FirstName"], patients[31]["LastName"]) == ("Ann", "Lee")
    assert (patients[32]["FirstName"], patients[32]["LastName"]) == ("zed", "")
    docs = {r["DoctorID"]: r for r in out["Doctor"].collect()}
    assert docs[11]["LastName"] == "Grey" and docs[11]["DepartmentID"] == 1
    assert (docs[12]["FirstName"], docs[12]["LastName"], docs[12]["DepartmentID"]) == ("", "", None)


def test_validate_insert(spark, seed):
    rows = [(31, "Ann", "Lee", None, None, None, None, 1),      # good
            (32, "Bo", "Ng", None, None, None, None, 9),       # unknown provider
            (1, "Cy", "Doe", None, None, None, None, None),    # key exists
            (33, None, "X", None, None, None, None, None),     # NOT NULL
            (34, "D" * 51, "X", None, None, None, None, None),  # too long
            (35, "E", "X", None, None, None, None, None),      # repeated in the batch
            (35, "F", "X", None, None, None, None, None)]
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in seed["Patient"].schema])
    df = spark.createDataFrame(rows, schema)  # incoming rows are not yet checked
    good, bad = V.validate_insert(df, "Patient", seed)
    assert [r["PatientID"] for r in good.collect()] == [31]
    reasons = {(r["PatientID"], r["FirstName"]): r["reason"] for r in bad.collect()}
    assert reasons[(32, "Bo")] == "ProviderID has no InsuranceProvider"
    assert reasons[(1, "Cy")] == "PatientID already exists"
    assert reasons[(33, None)] == "FirstName is NULL"
    assert reasons[(34, "D" * 51)] == "FirstName longer than 50"
    assert reasons[(35, "E")] == reasons[(35, "F")] == "PatientID repeated in the batch"


def test_cascade_delete_materialized_equals_lazy(spark, seed):
    keys = spark.createDataFrame([(1,), (5,)], "PatientID int")
    lazy = D.cascade_delete(seed, "Patient", keys)
    stored = D.cascade_delete(seed, "Patient", keys, materialize=True)
    for name in ("Appointment", "Diagnosis", "Treatment", "BillingRecord", "Patient"):
        a, b = lazy[name], stored[name]
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name
    assert stored["BillingRecord"].count() == 28


def test_null_and_tied_sequence_numbers(spark):
    """A NULL seq loses to any other, but still changes a key that has none; ties go to the largest row."""
    from wardbook.operators.changes import insert_ignore, update_by_key
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    ch = spark.createDataFrame([(1, "x", None), (2, "y", 5), (2, "z", None), (3, "p", 7), (3, "q", 7)], "k int, v string, seq int")
    assert sorted(map(tuple, update_by_key(t, ch, "k", ["v"], seq="seq").collect())) == [(1, "x"), (2, "y"), (3, "q")]
    new = spark.createDataFrame([(4, "n", 1), (4, "m", None)], "k int, v string, seq int")
    assert (4, "m") in map(tuple, insert_ignore(t, new, "k", seq="seq").collect())


def test_usernames_without_regard_to_case(spark):
    from wardbook.operators.changes import expand_accounts
    feed = spark.createDataFrame([(1, "admin", "Bob", "doctor", "B", None, None, 1), (2, "admin", "bob ", "doctor", "B", None, None, 1)],
                                 "seq int, source string, username string, role string, full_name string, specialty string, phone string, department_id long")
    assert expand_accounts(feed, {})["Users"].count() == 2
    out = expand_accounts(feed, {}, ci=True)
    assert [tuple(r) for r in out["Rejected"].collect()] == [(2, "bob ", "username taken")] and out["Users"].count() == 1


def test_ambiguous_key_changes_double_nothing(spark, seed):
    moves = [(1, 101), (1, 102), (2, 3), (3, 200), (4, 200), (5, None), (None, 7), (99, 300)]
    m = spark.createDataFrame(moves, "old_key int, new_key int")
    reasons = {(r["old_key"], r["new_key"]): r["reason"] for r in D.rekey_rejects(seed, "InsuranceProvider", m).collect()}
    assert reasons == {(1, 101): D.SEVERAL_KEYS, (1, 102): D.SEVERAL_KEYS, (2, 3): D.KEY_EXISTS, (3, 200): D.KEY_TWICE, (4, 200): D.KEY_TWICE, (5, None): D.NO_KEY, (None, 7): D.NO_KEY}
    out = D.cascade_rekey(seed, "InsuranceProvider", m)
    for t in ("InsuranceProvider", "Patient"):
        assert sorted(map(str, out[t].collect())) == sorted(map(str, seed[t].collect()))
    sound = D.cascade_rekey(seed, "InsuranceProvider", spark.createDataFrame([(1, 101), (1, 101), (2, 2)], "old_key int, new_key int"))
    assert sorted(r[0] for r in sound["InsuranceProvider"].select("ProviderID").collect())[-1] == 101
    assert sound["InsuranceProvider"].count() == seed["InsuranceProvider"].count()


def test_account_feeds_with_tied_and_missing_numbers(spark, seed):
    """Ties and NULLs of seq, and rows listed twice, give one account a name and no crossed links."""
    rows = [(1, "admin", "a", "doctor", "Ann A"), (1, "admin", "b", "nurse", "Bea B"), (None, "admin", "c", "doctor", "Cyd C"), (None, "admin", "c", "doctor", "Dee D"),
            (1, "admin", "a", "doctor", "Ann A"), (2, "register", "d", None, "Eve E")]
    feed = spark.createDataFrame([(*r, None, None, None) for r in rows],
                                 "seq long, source string, username string, role string, full_name string, specialty string, phone string, department_id long").repartition(3)
    out = {k: v.collect() for k, v in D.expand_accounts(feed, seed).items()}
    users = sorted(out["Users"], key=lambda r: r["id"])
    assert [(r["username"], r["full_name"]) for r in users] == [("a", "Ann A"), ("b", "Bea B"), ("d", "Eve E"), ("c", "Cyd C")]
    doctors = {r["DoctorID"]: r["FirstName"] for r in out["Doctor"]}
    assert [doctors.get(r["linked_record_id"]) for r in users if r["role"] == "doctor"] == ["Ann", "Cyd"] and len(doctors) == 2
    assert len(out["Nurse"]) == len(out["Patient"]) == 1
    assert sorted((r["username"], r["reason"]) for r in out["Rejected"]) == [("a", D.NAME_TAKEN), ("c", D.NAME_TAKEN)]


def test_references_are_checked_by_stored_keys(spark, seed):
    """Parents are read when the keys are checked; what follows joins the few keys without one."""
    few = [(i % 40 if i % 7 else None, i) for i in range(400)]
    batch = spark.createDataFrame(few, "DiagnosisID int, n int").select("DiagnosisID", F.lit(5).alias("AppointmentID"), F.lit("x").alias("TreatmentName"),
                                                                      F.lit(None).cast("string").alias("Description"), F.lit("1.00").cast("decimal(10,2)").alias("TreatmentCost"), "n")
    known = {r[0] for r in seed["Diagnosis"].select("DiagnosisID").collect()}
    stored = {**seed, "Diagnosis": cut_lineage(seed["Diagnosis"].withColumn("mark_of_parents", F.lit(1)))}
    good, bad = V.validate_insert(batch, "Treatment", stored, generated_key=True)
    assert {r["n"]: r["reason"] for r in bad.collect()} == {n: "DiagnosisID has no Diagnosis" for d, n in few if d is not None and d not in known}
    assert {r["n"] for r in good.collect()} == {n for d, n in few if d is None or d in known}
    [path] = {f.rsplit("/", 1)[0] for f in stored["Diagnosis"].inputFiles()}
    assert path.rsplit("/", 1)[1] not in {f.rsplit("/", 2)[-2] for f in bad.inputFiles()}
    missing = V.missing_parents(batch, "DiagnosisID", stored["Diagnosis"], "DiagnosisID")
    assert sorted(r[0] for r in missing.collect()) == sorted({d for d, _ in few if d is not None} - known)
