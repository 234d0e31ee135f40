"""Role scoping as row filters for many viewers at once.

``viewers``: (viewer_id, role, linked_record_id, patient_record_id).

A restricted viewer (a linked patient, doctor or nurse) gets its rows by an
equi-join on the matching column, never by one OR-join (which Spark could
only run as a nested loop). Viewers who see
everything are *not* crossed with the table: the full table is emitted once
with ``scope = 'all'`` and ``viewer_id`` NULL, and ``viewer_scopes`` tells
which viewers hold that scope. Output grows with the data, never with
(viewers x rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardbook.operators.listings import bills_with_patient_names, with_balance

Tables = dict[str, DataFrame]

# FIXED VALUES: which roles may call each (table, verb) of the service.
ROLE_MATRIX: dict[tuple[str, str], list[str]] = {
    ("Users", "GET"): ["admin"],
    ("Users", "POST"): ["admin"],
    ("Users", "PUT"): ["admin"],
    ("Users", "DELETE"): ["admin"],
    ("Patient", "GET"): ["admin", "receptionist", "doctor", "nurse"],
    ("Patient", "POST"): ["admin", "receptionist"],
    ("Patient", "PUT"): ["admin", "receptionist"],
    ("Patient", "DELETE"): ["admin", "receptionist"],
    ("Patient", "GET-own"): ["patient"],  # the row that the account is linked to
    ("Doctor", "GET"): ["admin", "receptionist", "doctor", "nurse", "patient"],
    ("Doctor", "POST"): ["admin"],
    ("Doctor", "PUT"): ["admin"],
    ("Doctor", "DELETE"): ["admin"],
    ("Nurse", "GET"): ["admin", "receptionist", "doctor", "nurse", "patient"],
    ("Appointment", "GET"): ["admin", "receptionist", "doctor", "nurse", "patient"],
    ("Appointment", "POST"): ["admin", "receptionist", "doctor", "patient"],
    ("Appointment", "PUT"): ["admin", "receptionist", "doctor", "patient"],
    ("Appointment", "DELETE"): ["admin", "receptionist", "doctor"],
    ("Treatment", "GET"): ["admin", "doctor", "receptionist", "nurse"],
    ("Treatment", "POST"): ["admin", "doctor"],
    ("Treatment", "DELETE"): ["admin", "doctor"],
    ("BillingRecord", "GET"): ["admin", "doctor", "receptionist", "patient", "nurse"],
    ("BillingRecord", "PUT"): ["admin", "doctor", "receptionist", "patient", "nurse"],
    ("BillingRecord", "POST"): ["admin"],
    ("HospitalAdmin", "GET"): ["admin"],
    ("HospitalAdmin", "POST"): ["admin"],
    ("HospitalAdmin", "DELETE"): ["admin"],
    ("Reports", "GET"): ["admin"],
}


def allowed(role: str, table: str, verb: str) -> bool:
    """X3 checked before a plan is built."""
    return role in ROLE_MATRIX.get((table, verb), [])


def resolve_record_id(linked: Column, patient: Column) -> Column:
    """The linked id, else the patient id; 0 counts as absent."""
    return F.coalesce(F.nullif(linked, F.lit(0)), F.nullif(patient, F.lit(0)))


def viewer_scopes(viewers: DataFrame, unlinked: str = "all") -> DataFrame:
    """Each viewer's scope: 'patient', 'doctor', 'nurse' (with the id that
    filters), 'all', or 'none'. ``unlinked`` is the scope of staff without a
    link ('all' as in the service, or 'none')."""
    rid = resolve_record_id(F.col("linked_record_id"), F.col("patient_record_id"))
    pid = F.nullif(F.col("patient_record_id"), F.lit(0))
    role = F.col("role")
    scope = (F.when(role == "patient", F.when(pid.isNotNull(), F.lit("patient"))
                    .otherwise(F.lit("none")))
              .when(role.isin("doctor", "nurse"),
                    F.when(rid.isNotNull(), role).otherwise(F.lit(unlinked)))
              .otherwise(F.lit("all")))
    rec = F.when(role == "patient", pid).when(role.isin("doctor", "nurse"), rid)
    return viewers.select("viewer_id", "role", scope.alias("scope"), rec.alias("record_id"))


def _branch(scopes: DataFrame, rows: DataFrame, scope: str, column: str) -> DataFrame:
    v = (scopes.filter(F.col("scope") == scope)
         .select("viewer_id", "scope", F.col("record_id").alias(column)))
    return v.join(rows, column, "inner").select("viewer_id", "scope", *rows.columns)


def _all_branch(scopes: DataFrame, rows: DataFrame) -> DataFrame:
    anyone = scopes.filter(F.col("scope") == "all")
    return rows.filter(anyone.exists()).select(
        F.lit(None).cast(scopes.schema["viewer_id"].dataType).alias("viewer_id"),
        F.lit("all").alias("scope"), *rows.columns)


_APPOINTMENT_LINKS = (("patient", "PatientID"), ("doctor", "DoctorID"), ("nurse", "NurseID"))


def scope_appointments(appts: DataFrame, viewers: DataFrame, unlinked: str = "all") -> DataFrame:
    """Appointments visible per viewer. Patients see their own (none when
    unlinked), doctors and nurses those they are booked on, everyone else
    (and unlinked staff, by default) all of them.

    One scan serves all restricted viewers: each appointment emits its
    (scope, id) match keys -- patient, doctor, nurse -- by a narrow explode,
    and a single equi-join on (scope, id) pairs them with the viewers. A
    viewer has one scope, so it meets each appointment at most once.
    """
    s = viewer_scopes(viewers, unlinked)
    links = F.explode(F.array(*[
        F.struct(F.lit(scope).alias("_scope"), F.col(col).cast("long").alias("_rid"))
        for scope, col in _APPOINTMENT_LINKS]))
    keyed = (appts.select("*", links.alias("_k"))
             .select(*appts.columns, F.col("_k._scope").alias("_scope"), F.col("_k._rid").alias("_rid"))
             .filter(F.col("_rid").isNotNull()))
    v = (s.filter(F.col("scope").isin(*[scope for scope, _ in _APPOINTMENT_LINKS]))
         .select("viewer_id", "scope", F.col("scope").alias("_scope"),
                 F.col("record_id").cast("long").alias("_rid")))
    restricted = v.join(keyed, ["_scope", "_rid"]).select("viewer_id", "scope", *appts.columns)
    return restricted.unionByName(_all_branch(s, appts))


def scope_billing(T: Tables, viewers: DataFrame) -> DataFrame:
    """Bills visible per viewer. A linked patient sees their own bills
    joined to the patient row; every other role sees all bills (left join)."""
    s = viewer_scopes(viewers)
    b = T["BillingRecord"]
    p = T["Patient"].select("PatientID", "FirstName", "LastName")
    own = with_balance(b).join(p, "PatientID", "inner")
    own = own.select(*b.columns, "BalanceDue", "FirstName", "LastName")
    everyone = bills_with_patient_names(T)
    # the "all" branch includes staff without a link: only patients are filtered
    staff = s.withColumn("scope", F.when(F.col("role") == "patient", F.col("scope"))
                         .otherwise(F.lit("all")))
    return (_branch(staff, own, "patient", "PatientID")
            .unionByName(_all_branch(staff, everyone)))


def role_matrix(T: Tables) -> DataFrame:
    """X3 as data: every role x table x verb with its permission, and for
    allowed reads the number of rows the table holds."""
    spark = next(iter(T.values())).sparkSession
    from wardbook.schema import ROLES
    rows = [(r, t, v, r in roles) for (t, v), roles in ROLE_MATRIX.items() for r in ROLES]
    m = spark.createDataFrame(rows, "role string, table_name string, verb string, allowed boolean")
    counts = None
    for name in sorted({t for t, _ in ROLE_MATRIX if t in T}):
        c = T[name].select(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("table_rows"))
        counts = c if counts is None else counts.unionByName(c)
    j = m.join(counts, "table_name", "left")
    return j.select("role", "table_name", "verb", "allowed",
                    F.when(F.col("allowed") & (F.col("verb") == "GET"),
                           F.coalesce(F.col("table_rows"), F.lit(0))).otherwise(F.lit(0))
                    .cast("long").alias("readable_rows"))
