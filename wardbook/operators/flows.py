"""The service's write flows as set-based jobs over whole batches.

``add_treatments``: request bodies (one object or a list each) are parsed and
checked; a request with any bad item is rejected whole; the accepted items get
TreatmentIDs after the current maximum, and the bills of the touched
appointments are re-derived. ``remove_treatments`` deletes by key and re-derives
the bills the deleted rows belonged to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.operators.billing import refresh_billing
from wardbook.operators.changes import delete_by_key, number_new_rows
from wardbook.operators.checks import validate_insert
from wardbook.operators.listings import assign_nurse
from wardbook.schema import MONEY
from wardbook.session import cut_lineage
from wardbook.sources.json_io import NO_OBJECT, UNREADABLE, item_field, json_items

# Reject reasons of the flows (the library's own codes).
NO_APPOINTMENT, BAD_DIAGNOSIS = "appointment missing", "diagnosis not a number"
NULL_COST, BAD_COST = "cost is null", "cost not an amount"
NO_OWN_RECORD = "no linked patient record"


def treatment_items(requests: DataFrame, body: str, request_id: str) -> DataFrame:
    """One row per item of each request: its fields, and ``_reason`` if the body or the
    item is unusable (a body without items gives one such row).

    Fields are read as text and cast, as forms post numbers as strings. A cost
    that is absent or empty is 0; one that is null, no number or out of range is
    a fault, and so is an appointment that is absent, 0 or no number.
    """
    rows, field = json_items(requests, body, [request_id]), item_field

    def number(name: str):
        return F.nullif(F.trim(field(name)), F.lit("")).try_cast("bigint")

    given = F.nullif(F.trim(field("TreatmentCost")), F.lit(""))
    amount = F.coalesce(given, F.lit("0")).try_cast(MONEY)
    reason = (F.when(F.col("_reason") == NO_OBJECT, F.lit(UNREADABLE)).when(F.col("_reason").isNotNull(), F.col("_reason"))
               .when(F.coalesce(number("AppointmentID"), F.lit(0)) == 0, F.lit(NO_APPOINTMENT))
               .when(F.length(F.trim(field("DiagnosisID"))) > 0,
                     F.when(number("DiagnosisID").isNull(), F.lit(BAD_DIAGNOSIS))))
    cost_fault = (F.when(F.map_contains_key(F.col("_f"), "TreatmentCost") & field("TreatmentCost").isNull(), F.lit(NULL_COST))
                   .when(amount.isNull(), F.lit(BAD_COST)))
    return rows.select(request_id, "_item",
                       number("DiagnosisID").alias("DiagnosisID"), number("AppointmentID").alias("AppointmentID"),
                       field("TreatmentName").alias("TreatmentName"), field("Description").alias("Description"),
                       amount.alias("TreatmentCost"), F.coalesce(reason, cost_fault).alias("_reason"))


def check_treatments(tables: dict[str, DataFrame], requests: DataFrame, body: str = "body",
                     request_id: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """What ``add_treatments`` would do, without doing it: the accepted items (with the
    request and ``_item``), and the rejected requests with a reason, that of the first bad item.

    Besides the checks of ``treatment_items`` every rule of the table holds
    (parents, NOT NULL, lengths); one bad item rejects its whole request.
    """
    # parsed once; the checks and what follows read this copy
    items = cut_lineage(treatment_items(requests, body, request_id))
    usable = items.filter(F.col("_reason").isNull()).drop("_reason")
    good, bad = validate_insert(usable, "Treatment", tables, generated_key=True)
    faults = (items.filter(F.col("_reason").isNotNull()).select(request_id, "_item", F.col("_reason").alias("reason"))
              .unionByName(bad.select(request_id, "_item", "reason")))
    rejected = (faults.groupBy(request_id).agg(F.min(F.struct("_item", "reason")).alias("_first"))
                .select(request_id, F.col("_first.reason").alias("reason")))
    return good, rejected


def add_treatments(tables: dict[str, DataFrame], requests: DataFrame, body: str = "body",
                   request_id: str = "request_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """Apply a batch of treatment requests; returns (new tables, rejected requests), as
    ``check_treatments`` finds them."""
    treat = tables["Treatment"]
    good, rejected = check_treatments(tables, requests, body, request_id)
    rejected = cut_lineage(rejected)
    new = good.join(rejected.select(request_id), request_id, "left_anti").select(
        F.lit(None).cast(treat.schema["TreatmentID"].dataType).alias("TreatmentID"),
        "DiagnosisID", "AppointmentID", "TreatmentName", "Description", "TreatmentCost", request_id, "_item")
    numbered = number_new_rows(new, treat, "TreatmentID", order=[request_id, "_item"])
    added = numbered.select(*[F.col(c).cast(treat.schema[c].dataType) for c in treat.columns])
    out = dict(tables)
    out["Treatment"] = treat.unionByName(added)
    out["BillingRecord"] = refresh_billing(out, added)
    return out, rejected


def remove_treatments(tables: dict[str, DataFrame], keys: DataFrame) -> dict[str, DataFrame]:
    """Delete treatments by TreatmentID and re-derive the bills they belonged to
    (with none left a bill's total is 0 and it counts as Paid)."""
    treat = tables["Treatment"]
    gone = treat.join(keys.select("TreatmentID"), "TreatmentID", "left_semi")
    out = dict(tables)
    out["Treatment"] = delete_by_key(treat, keys, "TreatmentID")
    out["BillingRecord"] = refresh_billing(out, gone)
    return out


def book_appointments(tables: dict[str, DataFrame],
                      requests: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Book a batch of appointments; returns (new tables, rejected with reason).

    ``requests``: (seq, role, patient_record_id, PatientID, DoctorID, NurseID,
    AppointmentDate, AppointmentTime, Status, Purpose) -- ``role`` and
    ``patient_record_id`` describe the requester. Every request gets a new
    AppointmentID after the current maximum, in ``seq`` order. Status
    defaults to Scheduled. A patient books for their own record with status
    Requested and a nurse chosen as the portal does (the doctor's
    department's first nurse, else the first nurse); a patient account
    without a record is rejected. References must exist (NULL passes).
    """
    appts = tables["Appointment"]
    is_pat = F.col("role") == "patient"
    own = F.nullif(F.col("patient_record_id"), F.lit(0))
    r = requests.select(
        "seq", F.when(is_pat & own.isNull(),
                      F.lit(NO_OWN_RECORD)).alias("_reason"),
        F.when(is_pat, own).otherwise(F.col("PatientID")).alias("PatientID"), "DoctorID",
        "NurseID", "AppointmentDate", "AppointmentTime",
        F.when(is_pat, F.lit("Requested")).otherwise(F.coalesce(F.col("Status"), F.lit("Scheduled")))
        .alias("Status"), "Purpose", is_pat.alias("_portal"))
    no_record = r.filter(F.col("_reason").isNotNull()).select("seq", F.col("_reason").alias("reason"))
    r = r.filter(F.col("_reason").isNull())
    portal = assign_nurse(r.filter(F.col("_portal")), tables["Doctor"], tables["Nurse"])
    r = r.filter(~F.col("_portal")).unionByName(portal)
    typed = r.select("seq", *[F.col(c).cast(appts.schema[c].dataType).alias(c)
                              for c in appts.columns if c != "AppointmentID"])
    good, bad = validate_insert(typed, "Appointment", tables, generated_key=True)
    new = cut_lineage(good.withColumn("AppointmentID", F.lit(None).cast(
        appts.schema["AppointmentID"].dataType)))
    numbered = number_new_rows(new, appts, "AppointmentID", order=["seq"])
    out = dict(tables)
    out["Appointment"] = appts.unionByName(numbered.select(*appts.columns))
    rejected = no_record.unionByName(bad.select("seq", "reason"))
    return out, rejected
