"""Billing: derivation (B1), merge (B2), refresh (B3), payments.

Every operator is set-based: one plan for all appointments (or a key set)
instead of one procedure call per appointment. Treatments are aggregated per
appointment *before* any join, so a hot appointment is folded map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardbook.functions.money import money_sum
from wardbook.functions.scalars import text_key
from wardbook.schema import MONEY, RATE, UNINSURED_COVERAGE
from wardbook.operators.changes import latest_per_key, number_new_rows
from wardbook.session import cut_lineage

BILL_COLUMNS = ["BillingID", "PatientID", "AppointmentID", "TotalCost", "InsuranceCoverage",
                "AmountOwed", "AmountPaid", "PaymentStatus", "PaymentMethod", "BillingDate",
                "UpdatedAt"]


def paid_per_appointment(ledger: DataFrame, key: str = "AppointmentID",
                         amount: str = "Amount") -> DataFrame:
    """Sum a payment ledger per bill key: (key, AmountPaid). Partial sums map-side.

    Payments that don't fit the column are left out, and a total that doesn't fit is
    NULL: one of them stops nothing else (``payment_rejects`` lists both)."""
    return (ledger.groupBy(key)
            .agg(money_sum(F.col(amount).try_cast(MONEY)).try_cast(MONEY).alias("AmountPaid")))


def bill_status(appt_status: Column, owed: Column, paid: Column, ci: bool = False) -> Column:
    """Rules 5 and 6 of the derivation as one CASE.

    A payment already made overrides even Canceled; with no earlier bill
    ``paid`` is NULL and neither payment branch fires.
    """
    return (F.when((paid > 0) & (paid < owed), F.lit("Partial"))
             .when((paid >= owed) & (owed > 0), F.lit("Paid"))
             .when(text_key(appt_status, ci) == "Canceled", F.lit("Canceled"))
             .when(owed <= 0, F.lit("Paid"))
             .otherwise(F.lit("Unpaid")))


def _derive(T: dict[str, DataFrame], existing: DataFrame | None,
            keys: DataFrame | None, ci: bool = False) -> DataFrame:
    appt = T["Appointment"].select("AppointmentID", "PatientID", "Status", "AppointmentDate")
    treat = T["Treatment"].select("AppointmentID", "TreatmentCost")
    if keys is not None:
        keys = keys.select("AppointmentID").distinct()
        appt = appt.join(keys, "AppointmentID", "left_semi")
        treat = treat.join(keys, "AppointmentID", "left_semi")

    # Rule 3: total per appointment, aggregated before the joins.
    totals = (treat.groupBy("AppointmentID")
              .agg(money_sum(F.col("TreatmentCost")).alias("_sum")))
    # Rule 2: the patient's provider rate, 0.70 without a provider.
    cover = (T["Patient"].select("PatientID", "ProviderID")
             .join(T["InsuranceProvider"].select("ProviderID", "CoveragePercent"),
                   "ProviderID", "left")
             .select("PatientID", F.lit(True).alias("_has_patient"),
                     F.coalesce(F.col("CoveragePercent"),
                                F.lit(UNINSURED_COVERAGE).cast(RATE)).alias("_rate")))

    x = appt.join(totals, "AppointmentID", "left")
    if existing is not None:
        prev_cols = [c for c in ("AmountPaid", "PaymentMethod", "BillingID") if c in existing.columns]
        prev = existing.select("AppointmentID",
                               *[F.col(c).alias(f"_prev_{c}") for c in prev_cols],
                               F.lit(True).alias("_has_prev"))
        x = x.join(prev, "AppointmentID", "left")
    else:
        x = x.select("*", F.lit(None).cast(MONEY).alias("_prev_AmountPaid"),
                     F.lit(None).cast("boolean").alias("_has_prev"))
    if keys is not None:
        # Keyed run: only the patients of these appointments are joined, so a
        # small key set never shuffles the whole Patient table.
        cover = cover.join(x.select("PatientID").distinct(), "PatientID", "left_semi")
    x = x.join(cover, "PatientID", "left")
    if keys is not None:
        # keys that name no appointment at all (checked against the already
        # key-filtered appointments, not the whole table)
        missing = (keys.join(appt.select("AppointmentID"), "AppointmentID", "left_anti")
                   .select("AppointmentID", F.lit(True).alias("_unknown")))
        x = x.unionByName(missing, allowMissingColumns=True)
    else:
        x = x.withColumn("_unknown", F.lit(None).cast("boolean"))

    # a total beyond the column's range rejects this bill only
    too_large = F.col("_sum").isNotNull() & F.col("_sum").try_cast(MONEY).isNull()
    total = F.coalesce(F.col("_sum"), F.lit(0)).try_cast(MONEY)
    coverage = F.round(total * F.col("_rate"), 2).cast(MONEY)
    owed = (total - coverage).cast(MONEY)
    # v_existing_paid: COALESCE(AmountPaid, 0) when a bill exists, else NULL
    paid = F.when(F.col("_has_prev"), F.coalesce(F.col("_prev_AmountPaid"),
                                                 F.lit(0).cast(MONEY)))
    reason = (F.when(F.col("_unknown"), F.lit("unknown appointment"))
               .when(F.col("_has_patient").isNull(), F.lit("no patient"))
               .when(F.col("AppointmentDate").isNull(), F.lit("no billing date"))
               .when(too_large, F.lit("total out of range")))
    out = x.select(
        "AppointmentID", "PatientID", total.alias("TotalCost"), coverage.alias("InsuranceCoverage"),
        owed.alias("AmountOwed"), paid.alias("_paid"),
        F.col("Status").alias("_appt_status"), F.col("AppointmentDate").alias("BillingDate"),
        reason.alias("RejectReason"),
        *([F.col("_prev_PaymentMethod").alias("_prev_method")]
          if existing is not None and "PaymentMethod" in existing.columns else []),
        *([F.col("_prev_BillingID").alias("_prev_id")]
          if existing is not None and "BillingID" in existing.columns else []))
    out = out.withColumn("PaymentStatus",
                         bill_status(F.col("_appt_status"), F.col("AmountOwed"), F.col("_paid"), ci))
    return out


def derive_billing(T: dict[str, DataFrame], existing: DataFrame | None = None,
                   keys: DataFrame | None = None, ci: bool = False) -> DataFrame:
    """B1: one bill per appointment (all, or those in ``keys``).

    ``existing`` holds earlier bills (AppointmentID, AmountPaid[, PaymentMethod,
    BillingID]); their payment drives rule 6. Output follows the BillingRecord
    layout; BillingID is the earlier bill's id, else the AppointmentID.
    Rows that would break NOT NULL are left out (see ``billing_rejects``).
    """
    d = _derive(T, existing, keys, ci).filter(F.col("RejectReason").isNull())
    bid = F.coalesce(F.col("_prev_id"), F.col("AppointmentID")) if "_prev_id" in d.columns \
        else F.col("AppointmentID")
    method = F.col("_prev_method") if "_prev_method" in d.columns else F.lit(None).cast("string")
    return d.select(
        bid.alias("BillingID"), "PatientID", "AppointmentID", "TotalCost", "InsuranceCoverage",
        "AmountOwed", F.coalesce(F.col("_paid"), F.lit(0).cast(MONEY)).alias("AmountPaid"),
        "PaymentStatus", method.alias("PaymentMethod"), "BillingDate",
        F.lit(None).cast("timestamp").alias("UpdatedAt"))


def billing_rejects(T: dict[str, DataFrame], keys: DataFrame | None = None) -> DataFrame:
    """Appointments whose bill cannot be written: (AppointmentID, RejectReason)."""
    return (_derive(T, None, keys).filter(F.col("RejectReason").isNotNull())
            .select("AppointmentID", "RejectReason"))


def merge_billing(billing: DataFrame, derived: DataFrame, now: Column | None = None,
                  id_source: DataFrame | None = None, new_id: Column | None = None) -> DataFrame:
    """B2: upsert derived bills into ``billing`` keyed by AppointmentID.

    On a match only TotalCost, InsuranceCoverage, AmountOwed, PaymentStatus and
    BillingDate change; PatientID, AmountPaid, PaymentMethod stay. New bills
    start with AmountPaid 0 and get BillingIDs after the current maximum.
    UpdatedAt moves only on rows whose values changed. ``id_source`` is the
    table whose maximum BillingID new ids follow (default: ``billing``); ``new_id``
    gives the ids of new bills instead, as an expression on the bill's columns.

    Plan: one full outer join, materialized once in the checkpoint folder;
    the rows that need an id are numbered from that copy, so the derivation
    upstream runs once.
    """
    now = now if now is not None else F.current_timestamp()
    upd = ["TotalCost", "InsuranceCoverage", "AmountOwed", "PaymentStatus", "BillingDate"]
    src = derived.select("AppointmentID", F.col("PatientID").alias("_n_PatientID"),
                         *[F.col(c).alias(f"_n_{c}") for c in upd],
                         F.lit(True).alias("_in_src"))
    tgt = billing.select(*BILL_COLUMNS, F.lit(True).alias("_in_tgt"))
    j = tgt.join(src, "AppointmentID", "full_outer")
    in_src, in_tgt = F.col("_in_src").isNotNull(), F.col("_in_tgt").isNotNull()
    changed = F.lit(False)
    for c in upd:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_n_{c}"))
    cols = []
    for c in BILL_COLUMNS:
        if c in upd:
            cols.append(F.when(in_src, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        elif c == "PatientID":
            cols.append(F.when(in_tgt, F.col(c)).otherwise(F.col("_n_PatientID")).alias(c))
        elif c == "BillingID" and new_id is not None:
            cols.append(F.when(in_tgt, F.col(c)).otherwise(new_id).cast(billing.schema[c].dataType).alias(c))
        elif c == "AmountPaid":
            cols.append(F.when(in_tgt, F.col(c)).otherwise(F.lit(0).cast(MONEY)).alias(c))
        elif c == "UpdatedAt":
            cols.append(F.when(~in_tgt | changed, now).otherwise(F.col(c))
                        .cast("timestamp").alias(c))
        else:
            cols.append(F.col(c))
    if new_id is not None:
        return j.select(*cols)
    merged = cut_lineage(j.select(*cols, in_tgt.alias("_old")))
    keep = merged.filter(F.col("_old")).drop("_old")
    new = merged.filter(~F.col("_old")).drop("_old")
    if new.isEmpty():  # a scan of the stored merge result, stops at the first new bill
        return keep
    numbered = number_new_rows(new, id_source if id_source is not None else billing, "BillingID",
                               order=["AppointmentID"])
    return keep.unionByName(numbered)


def refresh_billing(T: dict[str, DataFrame], changed_treatments: DataFrame,
                    now: Column | None = None) -> DataFrame:
    """Recompute bills only for appointments touched by ``changed_treatments``.

    ``T['Treatment']`` must already hold the new treatment rows (inserted or
    deleted); the changes only name the affected appointments. The key set
    filters every big table (semi-joins, broadcast when Spark's size check
    allows), the merge runs on the touched bills only, and the result is the
    untouched bills plus the re-derived ones.
    """
    keys = changed_treatments.select("AppointmentID").distinct()
    billing = T["BillingRecord"]
    touched = billing.join(keys, "AppointmentID", "left_semi")
    derived = derive_billing(T, existing=touched, keys=keys)
    fresh = merge_billing(touched, derived, now, id_source=billing)
    return billing.join(keys, "AppointmentID", "left_anti").unionByName(fresh)


def regenerate_billing(T: dict[str, DataFrame], appointment_ids: DataFrame,
                       now: Column | None = None) -> DataFrame:
    """B1 + B2 for the given appointments (the repair for bills left stale):
    the keyed refresh with an explicit key set (a column AppointmentID)."""
    return refresh_billing(T, appointment_ids.select("AppointmentID"), now)


# Reject reasons of payments (the library's own codes).
NO_AMOUNT, AMOUNT_RANGE, TOTAL_RANGE, NO_BILL = "no amount", "amount out of range", "total out of range", "unknown bill"


def payment_fault(amount: Column) -> Column:
    """Why a payment can't be counted whatever its bill (NULL: it can)."""
    return F.when(amount.isNull(), F.lit(NO_AMOUNT)).when(amount.try_cast(MONEY).isNull(), F.lit(AMOUNT_RANGE))


def _added(ledger: DataFrame, key: str, *more: Column) -> DataFrame:
    """Each bill's countable payments: (key, _add, ...)."""
    sound = ledger.filter(payment_fault(F.col("Amount")).isNull())
    return sound.groupBy(key).agg(money_sum(F.col("Amount").try_cast(MONEY)).alias("_add"), *more)


def _new_paid() -> Column:
    return (F.coalesce(F.col("AmountPaid"), F.lit(0).cast(MONEY)) + F.col("_add")).try_cast(MONEY)


def apply_payments(billing: DataFrame, ledger: DataFrame, key: str = "BillingID",
                   seq: str | None = None) -> DataFrame:
    """Add each bill's payments to AmountPaid and re-derive its status.

    ``ledger``: (key, Amount[, PaymentMethod][, seq]). The new status ignores
    any status sent with a payment: Paid if paid >= owed, Partial if paid > 0,
    else Unpaid, also over Canceled. The method is the last non-empty one by
    ``seq`` (a NULL seq comes first; ties, and ledgers without ``seq``: the
    method that sorts last), else the bill's own. Bills without payments are
    untouched. A payment without an amount or beyond the column's range is left
    out; a bill whose new total would be beyond it stays as it was, with all the
    others going on (``payment_rejects`` lists what was left out).
    """
    more = []
    if "PaymentMethod" in ledger.columns:
        m = F.when(F.length(F.coalesce(F.col("PaymentMethod"), F.lit(""))) > 0,
                   F.col("PaymentMethod"))
        more.append(F.max_by(m, F.when(m.isNotNull(), F.struct(F.col(seq), m) if seq else m)).alias("_method"))
    per_bill = _added(ledger, key, *more)
    j = billing.join(per_bill, key, "left").withColumn("_paid", _new_paid())
    hit, new_paid = F.col("_paid").isNotNull(), F.col("_paid")
    status = (F.when(new_paid >= F.col("AmountOwed"), F.lit("Paid"))
               .when(new_paid > 0, F.lit("Partial")).otherwise(F.lit("Unpaid")))
    method = F.coalesce(F.col("_method"), F.col("PaymentMethod")) \
        if "_method" in per_bill.columns else F.col("PaymentMethod")
    new = {"AmountPaid": new_paid, "PaymentStatus": status, "PaymentMethod": method}
    return j.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in billing.columns])


def payment_rejects(billing: DataFrame, ledger: DataFrame, key: str = "BillingID") -> DataFrame:
    """The payments that ``apply_payments`` leaves out, each with all its columns and a reason:
    no amount, an amount or (for all sound payments of the bill) a new total beyond
    the column's range, or a bill that does not exist."""
    over = (billing.join(_added(ledger, key), key).filter(_new_paid().isNull()).select(key, F.lit(True).alias("_over")))
    known = billing.select(key, F.lit(True).alias("_known"))
    j = ledger.join(known, key, "left").join(over, key, "left")
    reason = F.coalesce(payment_fault(F.col("Amount")), F.when(F.col("_known").isNull(), F.lit(NO_BILL)), F.when(F.col("_over"), F.lit(TOTAL_RANGE)))
    return j.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(*ledger.columns, "reason")


def unmatched_changes(billing: DataFrame, changes: DataFrame, key: str = "BillingID") -> DataFrame:
    """Payments or status changes naming a bill that does not exist (the
    service answers those with 'not found'); ``apply_payments`` and
    ``set_status`` leave them out, this lists them."""
    return changes.join(billing.select(key), key, "left_anti")


def set_status(billing: DataFrame, changes: DataFrame, key: str = "BillingID",
               seq: str | None = None) -> DataFrame:
    """Status set by hand (no amount): taken as given, unvalidated.

    ``changes``: (key, PaymentStatus[, PaymentMethod][, seq]); the latest change
    per bill wins; a NULL status keeps the old one, an empty method keeps the old.
    """
    cols = ["PaymentStatus"] + (["PaymentMethod"] if "PaymentMethod" in changes.columns else [])
    latest = latest_per_key(changes, key, cols, seq).withColumn("_hit", F.lit(True))
    j = billing.join(latest.select(key, "_hit", *[F.col(c).alias(f"_n_{c}") for c in cols]),
                     key, "left")
    out = []
    for c in billing.columns:
        if c == "PaymentStatus":
            out.append(F.coalesce(F.col("_n_PaymentStatus"), F.col(c)).alias(c))
        elif c == "PaymentMethod" and "PaymentMethod" in cols:
            out.append(F.coalesce(F.nullif(F.col("_n_PaymentMethod"), F.lit("")),
                                  F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def approve_requests(appointments: DataFrame, keys: DataFrame | None = None, ci: bool = False) -> DataFrame:
    """Requested appointments (all, or those in ``keys``) become Scheduled."""
    cond = text_key(F.col("Status"), ci) == "Requested"
    if keys is not None:
        k = keys.select("AppointmentID").distinct().withColumn("_pick", F.lit(True))
        appointments = appointments.join(k, "AppointmentID", "left")
        cond = cond & F.col("_pick").isNotNull()
        cols = [c for c in appointments.columns if c != "_pick"]
    else:
        cols = appointments.columns
    return appointments.select(*[F.when(cond, F.lit("Scheduled")).otherwise(F.col(c)).alias(c)
                                 if c == "Status" else F.col(c) for c in cols])
