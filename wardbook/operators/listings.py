"""Listings: projections, filters, joins, lookups and sorts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardbook.functions.scalars import DASH, hhmm, text_key
from wardbook.session import cut_lineage

Tables = dict[str, DataFrame]

#: characters of searches up to which ``search_many`` sends them to every task; more are shuffled
BROADCAST_SEARCHES = 1 << 21


# ---------------------------------------------------------------------------
# Projections and filters
# ---------------------------------------------------------------------------

def public_users(users: DataFrame, secret: str | Iterable[str] = "password_hash") -> DataFrame:
    """Every column except the secret one(s)."""
    drop = {secret} if isinstance(secret, str) else set(secret)
    return users.select(*[c for c in users.columns if c not in drop])


def with_balance(billing: DataFrame) -> DataFrame:
    """BalanceDue = AmountOwed - AmountPaid."""
    return billing.withColumn("BalanceDue", F.col("AmountOwed") - F.col("AmountPaid"))


def by_key(df: DataFrame, col: str, keys) -> DataFrame:
    """Rows whose ``col`` equals a key. ``keys`` may be a value, a list,
    or a DataFrame of keys (then a semi-join, for batches of lookups)."""
    if isinstance(keys, DataFrame):
        k = keys.select(F.col(keys.columns[0]).alias(col)) if col not in keys.columns \
            else keys.select(col)
        return df.join(k, col, "left_semi")
    if isinstance(keys, (list, tuple, set)):
        return df.filter(F.col(col).isin(list(keys)))
    return df.filter(F.col(col) == F.lit(keys))


def optional_filter(df: DataFrame, col: str, value=None) -> DataFrame:
    """P5: apply ``col = value`` only when a value is given."""
    return df if value is None or value == "" else by_key(df, col, value)


def empty_like(df: DataFrame) -> DataFrame:
    """No rows, same schema (Catalyst folds it to an empty relation)."""
    return df.filter(F.lit(False))


def cancellable_appointments(appts: DataFrame, ci: bool = False) -> DataFrame:
    """Appointments a patient may still cancel."""
    s = text_key(F.col("Status"), ci)
    return appts.filter((s == "Requested") | (s == "Scheduled"))


def payable_bills(billing: DataFrame, ci: bool = False) -> DataFrame:
    """Bills not Canceled with a positive balance."""
    s = text_key(F.col("PaymentStatus"), ci)
    return (with_balance(billing)
            .filter((s.isNull() | (s != "Canceled"))
                    & (F.col("BalanceDue") > 0)))


def row_text(cols: list[str], sep: str = "") -> Column:
    """The row's text as a table shows it: cells joined by ``sep``, NULL as a dash."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit(DASH)) for c in cols])


def search_rows(df: DataFrame, q: str, cols: list[str] | None = None, sep: str = "") -> DataFrame:
    """P10: case-insensitive substring search over the row's text. Cells join
    with no separator by default, so a match may span two cells."""
    cols = cols or df.columns
    return df.filter(F.lower(row_text(cols, sep)).contains(q.lower()))


def _pieces(text: Column) -> Column:
    """The distinct runs of one, two and three characters of a text, and the empty run."""
    chars = F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))
    # each character with those behind it; NULL where the text ends before
    two, three = (F.slice(chars, F.lit(n), F.size(chars)) for n in (2, 3))
    pairs = F.zip_with(chars, two, lambda a, b: F.concat(a, b))
    runs = F.concat(F.array(F.lit("")), chars, pairs, F.zip_with(pairs, three, lambda a, b: F.concat(a, b)))
    return F.array_distinct(F.array_compact(runs))


def search_many(df: DataFrame, searches: DataFrame, term: str, cols: list[str] | None = None,
                sep: str = "", name: str = "search") -> DataFrame:
    """P10 for a table of searches: each distinct text in ``term`` (as ``name``) with every row
    that ``search_rows`` finds for it, as an equi-join.

    A search is looked up by one run of its characters: three of them (all of a shorter
    search), and of those the run that the fewest rows have. Rows meet their searches on
    that run, once each, and the whole text is compared then. The runs are counted by a
    partial aggregate over those that some search has. The empty search finds every row,
    as in ``search_rows``; a NULL search finds none; repeated rows are all found.

    The searches with their runs are stored, so that their size is known: they are
    broadcast if they are few (``BROADCAST_SEARCHES``), else both sides are shuffled by run.
    The rows are never broadcast: each stands once for every run of its text, which Spark's
    estimate of their size leaves out.
    """
    text = F.lower(row_text(cols or df.columns, sep))
    asked = (searches.select(F.col(term).cast("string").alias("_term")).where(F.col("_term").isNotNull()).distinct()
             .withColumn("_q", F.lower("_term")))
    size = F.least(F.lit(3), F.char_length("_q"))
    runs = cut_lineage(asked.select("*", F.explode(F.filter(_pieces(F.col("_q")), lambda x: F.char_length(x) == size)).alias("_run")))
    counts = (df.select(F.explode(_pieces(text)).alias("_run"))
              .join(runs.select("_run").distinct(), "_run", "left_semi").groupBy("_run").agg(F.count("*").alias("_n")))
    rarest = (runs.join(counts, "_run", "left").groupBy("_term", "_q")
              .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_run").alias("run")))["run"].alias("_run")))
    rarest = cut_lineage(rarest)
    # some 100 bytes a search besides its text, which stands there twice
    few = (rarest.agg(F.sum(F.lit(50) + F.char_length("_q"))).first()[0] or 0) <= BROADCAST_SEARCHES
    rarest = F.broadcast(rarest) if few else rarest.hint("merge")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), text.alias("_text"))
    found = (rows.select("*", F.explode(_pieces(F.col("_text"))).alias("_run")).join(rarest, "_run")
             .where(F.contains("_text", "_q")))
    return found.select(F.col("_term").alias(name), "_row.*")


def by_days(appts: DataFrame, days: DataFrame, col: str = "AppointmentDate", month: str = "AppointmentMonth") -> DataFrame:
    """P4 by date for a table stored in folders by month (``sources.tables.with_month``): rows
    whose ``col`` is one of the dates in the first column of ``days``.

    The join is on month and date, so Spark reads only the folders of the months that the
    dates fall in (dynamic partition pruning, where the dates pass its broadcast size
    check; beyond it the whole table is read and joined). NULL dates find nothing.
    """
    keys = days.select(F.col(f"`{days.columns[0]}`").cast("date").alias(col)).where(F.col(col).isNotNull())
    # Spark prunes by a key set only if a predicate restricts it: this one lets all dates pass
    keys = keys.withColumn(month, F.trunc(col, "month")).where(F.col(month) > F.lit("-9999-01-01").cast("date"))
    return appts.join(keys, [month, col], "left_semi").select(*appts.columns)


# ---------------------------------------------------------------------------
# Joins
# ---------------------------------------------------------------------------

def treatments_with_diagnosis(T: Tables, appointment_id=None) -> DataFrame:
    """J1 (+P5): treatments with their diagnosis name, optionally of one appointment."""
    t = optional_filter(T["Treatment"], "AppointmentID", appointment_id)
    d = T["Diagnosis"].select("DiagnosisID", "DiagnosisName")
    return t.join(d, "DiagnosisID", "left").select(*t.columns, "DiagnosisName")


def billing_for_patient(T: Tables, patient_id) -> DataFrame:
    """One patient's bills with the patient's name, newest first."""
    b = by_key(T["BillingRecord"], "PatientID", patient_id)
    p = T["Patient"].select("PatientID", "FirstName", "LastName")
    return (with_balance(b).join(p, "PatientID", "inner")
            .select(*b.columns, "BalanceDue", "FirstName", "LastName")
            .orderBy(F.desc("BillingDate"), F.desc("BillingID")))


def bills_with_patient_names(T: Tables) -> DataFrame:
    """Every bill with its balance and its patient's name (when known), unsorted."""
    b = T["BillingRecord"]
    p = T["Patient"].select("PatientID", "FirstName", "LastName")
    return (with_balance(b).join(p, "PatientID", "left")
            .select(*b.columns, "BalanceDue", "FirstName", "LastName"))


def billing_with_patient(T: Tables) -> DataFrame:
    """Every bill with its patient's name (when known), newest first."""
    return bills_with_patient_names(T).orderBy(F.desc("BillingDate"), F.desc("BillingID"))


def my_patients(scoped_appts: DataFrame, patients: DataFrame) -> DataFrame:
    """Patients that occur in the given (already scoped) appointments."""
    return patients.join(scoped_appts.select("PatientID"), "PatientID", "left_semi")


def _id_label(id_col: Column, falsy_dash: bool) -> Column:
    tag = F.concat(F.lit("#"), F.coalesce(id_col.cast("string"), F.lit("null")))
    if not falsy_dash:
        return tag
    return F.when(id_col.isNull() | (id_col == 0), F.lit(DASH)).otherwise(tag)


def appointments_with_names(T: Tables, appts: DataFrame | None = None) -> DataFrame:
    """Appointment rows with patient, doctor and nurse display names and
    HH:mm time. Unknown ids print as '#id' (doctor and nurse: a dash when the
    id is empty or 0)."""
    a = appts if appts is not None else T["Appointment"]
    p = T["Patient"].select(F.col("PatientID"),
                            F.concat(F.col("FirstName"), F.lit(" "), F.col("LastName")).alias("_p"))
    d = T["Doctor"].select(F.col("DoctorID"), F.concat(F.lit("Dr. "), F.col("LastName")).alias("_d"))
    n = T["Nurse"].select(F.col("NurseID"),
                          F.concat(F.col("FirstName"), F.lit(" "), F.col("LastName")).alias("_n"))
    j = a.join(p, "PatientID", "left").join(d, "DoctorID", "left").join(n, "NurseID", "left")
    return j.select(*a.columns,
                    F.coalesce(F.col("_p"), _id_label(F.col("PatientID"), False)).alias("PatientName"),
                    F.coalesce(F.col("_d"), _id_label(F.col("DoctorID"), True)).alias("DoctorName"),
                    F.coalesce(F.col("_n"), _id_label(F.col("NurseID"), True)).alias("NurseName"),
                    hhmm(F.col("AppointmentTime")).alias("TimeHHMM"))


def patients_with_provider_label(T: Tables) -> DataFrame:
    """Patients with the provider's name, or the raw id when unknown."""
    p = T["Patient"]
    ip = T["InsuranceProvider"].select("ProviderID", "ProviderName")
    return (p.join(ip, "ProviderID", "left")
            .select(*p.columns, F.coalesce(F.col("ProviderName"), F.col("ProviderID").cast("string"))
                    .alias("ProviderLabel")))


def choice_labels(T: Tables) -> DataFrame:
    """the pick-list label of every patient, doctor and nurse:
    (kind, id, label). Doctors show their specialty after a dash when they
    have one; nurses their certification in brackets."""
    full = lambda: F.concat(F.col("FirstName"), F.lit(" "), F.col("LastName"))
    spec = F.col("Specialty")
    p = T["Patient"].select(F.lit("patient").alias("kind"), F.col("PatientID").alias("id"),
                            full().alias("label"))
    d = T["Doctor"].select(F.lit("doctor").alias("kind"), F.col("DoctorID").alias("id"),
                           F.concat(F.lit("Dr. "), full(),
                                    F.when(F.length(F.coalesce(spec, F.lit(""))) > 0,
                                           F.concat(F.lit(" — "), spec)).otherwise(F.lit("")))
                           .alias("label"))
    n = T["Nurse"].select(F.lit("nurse").alias("kind"), F.col("NurseID").alias("id"),
                          F.concat(full(), F.lit(" ("), F.coalesce(F.col("Certification"), F.lit("")),
                                   F.lit(")")).alias("label"))
    return p.unionByName(d).unionByName(n)


def assign_nurse(requests: DataFrame, doctors: DataFrame, nurses: DataFrame) -> DataFrame:
    """A nurse for each request: the lowest NurseID in the doctor's
    department (NULL departments match each other), else the lowest NurseID
    overall, else NULL. An unknown doctor gets the overall fallback.

    The per-department minimum is an aggregate (one row per department), the
    overall minimum a scalar subquery; the request side is never shuffled
    for more than its equi-joins.
    """
    first_per_dept = nurses.groupBy("DepartmentID").agg(F.min("NurseID").alias("_dept_nurse"))
    doc_nurse = (doctors.select("DoctorID", "DepartmentID").alias("d")
                 .join(first_per_dept.alias("f"),
                       F.col("d.DepartmentID").eqNullSafe(F.col("f.DepartmentID")), "left")
                 .select(F.col("d.DoctorID").alias("DoctorID"), "_dept_nurse"))
    overall = nurses.select(F.min("NurseID")).scalar()
    cols = [c for c in requests.columns if c != "NurseID"]
    return (requests.join(doc_nurse, "DoctorID", "left")
            .select(*cols, F.coalesce(F.col("_dept_nurse"), overall).alias("NurseID")))


# ---------------------------------------------------------------------------
# Sorts
# ---------------------------------------------------------------------------

def appointments_sorted(appts: DataFrame) -> DataFrame:
    """O1: newest date first, then latest time; the key breaks ties."""
    return appts.orderBy(F.desc("AppointmentDate"), F.desc("AppointmentTime"),
                         F.desc("AppointmentID"))
