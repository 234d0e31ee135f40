"""Scans and sinks of clinic tables (S1, S5, S6) and the test-data mapping."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from wardbook.schema import MONEY, RATE, SCHEMAS
from wardbook.session import scratch_path

Tables = dict[str, DataFrame]


# Decimal digits that a whole-number type may need.
_DIGITS = {T.ByteType(): 3, T.ShortType(): 5, T.IntegerType(): 10, T.LongType(): 20}


def widest(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type that holds all values of both and that the Parquet reader gives for
    either; None where there is none (text and numbers, BIGINT and DOUBLE)."""
    if a == b:
        return a
    if {a, b} == {T.DateType(), T.TimestampNTZType()}:
        return T.TimestampNTZType()
    if a in _DIGITS and b in _DIGITS:
        return max(a, b, key=_DIGITS.__getitem__)
    floats = (T.FloatType(), T.DoubleType())
    if a in floats or b in floats:
        return T.DoubleType() if all(x in floats or _DIGITS.get(x, 99) <= 10 for x in (a, b)) else None
    parts = [(x.precision - x.scale, x.scale) if isinstance(x, T.DecimalType) else (_DIGITS[x], 0) for x in (a, b)
             if isinstance(x, T.DecimalType) or x in _DIGITS]
    if len(parts) == 2:
        whole, scale = (max(n) for n in zip(*parts))
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else None
    return None


def union_layout(a: T.StructType, b: T.StructType) -> T.StructType:
    """All columns of both (names without regard to case, the first spelling stays), each
    of the wider type. Two types that no one type holds are an error that names the column."""
    fields = {f.name.lower(): f for f in a.fields}
    for f in b.fields:
        have = fields.get(f.name.lower())
        kind = widest(have.dataType, f.dataType) if have else f.dataType
        if kind is None:
            raise ValueError(f"column {f.name} is {have.dataType.simpleString()} in some files and {f.dataType.simpleString()} in others")
        fields[f.name.lower()] = T.StructField(have.name if have else f.name, kind)
    return T.StructType(list(fields.values()))


def _merged(spark: SparkSession, paths: list[str], fmt: str) -> T.StructType | None:
    """Spark's own union of the files' columns (a job over the footers); None if types differ."""
    try:
        return spark.read.format(fmt).option("mergeSchema", "true").load(paths).schema
    except (Py4JJavaError, PySparkException) as e:
        if "CANNOT_MERGE" in str(e):
            return None
        raise


def stored_layout(spark: SparkSession, path: str, fmt: str = "parquet") -> T.StructType | None:
    """The columns and types that all files under ``path`` together have; None if Spark's
    own union of them does. Only where a column's type differs between files are the files
    parted, by halves in the order of their names (files of one write stand together), until
    each part has one type a column; the parts' types are then widened."""
    if _merged(spark, [path], fmt) is not None:
        return None

    def layout(files: list[str]) -> T.StructType:
        found = _merged(spark, files, fmt)
        if found is not None:
            return found
        half = len(files) // 2
        return union_layout(layout(files[:half]), layout(files[half:]))

    # a name's last dash-free part tells the task, the part before it the write
    return layout(sorted(spark.read.format(fmt).load(path).inputFiles(), key=lambda f: (f.rsplit("/", 1)[0], f.rsplit("/", 1)[-1].split("-", 2)[-1])))


def load_tables(spark: SparkSession, directory: str, names: list[str] | None = None,
                fmt: str = "parquet", schemas: dict[str, T.StructType] | None = None) -> Tables:
    """Read each clinic table from ``directory/<Table>``.

    A folder may hold files of several layouts, as tables have that grew by
    migrations: a column of any file is a column of the table (NULL for rows of files
    without it), and a type that differs between files is the widest of them (INT and
    BIGINT, decimals, FLOAT and DOUBLE; no value is lost, whatever the order of the
    files). Otherwise the files' own types are used (key widths may differ between
    stores). Declared columns that no file has come back as typed NULLs (S5).
    ``schemas`` gives tables' layouts instead, so that no footer is read beforehand.
    """
    out: Tables = {}
    for name in names or list(SCHEMAS):
        path = f"{directory.rstrip('/')}/{name}"
        reader = spark.read.format(fmt)
        if schemas and name in schemas:
            reader = reader.schema(schemas[name])
        elif fmt in ("parquet", "orc"):
            layout = stored_layout(spark, path, fmt)
            reader = reader.schema(layout) if layout else reader.option("mergeSchema", "true")
        out[name] = ensure_columns(reader.load(path), SCHEMAS[name])
    return out


def ensure_columns(df: DataFrame, schema: T.StructType | list[tuple[str, T.DataType]]) -> DataFrame:
    """Add every absent column as a typed NULL; present columns are left alone."""
    fields = schema.fields if isinstance(schema, T.StructType) else [
        T.StructField(n, t) for n, t in schema]
    have = {c.lower() for c in df.columns}
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in fields if f.name.lower() not in have]
    return df.select("*", *missing) if missing else df


def save_tables(tables: Tables, directory: str | None = None, spark: SparkSession | None = None,
                fmt: str = "parquet",
                partition_by: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Write a new version of each table into a fresh folder; return the paths.

    A folder that exists is refused, so a version that is still being read (also
    by the plan that is written here) is never destroyed; save each version
    under a directory of its own. Writing is the lineage cut: callers re-read
    the returned paths.
    ``partition_by`` names folder-partition columns per table (for example
    AppointmentDate), so later filters on them prune whole folders.
    """
    paths = {}
    for name, df in tables.items():
        if directory is None:
            path = scratch_path(spark or df.sparkSession, f"table-{name}")
        else:
            path = f"{directory.rstrip('/')}/{name}"
        w = df.write.mode("errorifexists").format(fmt)
        if partition_by and partition_by.get(name):
            w = w.partitionBy(*partition_by[name])
        w.save(path)
        paths[name] = path
    return paths


def with_month(df: DataFrame, col: str = "AppointmentDate", month: str = "AppointmentMonth") -> DataFrame:
    """The first day of ``col``'s month as a further column, for ``save_tables(partition_by=...)``
    and ``listings.by_days``: folders by month stay few and large where those by date don't."""
    return df.withColumn(month, F.trunc(col, "month"))


def max_key(spark: SparkSession, path: str, col: str, writes: int = 64) -> int:
    """A9 over stored Parquet files: the largest ``col`` (0 without any), from the files' footers.

    The aggregate is pushed into Spark's V2 reader, which reads no rows then. That reader
    takes a column by its place, so files are read together only where one write
    made them (their names say so); other layouts are plans of their own. It runs in a session
    of its own, so the caller's settings stay. Files without statistics, and tables of more than
    ``writes`` writes, are scanned instead, that column only.
    """
    parts: dict[str, list[str]] = {}
    for f in map(unquote, spark.read.parquet(path).inputFiles()):
        made = re.fullmatch(r"part-\d+-([0-9a-f-]{36})\b.*", f.rsplit("/", 1)[-1])
        parts.setdefault(made[1] if made else f, []).append(f)
    if len(parts) <= writes:
        own = spark.newSession()
        own.conf.set("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text")
        own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
        try:
            found = [m for m in (max_plan(own.read.parquet(*files), col) for files in parts.values()) if m is not None]
            return reduce(DataFrame.union, found).agg(F.max("key")).first()[0] or 0 if found else 0
        except (Py4JJavaError, PySparkException) as e:
            if "aggregatePushdown" not in str(e):  # Spark's advice where a file has no statistics
                raise
    layout = stored_layout(spark, path)
    reader = spark.read.schema(layout) if layout else spark.read.option("mergeSchema", "true")
    return reader.parquet(path).agg(F.max(col)).first()[0] or 0


def max_plan(df: DataFrame, col: str) -> DataFrame | None:
    """The largest ``col`` of a scan, None where it has no such column."""
    return df.agg(F.max(col).cast("long").alias("key")) if col.lower() in map(str.lower, df.columns) else None


# The column by which a table's rows meet others most, for ``save_bucketed``.
BUCKET_KEYS = {"Appointment": "AppointmentID", "Treatment": "AppointmentID", "Diagnosis": "AppointmentID", "BillingRecord": "AppointmentID",
               "Patient": "PatientID", "Doctor": "DoctorID", "Nurse": "NurseID"}


def save_bucketed(tables: Tables, database: str, buckets: int, keys: dict[str, str] | None = None) -> list[str]:
    """S6 into the session's catalog: each table bucketed and sorted by its join key
    (``BUCKET_KEYS``, or ``keys``) under ``database``; returns the full names.

    Joins and folds on the key of tables with equally many buckets then need no shuffle (B1 and B2
    by AppointmentID). Rows are dealt out by the key first, so a bucket is one file
    whatever the number of tasks. An existing table is refused; a new version is a
    database of its own. Tables without a key are stored plain.
    """
    spark = next(iter(tables.values())).sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    out = []
    for name, df in tables.items():
        key = {**BUCKET_KEYS, **(keys or {})}.get(name)
        w = df
        if key and key in df.columns:
            w = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
        else:
            w = df.write
        w.format("parquet").mode("errorifexists").saveAsTable(f"`{database}`.`{name}`")
        out.append(f"{database}.{name}")
    return out


def load_bucketed(spark: SparkSession, database: str, names: list[str] | None = None) -> Tables:
    """S1 from the session's catalog: the clinic tables under ``database``, with their buckets."""
    have = {r["tableName"].lower() for r in spark.sql(f"SHOW TABLES IN `{database}`").collect()}
    return {n: ensure_columns(spark.table(f"`{database}`.`{n}`"), SCHEMAS[n]) for n in (names or SCHEMAS) if names or n.lower() in have}


def register_views(tables: Tables, prefix: str = "") -> list[str]:
    """Expose the clinic tables as temporary views (``Patient``,
    ``BillingRecord``, ...) so plain ``spark.sql`` can query them; returns
    the view names."""
    names = []
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names


# ---------------------------------------------------------------------------
# Test-data mapping: the driver's TPC-H-like tables projected as clinic tables.
# ---------------------------------------------------------------------------

def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _status_from_order(status: Column, priority: Column) -> Column:
    return (F.when((status == "P") & (priority == "1-URGENT"), "Canceled")
             .when(status == "F", "Completed")
             .when(status == "O", "Scheduled")
             .when(status == "P", "Requested"))


def from_testdata(spark: SparkSession, sf_dir: str, with_billing: bool = True) -> Tables:
    """Clinic tables projected from the driver's parquet tables.

    Department <- region, InsuranceProvider <- nation, Patient <- customer,
    Doctor and Nurse <- supplier, Appointment <- orders, Diagnosis <- part,
    Treatment <- lineitem, Payments <- purchase events, BillingRecord <- the
    billing derivation over those with the summed payments as amounts paid.
    Nothing is collected: each table is a lazy projection of the scans.
    """
    region = _read(spark, sf_dir, "region")
    nation = _read(spark, sf_dir, "nation")
    customer = _read(spark, sf_dir, "customer")
    supplier = _read(spark, sf_dir, "supplier")
    orders = _read(spark, sf_dir, "orders")
    part = _read(spark, sf_dir, "part")
    lineitem = _read(spark, sf_dir, "lineitem")
    events = _read(spark, sf_dir, "events")

    t: Tables = {}
    t["Department"] = region.select(
        F.col("r_regionkey").alias("DepartmentID"), F.col("r_name").alias("DepartmentName"),
        F.lit(None).cast("string").alias("Location"), F.lit(None).cast("string").alias("Phone"))
    t["InsuranceProvider"] = nation.select(
        F.col("n_nationkey").alias("ProviderID"), F.col("n_name").alias("ProviderName"),
        F.lit(None).cast("string").alias("ContactPhone"),
        F.lit(None).cast("string").alias("ContactEmail"),
        F.lit(None).cast("string").alias("Address"),
        ((F.lit(70) + F.col("n_nationkey") % 16) * F.lit(0.01).cast("decimal(3,2)"))
        .cast(RATE).alias("CoveragePercent"))
    t["Patient"] = customer.select(
        F.col("c_custkey").alias("PatientID"), F.col("c_name").alias("FirstName"),
        F.col("c_mktsegment").alias("LastName"), F.lit(None).cast("date").alias("DOB"),
        F.lit(None).cast("string").alias("Gender"), F.lit(None).cast("string").alias("Phone"),
        F.lit(None).cast("string").alias("Address"),
        F.when(F.col("c_custkey") % 10 == 0, F.lit(None))
         .otherwise(F.col("c_nationkey").cast("bigint")).alias("ProviderID"))
    t["Doctor"] = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey, "left").select(
        F.col("s_suppkey").alias("DoctorID"), F.col("s_name").alias("FirstName"),
        F.lit("").alias("LastName"), F.col("n_name").alias("Specialty"),
        F.lit(None).cast("string").alias("Phone"),
        F.when(F.col("s_suppkey") % 10 == 9, F.lit(None))
         .otherwise(F.col("n_regionkey").cast("bigint")).alias("DepartmentID"))
    t["Nurse"] = supplier.select(
        F.col("s_suppkey").alias("NurseID"), F.col("s_name").alias("FirstName"),
        F.lit("").alias("LastName"), F.lit("RN").alias("Certification"),
        F.lit(None).cast("string").alias("Phone"),
        (F.col("s_suppkey") % 4).alias("DepartmentID"))
    n_supp = supplier.select(F.count(F.lit(1))).scalar()
    t["Appointment"] = orders.select(
        F.col("o_orderkey").alias("AppointmentID"), F.col("o_custkey").alias("PatientID"),
        F.when(F.col("o_orderkey") % 50 == 0, F.lit(None))
         .otherwise(F.col("o_orderkey") % n_supp).alias("DoctorID"),
        F.when(F.col("o_orderkey") % 40 == 0, F.lit(None))
         .otherwise(F.col("o_custkey") % n_supp).alias("NurseID"),
        F.col("o_orderdate").cast("date").alias("AppointmentDate"),
        (F.lit(28800) + (F.col("o_orderkey") % 20) * 1800).cast("int").alias("AppointmentTime"),
        _status_from_order(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("Status"),
        F.col("o_orderpriority").alias("Purpose"))
    t["Diagnosis"] = part.select(
        F.col("p_partkey").alias("DiagnosisID"), F.lit(None).cast("bigint").alias("AppointmentID"),
        F.col("p_name").alias("DiagnosisName"), F.col("p_type").alias("Notes"),
        F.lit(None).cast("date").alias("DiagnosisDate"))
    # (l_orderkey, l_linenumber) is not unique in the test data, so TreatmentID
    # is a non-null label here, not a key.
    t["Treatment"] = lineitem.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("TreatmentID"),
        F.col("l_partkey").alias("DiagnosisID"), F.col("l_orderkey").alias("AppointmentID"),
        F.col("l_returnflag").alias("TreatmentName"), F.lit(None).cast("string").alias("Description"),
        F.col("l_extendedprice").cast(MONEY).alias("TreatmentCost"))
    t["Payments"] = payments_from_events(events)
    t["HospitalAdmin"] = spark.createDataFrame([], SCHEMAS["HospitalAdmin"])
    if with_billing:
        from wardbook.operators.billing import derive_billing, paid_per_appointment
        existing = paid_per_appointment(t["Payments"])
        t["BillingRecord"] = derive_billing(t, existing=existing)
    return t


def payments_from_events(events: DataFrame) -> DataFrame:
    """The payment ledger: one row per purchase event (event_id, AppointmentID, Amount, ts)."""
    return (events.filter(F.col("event_type") == "purchase")
            .select(F.col("event_id"), F.col("user_id").alias("AppointmentID"),
                    (F.col("value") * 100).cast("decimal(12,2)").alias("Amount"),
                    F.col("ts")))
