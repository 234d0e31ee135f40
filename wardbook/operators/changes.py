"""Table changes as batch jobs: table + change rows -> new table.

No lakehouse format is assumed, so a MERGE is a join. Every change set is
reduced to one row per key first (a map-side-combined aggregate), so a key
changed a million times in one batch costs one row after the partial step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardbook.schema import DEFAULTS, FOREIGN_KEYS, PRIMARY_KEYS, topological_order
from wardbook.functions.scalars import role_allowed, split_full_name, text_key
from wardbook.session import cut_lineage


# ---------------------------------------------------------------------------
# D1 key assignment
# ---------------------------------------------------------------------------

def assign_ids(df: DataFrame, target: DataFrame | int | None, id_col: str, order: list[str],
               num_partitions: int | None = None) -> DataFrame:
    """Give rows whose ``id_col`` is NULL the keys MAX(target)+1, +2, ...

    Rows that already carry a key keep it. New keys follow ``order``. ``target`` may be the
    largest key itself (``sources.tables.max_key`` takes it from stored files' footers).
    Both halves read ``df``; when it is costly to compute, pass it
    materialized (``session.cut_lineage``), as ``merge_billing`` does.
    """
    need = df.filter(F.col(id_col).isNull())
    keep = df.filter(F.col(id_col).isNotNull())
    return keep.unionByName(number_new_rows(need, target, id_col, order, num_partitions))


def number_new_rows(need: DataFrame, target: DataFrame | int | None, id_col: str, order: list[str],
                    num_partitions: int | None = None) -> DataFrame:
    """Number every row of ``need`` as MAX(target.id_col) + its rank in ``order``.

    ``order`` should end with a unique column, so the rank is well defined
    and range partitioning can split any run of equal leading values.
    Scales without a single-partition window: the rows are range-partitioned
    on ``order`` and sorted inside each partition; each row's partition and
    position are computed there and written once with the rows to the shared
    checkpoint folder (so a lost executor cannot reshuffle them); then the
    per-partition counts (one row per partition) give each partition's offset.
    """
    spark = need.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pid = F.spark_partition_id()
    x = cut_lineage(
        need.repartitionByRange(n, *order).sortWithinPartitions(*order)
        .select("*", pid.alias("_pid"),
                (F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)).alias("_pos")))
    # one row per partition: bounded by n, so the window and broadcast are safe
    offs = (x.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
            .select("_pid", F.coalesce(
                F.sum("_n").over(Window.orderBy("_pid")
                                 .rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0)).alias("_off")))
    if isinstance(target, int):
        base = F.lit(target).cast("long")
    elif target is not None:
        base = target.select(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).scalar()
    else:
        base = F.lit(0).cast("long")
    return (x.join(F.broadcast(offs), "_pid")
            .withColumn(id_col, (base + F.col("_off") + F.col("_pos") + 1)
                        .cast(need.schema[id_col].dataType))
            .select(*need.columns))


# ---------------------------------------------------------------------------
# D2-D6 keyed changes
# ---------------------------------------------------------------------------

def latest_per_key(changes: DataFrame, key: str | list[str], cols: list[str],
                   seq: str | None = None, first: bool = False) -> DataFrame:
    """One row per key: the change with the highest ``seq`` (lowest if ``first``).

    The maximum of a struct is a partial aggregate, so hot keys are folded
    before the shuffle. Ties on ``seq`` go to the largest row (smallest if
    ``first``), as does everything without ``seq``. A NULL ``seq`` is older than
    any other: it wins only where a key has no change with one (with
    ``first``: it comes first).
    """
    keys = [key] if isinstance(key, str) else list(key)
    payload = F.struct(*[F.col(c) for c in cols])
    if seq is None:
        agg = (F.min if first else F.max)(payload)
    else:
        ordered = F.struct(F.col(seq).alias("_seq"), payload.alias("_row"))
        agg = (F.min if first else F.max)(ordered)["_row"]
    return (changes.groupBy(*keys).agg(agg.alias("_v"))
            .select(*keys, *[F.col(f"_v.{c}").alias(c) for c in cols]))


def update_by_key(target: DataFrame, changes: DataFrame, key: str,
                  cols: list[str] | None = None, seq: str | None = None) -> DataFrame:
    """Full replace of ``cols`` for keys present in ``changes``.

    A column absent from the change rows becomes NULL, like an UPDATE that
    sets every column from the request. Keys not in the target are ignored.
    """
    cols = cols or [c for c in target.columns if c != key]
    present = [c for c in cols if c in changes.columns]
    latest = latest_per_key(changes, key, present, seq) if present else \
        changes.select(key).distinct()
    latest = latest.select(key, F.lit(True).alias("_hit"),
                           *[F.col(c).alias(f"_n_{c}") for c in present])
    j = target.join(latest, key, "left")
    out = []
    for c in target.columns:
        if c in cols:
            new = F.col(f"_n_{c}") if c in present else F.lit(None)
            out.append(F.when(F.col("_hit").isNotNull(), new.cast(target.schema[c].dataType))
                       .otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def update_column(target: DataFrame, changes: DataFrame, key: str, col: str,
                  seq: str | None = None) -> DataFrame:
    """D3: set one column for the keys in ``changes``; other columns stay."""
    return update_by_key(target, changes.select(key, col, *([seq] if seq else [])), key,
                         cols=[col], seq=seq)


def delete_by_key(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Drop rows whose key is in ``keys``; unknown keys are a no-op."""
    return target.join(keys.select(key), key, "left_anti")


def merge_upsert(target: DataFrame, source: DataFrame, key: str, update_cols: list[str],
                 seq: str | None = None) -> DataFrame:
    """Insert new keys, and on an existing key update only ``update_cols``.

    Within the batch the latest row per key wins (later rows overwrite earlier).
    """
    cols = [c for c in target.columns if c != key]
    src_cols = [c for c in cols if c in source.columns]
    src = latest_per_key(source, key, src_cols, seq)
    src = src.select(key, F.lit(True).alias("_in_src"),
                     *[F.col(c).alias(f"_n_{c}") for c in src_cols])
    tgt = target.withColumn("_in_tgt", F.lit(True))
    j = tgt.join(src, key, "full_outer")
    out = [F.col(key)]
    for c in cols:
        new = F.col(f"_n_{c}") if c in src_cols else F.lit(None)
        new = new.cast(target.schema[c].dataType)
        if c in update_cols:
            expr = F.when(F.col("_in_src").isNotNull(), new).otherwise(F.col(c))
        else:
            expr = F.when(F.col("_in_tgt").isNotNull(), F.col(c)).otherwise(new)
        out.append(expr.alias(c))
    return j.select(*out)


def insert_ignore(target: DataFrame, source: DataFrame, key: str,
                  seq: str | None = None) -> DataFrame:
    """Add source rows whose key is new; the existing row wins and the
    first row of the batch wins among duplicates."""
    cols = [c for c in target.columns if c != key and c in source.columns]
    first = latest_per_key(source, key, cols, seq, first=True)
    new = first.join(target.select(key), key, "left_anti")
    return target.unionByName(new, allowMissingColumns=True)


# ---------------------------------------------------------------------------
# D7-D8 referential actions
# ---------------------------------------------------------------------------

def cascade_delete(T: dict[str, DataFrame], root: str, keys: DataFrame,
                   materialize: bool = False) -> dict[str, DataFrame]:
    """Delete ``keys`` from ``root`` and apply the foreign-key actions.

    All dropped key sets are computed first from the original tables, walking
    the FK graph parents-first (CASCADE edges); then each table drops its own
    keys (anti-join) and NULLs references to dropped parents (SET NULL edges).
    So a treatment dropped through its appointment is dropped even though its
    diagnosis edge says SET NULL. The result is lazy: reading one table only
    computes the key sets it depends on. When all tables are written out,
    pass ``materialize=True``: each key set is then written to the
    checkpoint folder once, since it feeds its children's key sets and the
    final anti- and SET NULL joins, which would otherwise each recompute the
    chain of semi-joins above it.
    """
    pk = PRIMARY_KEYS
    dropped: dict[str, DataFrame] = {root: keys.select(pk[root]).distinct()}
    for table in topological_order():
        if table not in T or table == root:
            continue
        parts = []
        for fk in FOREIGN_KEYS:
            if fk.child == table and fk.on_delete == "cascade" and fk.parent in dropped:
                parent_keys = dropped[fk.parent].select(F.col(pk[fk.parent]).alias(fk.column))
                parts.append(T[table].join(parent_keys, fk.column, "left_semi").select(pk[table]))
        if parts:
            ks = parts[0]
            for p in parts[1:]:
                ks = ks.unionByName(p)
            dropped[table] = ks.distinct()
        if materialize and table in dropped:
            dropped[table] = cut_lineage(dropped[table])

    out = {}
    for table, df in T.items():
        if table in dropped:
            df = df.join(dropped[table], pk[table], "left_anti")
        for fk in FOREIGN_KEYS:
            if fk.child == table and fk.on_delete == "set_null" and fk.parent in dropped:
                flag = f"_gone_{fk.column}"
                gone = dropped[fk.parent].select(F.col(pk[fk.parent]).alias(fk.column),
                                                 F.lit(True).alias(flag))
                cols = [F.when(F.col(flag).isNotNull(), F.lit(None).cast(df.schema[c].dataType))
                        .otherwise(F.col(c)).alias(c) if c == fk.column else F.col(c)
                        for c in df.columns]
                df = df.join(gone, fk.column, "left").select(*cols)
        out[table] = df
    return out


# Reject reasons of key changes (the library's own codes).
NO_KEY, SEVERAL_KEYS, KEY_EXISTS, KEY_TWICE = "no key", "several new keys", "key exists", "key given twice"


def _judged_moves(T: dict[str, DataFrame], root: str, mapping: DataFrame) -> DataFrame:
    """The distinct rows of a key mapping with ``reason`` (NULL: sound)."""
    m = mapping.select("old_key", "new_key").distinct()
    to = m.groupBy("old_key").agg(F.count("new_key").alias("_to"))
    of = m.groupBy("new_key").agg(F.count("old_key").alias("_of"))
    there = T[root].select(F.col(PRIMARY_KEYS[root]).alias("new_key"), F.lit(True).alias("_there"))
    reason = (F.when(F.col("old_key").isNull() | F.col("new_key").isNull(), F.lit(NO_KEY))
               .when(F.col("_to") > 1, F.lit(SEVERAL_KEYS))
               .when((F.col("new_key") != F.col("old_key")) & F.col("_there"), F.lit(KEY_EXISTS))
               .when(F.col("_of") > 1, F.lit(KEY_TWICE)))
    return m.join(to, "old_key", "left").join(of, "new_key", "left").join(there, "new_key", "left").select("old_key", "new_key", reason.alias("reason"))


def rekey_rejects(T: dict[str, DataFrame], root: str, mapping: DataFrame) -> DataFrame:
    """The rows of a key mapping that ``cascade_rekey`` does not follow: (old_key, new_key, reason)."""
    return _judged_moves(T, root, mapping).filter(F.col("reason").isNotNull())


def cascade_rekey(T: dict[str, DataFrame], root: str, mapping: DataFrame) -> dict[str, DataFrame]:
    """Change keys of ``root`` (mapping: old_key, new_key) and carry the
    change into every referencing column (ON UPDATE CASCADE).

    Only sound rows of the mapping count: an old key with several new ones, a new key
    that the table has already or that several rows ask for, and a NULL key leave the
    rows as they are (``rekey_rejects`` lists them), so no row is ever doubled and the key
    stays unique."""
    pk = PRIMARY_KEYS[root]
    m = _judged_moves(T, root, mapping).filter(F.col("reason").isNull())
    out = dict(T)

    def remap(df: DataFrame, col: str) -> DataFrame:
        mm = m.select(F.col("old_key").alias(col), F.col("new_key").alias(f"_new_{col}"))
        return (df.join(mm, col, "left")
                .select(*[F.coalesce(F.col(f"_new_{col}"), F.col(c))
                          .cast(df.schema[c].dataType).alias(c) if c == col else F.col(c)
                          for c in df.columns]))

    out[root] = remap(T[root], pk)
    for fk in FOREIGN_KEYS:
        if fk.parent == root and fk.child in T:
            out[fk.child] = remap(out[fk.child], fk.column)
    return out


# ---------------------------------------------------------------------------
# D9 account creation feed
# ---------------------------------------------------------------------------

# Reject reasons of account feeds (the library's own codes).
NO_NAME, UNKNOWN_ROLE, NAME_TAKEN = "no username", "role not known", "username taken"


def expand_accounts(feed: DataFrame, T: dict[str, DataFrame], ci: bool = False) -> dict[str, DataFrame]:
    """Turn an account feed into new Users rows plus staff or patient rows.

    ``feed``: (seq, source 'register'|'admin', username, role, full_name,
    specialty, phone, department_id). Self-registration always makes a
    patient with a Patient row, named from the full name split at the first
    space, or the username when there is no name. Admin-created doctors and
    nurses get a Doctor or Nurse row named from the full name ('' when there
    is none); admin-created patients get no row. A missing full name is
    stored as NULL for a registration and '' for an admin-created account;
    a department id of 0 means none.

    Rejected (in ``Rejected``, with a reason): an empty username, an unknown
    role, and a username that already exists or appeared earlier in the feed
    (in ``seq`` order, NULL last, ties by the other columns; with ``ci`` names that
    differ only in case, accents or trailing spaces are the same). The feed's rows
    are numbered once in that order, and links and keys follow these numbers, so
    neither ties nor repeated rows multiply. The checked feed is stored;
    all outputs read that copy. Returns the new rows of Users, Patient, Doctor
    and Nurse (keys assigned after each table's maximum) and ``Rejected``.
    """
    reg_src = F.col("source") == "register"
    order = ["source", "username", "role", "full_name", "specialty", "phone", "department_id"]
    f = number_new_rows(feed.withColumn("_row", F.lit(None).cast("long")), None, "_row", order=[F.asc_nulls_last("seq"), *order])
    f = f.withColumn("role", F.when(reg_src, F.lit("patient"))
                        .otherwise(F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit("patient"))))
    # earliest feed row per username; later ones collide with it
    f = f.withColumn("_name", text_key(F.col("username"), ci))
    first_row = (f.filter(F.col("_name").isNotNull()).groupBy("_name")
                 .agg(F.min("_row").alias("_first_row")))
    f = f.join(first_row, "_name", "left")
    reason = F.when(F.length(F.coalesce(F.col("username"), F.lit(""))) == 0, F.lit(NO_NAME))
    reason = reason.when(~role_allowed(F.col("role")), F.lit(UNKNOWN_ROLE))
    reason = reason.when(F.col("_row") != F.col("_first_row"), F.lit(NAME_TAKEN))
    if "Users" in T:
        mentioned = f.select("_name").filter(F.col("_name").isNotNull())
        taken = (T["Users"].select(text_key(F.col("username"), ci).alias("_name")).join(mentioned, "_name", "left_semi").distinct()
                 .withColumn("_taken", F.lit(True)))
        f = f.join(taken, "_name", "left")
        reason = reason.when(F.col("_taken"), F.lit(NAME_TAKEN))
    f = cut_lineage(f.withColumn("_reason", reason).drop("_name"))
    rejected = f.filter(F.col("_reason").isNotNull()).select("seq", "username", F.col("_reason").alias("reason"))
    f = f.filter(F.col("_reason").isNull())

    reg_first, reg_last = split_full_name(F.col("full_name"), F.col("username"))
    staff_first, staff_last = split_full_name(F.coalesce(F.col("full_name"), F.lit("")))
    f = (f.withColumn("_first", F.when(reg_src, reg_first).otherwise(F.coalesce(staff_first, F.lit(""))))
          .withColumn("_last", F.when(reg_src, reg_last).otherwise(F.coalesce(staff_last, F.lit(""))))
          .withColumn("full_name", F.when(reg_src, F.nullif(F.col("full_name"), F.lit("")))
                      .otherwise(F.coalesce(F.col("full_name"), F.lit("")))))

    def staff(role: str, table: str, extra: str) -> DataFrame:
        rows = f.filter((F.col("source") == "admin") & (F.col("role") == role))
        pk = PRIMARY_KEYS[table]
        new = rows.select(F.lit(None).cast("long").alias(pk), "_row",
                          F.col("_first").alias("FirstName"), F.col("_last").alias("LastName"),
                          F.coalesce(F.col("specialty"), F.lit("")).alias(extra),
                          F.coalesce(F.col("phone"), F.lit("")).alias("Phone"),
                          F.nullif(F.col("department_id"), F.lit(0)).alias("DepartmentID"))
        return number_new_rows(new, T.get(table), pk, order=["_row"])

    doctors = staff("doctor", "Doctor", "Specialty")
    nurses = staff("nurse", "Nurse", "Certification")
    reg = f.filter(reg_src)
    patients = number_new_rows(
        reg.select(F.lit(None).cast("long").alias("PatientID"), "_row",
                   F.col("_first").alias("FirstName"), F.col("_last").alias("LastName")),
        T.get("Patient"), "PatientID", order=["_row"])
    links = (doctors.select("_row", F.col("DoctorID").alias("_link"))
             .unionByName(nurses.select("_row", F.col("NurseID").alias("_link"))))
    users = (f.join(links, "_row", "left")
             .join(patients.select("_row", F.col("PatientID").alias("_pid")), "_row", "left")
             .select(F.lit(None).cast("long").alias("id"), "_row", "username", "role",
                     "full_name", F.col("_pid").alias("patient_record_id"),
                     F.col("_link").alias("linked_record_id")))
    users = number_new_rows(users, T.get("Users"), "id", order=["_row"])
    return {"Users": users.drop("_row"), "Patient": patients.drop("_row"),
            "Doctor": doctors.drop("_row"), "Nurse": nurses.drop("_row"), "Rejected": rejected}


def with_defaults(df: DataFrame, table: str) -> DataFrame:
    """V5: fill absent values with the declared column defaults."""
    d = DEFAULTS.get(table, {})
    return df.select(*[F.coalesce(F.col(c), F.lit(d[c]).cast(df.schema[c].dataType)).alias(c)
                       if c in d else F.col(c) for c in df.columns])

