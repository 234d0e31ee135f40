"""Data-quality checks as batch jobs (V1-V7). Each returns the offending rows
(or keys) with a reason; ``validate`` splits a batch into good and rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wardbook.schema import FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS, UNIQUE_KEYS, VARCHAR_LIMITS
from wardbook.session import cut_lineage


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """V1: key values held by more than one row: (keys..., n)."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def null_violations(df: DataFrame, cols: list[str]) -> DataFrame:
    """V2: rows with a NULL in a NOT NULL column, with the column named."""
    reason = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"{c} is NULL")) for c in cols])
    return df.select("*", reason.alias("reason")).filter(F.col("reason").isNotNull())


def not_null_columns(table: str) -> list[str]:
    return [f.name for f in SCHEMAS[table].fields if not f.nullable]


def orphan_rows(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """V3: child rows whose non-NULL reference has no parent row."""
    keys = parent.select(F.col(parent_column).alias(column))
    return child.filter(F.col(column).isNotNull()).join(keys, column, "left_anti")


def all_orphans(T: dict[str, DataFrame]) -> dict[tuple[str, str], DataFrame]:
    """V3 for every declared foreign key of the given tables."""
    return {(fk.child, fk.column): orphan_rows(T[fk.child], fk.column, T[fk.parent],
                                               fk.parent_column)
            for fk in FOREIGN_KEYS if fk.child in T and fk.parent in T}


def too_long(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """V4: rows with a string longer than its VARCHAR limit, with the column named."""
    present = {c: n for c, n in limits.items() if c in df.columns}
    reason = F.coalesce(*[F.when(F.char_length(F.col(c)) > n, F.lit(f"{c} longer than {n}"))
                          for c, n in present.items()]) if present else F.lit(None)
    return df.select("*", reason.cast("string").alias("reason")).filter(F.col("reason").isNotNull())


def diagnosis_mismatch(T: dict[str, DataFrame]) -> DataFrame:
    """V6: treatments whose diagnosis belongs to another appointment
    (stated in the data model, never enforced there)."""
    d = T["Diagnosis"].select("DiagnosisID", F.col("AppointmentID").alias("_diag_appt"))
    return (T["Treatment"].join(d, "DiagnosisID")
            .filter(~F.col("AppointmentID").eqNullSafe(F.col("_diag_appt")))
            .drop("_diag_appt"))


def batch_flags(df: DataFrame, batch: str, bad) -> DataFrame:
    """V7: one row per batch: (batch, rejected). One bad row rejects the whole
    batch, as nothing is committed until every item passed."""
    return df.groupBy(batch).agg(F.bool_or(F.coalesce(bad, F.lit(False))).alias("rejected"))


def accept_batches(df: DataFrame, batch: str, bad) -> DataFrame:
    """V7: the rows of batches without a bad row."""
    good = batch_flags(df, batch, bad).filter(~F.col("rejected")).select(batch)
    return df.join(good, batch, "left_semi")


def column_rules(table: str, columns: list[str]) -> dict[str, Column]:
    """V2 and V4 of ``table`` as named conditions on a row (TRUE: broken)."""
    rules = {f"{c} is NULL": F.col(c).isNull() for c in not_null_columns(table) if c in columns}
    return rules | {f"{c} longer than {n}": F.char_length(F.col(c)) > n for c, n in VARCHAR_LIMITS.get(table, {}).items() if c in columns}


def observed(df: DataFrame, table: str, more: dict[str, Column] | None = None) -> tuple[DataFrame, Observation]:
    """``df`` unchanged, and how many of its rows break each column rule (``column_rules`` and
    ``more``), counted while they pass to whatever sink they are written to: no job of its
    own. ``Observation.get`` has the counts, and ``rows``, once the write is done."""
    rules = {**column_rules(table, df.columns), **(more or {})}
    seen = Observation(f"quality of {table}")
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(name) for name, c in rules.items()]), seen


def quality_profile(df: DataFrame, table: str, path: str | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """V1 to V4's column rules of a table as one report: (table, rule, rows, broken), by one job that writes
    the rows to ``path`` on the way (or nowhere)."""
    rows, seen = observed(df, table, more)
    if path:
        rows.write.mode("errorifexists").parquet(path)
    else:
        rows.write.format("noop").mode("overwrite").save()
    counts = dict(seen.get)
    total = counts.pop("rows")
    return df.sparkSession.createDataFrame([(table, rule, total, n) for rule, n in counts.items()], "table_name string, rule string, rows long, broken long")


def validate(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Split rows for ``table`` into (good, rejected with reason) by V2 and V4."""
    nn = not_null_columns(table)
    limits = VARCHAR_LIMITS.get(table, {})
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c} is NULL")) for c in nn if c in df.columns]
    checks += [F.when(F.char_length(F.col(c)) > n, F.lit(f"{c} longer than {n}"))
               for c, n in limits.items() if c in df.columns]
    reason = F.coalesce(*checks) if checks else F.lit(None).cast("string")
    tagged = df.select("*", reason.alias("reason"))
    return (tagged.filter(F.col("reason").isNull()).drop("reason"),
            tagged.filter(F.col("reason").isNotNull()))


def missing_parents(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """V3 by key: the distinct non-NULL values of ``column`` that no parent row has, stored.

    The keys are dealt over twice the shuffle partitions, a number that stays: they are a few
    bytes each, and partitions that are put together by their bytes hold millions of them in
    one task. A task keeps a repeated key once. What is stored has its real size, so the
    join that follows is a broadcast only where the missing keys are few.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mentioned = df.select(column).filter(F.col(column).isNotNull()).repartition(2 * parts, column).distinct()
    # only the parents that the batch mentions: a small batch is broadcast and never shuffles a large table
    known = parent.select(F.col(parent_column).alias(column)).join(mentioned, column, "left_semi")
    return cut_lineage(mentioned.join(known, column, "left_anti"))


def validate_insert(df: DataFrame, table: str, T: dict[str, DataFrame],
                    generated_key: bool = False) -> tuple[DataFrame, DataFrame]:
    """Split rows to insert into ``table`` into (good, rejected with reason),
    by every rule the table declares: NOT NULL (V2), VARCHAR length (V4),
    key uniqueness within the batch and against the table (V1), and parent
    rows for non-NULL references (V3). The first failing rule is the reason.
    With ``generated_key`` the primary key is assigned afterwards (D1), so it
    is neither required nor checked here.

    Every rule is a column test or an equi-join against the keys the batch
    mentions (the target and parent tables are semi-joined to them first, so
    a small batch never shuffles a large table); duplicates are found by a
    per-key count (a partial aggregate), so a hot key costs one row per map
    task before the shuffle. References are checked as soon as this is called:
    the keys without a parent are stored (``missing_parents``).
    """
    pk = PRIMARY_KEYS[table]
    keys = ([] if generated_key else [pk]) + UNIQUE_KEYS.get(table, [])
    x = df
    reasons = [F.when(F.col(c).isNull(), F.lit(f"{c} is NULL"))
               for c in not_null_columns(table)
               if c in df.columns and not (generated_key and c == pk)]
    reasons += [F.when(F.char_length(F.col(c)) > n, F.lit(f"{c} longer than {n}"))
                for c, n in VARCHAR_LIMITS.get(table, {}).items() if c in df.columns]
    for k in keys:
        if k not in df.columns:
            continue
        dup = (df.filter(F.col(k).isNotNull()).groupBy(k).agg(F.count(F.lit(1)).alias("_n"))
               .filter(F.col("_n") > 1).select(k, F.lit(True).alias(f"_dup_{k}")))
        x = x.join(dup, k, "left")
        reasons.append(F.when(F.col(f"_dup_{k}"), F.lit(f"{k} repeated in the batch")))
        if table in T and k in T[table].columns:
            # only the table's keys that the batch mentions (a semi-join, broadcast
            # when the batch passes the size check), never a distinct over the table
            mentioned = df.select(k).filter(F.col(k).isNotNull())  # a semi-join keeps no duplicates
            taken = (T[table].select(k).join(mentioned, k, "left_semi").distinct()
                     .withColumn(f"_taken_{k}", F.lit(True)))
            x = x.join(taken, k, "left")
            reasons.append(F.when(F.col(f"_taken_{k}"), F.lit(f"{k} already exists")))
    for fk in FOREIGN_KEYS:
        if fk.child != table or fk.column not in df.columns or fk.parent not in T:
            continue
        missing = missing_parents(df, fk.column, T[fk.parent], fk.parent_column).withColumn(f"_no_{fk.column}", F.lit(True))
        x = x.join(missing, fk.column, "left")
        reasons.append(F.when(F.col(f"_no_{fk.column}"), F.lit(f"{fk.column} has no {fk.parent}")))
    reason = F.coalesce(*reasons) if reasons else F.lit(None).cast("string")
    tagged = x.select(*df.columns, reason.alias("reason"))
    return (tagged.filter(F.col("reason").isNull()).drop("reason"),
            tagged.filter(F.col("reason").isNotNull()))
