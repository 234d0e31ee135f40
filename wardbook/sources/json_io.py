"""JSON in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardbook.functions.scalars import hhmm


# Reject reasons of JSON bodies (the library's own codes).
UNREADABLE, EMPTY, NO_OBJECT = "body not readable", "no items", "item is no object"


def json_items(df: DataFrame, col: str, keep: list[str]) -> DataFrame:
    """One row per item of each body, a JSON object or a list of objects: ``keep``,
    ``_item`` (its index), ``_f`` (its fields as text) and ``_reason`` if the body or the item is
    unusable; a body that can't be read or has no items gives one such row."""
    text = F.col(col)
    as_list = F.when(F.ltrim(text).startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    # the list first, then each item: one that is no object spoils only itself
    read = df.select(*keep, F.from_json(as_list, "array<string>").alias("_items"))
    rows = read.select(*keep, F.size("_items").alias("_n"), F.posexplode_outer("_items").alias("_item", "_text"))
    rows = rows.withColumn("_f", F.from_json("_text", "map<string,string>"))
    reason = (F.when(F.col("_n").isNull() | (F.col("_n") < 0), F.lit(UNREADABLE))
               .when(F.col("_n") == 0, F.lit(EMPTY)).when(F.col("_f").isNull(), F.lit(NO_OBJECT)))
    return rows.select(*keep, F.coalesce(F.col("_item"), F.lit(0)).alias("_item"), "_f", reason.alias("_reason"))


def item_field(name: str) -> Column:
    """A field of a ``json_items`` row, as text (NULL if absent or null)."""
    return F.try_element_at(F.col("_f"), F.lit(name))


def checked_items(df: DataFrame, col: str, schema: T.StructType, keep: list[str] | None = None) -> DataFrame:
    """Every item of the JSON bodies in ``col``: ``keep``, ``_item``, the fields of ``schema`` and ``_reason``.

    Each field is cast from its text (so ``"2"`` is a number, as forms post them); a text that is no
    such value, and a NULL where the schema allows none, is a fault of the item that names the
    field. The first fault in the schema's order is the reason."""
    rows = json_items(df, col, keep or [])
    fields, faults = [], []
    for f in schema.fields:
        text = item_field(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.from_json(text, f.dataType)
        else:
            value = text if isinstance(f.dataType, T.StringType) else text.try_cast(f.dataType)
        fields.append(value.alias(f.name))
        faults.append(F.when(text.isNotNull() & value.isNull(), F.lit(f"{f.name} is not a {f.dataType.simpleString()}")))
        if not f.nullable:
            faults.append(F.when(text.isNull(), F.lit(f"{f.name} is missing")))
    return rows.select(*(keep or []), "_item", *fields, F.coalesce("_reason", *faults).alias("_reason"))


def read_json_batch(df: DataFrame, col: str, schema: T.StructType,
                    keep: list[str] | None = None, position: str | None = None) -> DataFrame:
    """S3: parse a JSON text column holding one object or a list of objects
    into one row per object (fields of ``schema``); ``keep`` columns ride along,
    and ``position`` (if named) holds each object's index in its list.

    Bodies and items that can't be read as ``schema`` are left out; ``json_rejects`` gives
    them with their reasons.
    """
    keep = keep or []
    pos = [F.col("_item").alias(position)] if position else []
    return checked_items(df, col, schema, keep).filter(F.col("_reason").isNull()).select(*keep, *pos, *schema.fieldNames())


def json_rejects(df: DataFrame, col: str, schema: T.StructType, keep: list[str] | None = None,
                 position: str = "item") -> DataFrame:
    """S3: what ``read_json_batch`` leaves out: ``keep``, the item's index and the reason."""
    keep = keep or []
    return checked_items(df, col, schema, keep).filter(F.col("_reason").isNotNull()).select(*keep, F.col("_item").alias(position), F.col("_reason").alias("reason"))


def _lines(spark, path: str) -> DataFrame:
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("body")).filter(F.length(F.trim("body")) > 0)


def read_json_files(spark, path: str, schema: T.StructType) -> DataFrame:
    """S3 for files: a JSON object or a list of objects on each line, schema given (no inference)."""
    return read_json_batch(_lines(spark, path), "body", schema)


def json_file_rejects(spark, path: str, schema: T.StructType) -> DataFrame:
    """S3 for files: (file, body, item, reason) of what ``read_json_files`` leaves out."""
    return json_rejects(_lines(spark, path), "body", schema, keep=["file", "body"])


def json_ready(df: DataFrame, time_cols: tuple[str, ...] = ("AppointmentTime",)) -> DataFrame:
    """S4 projection: decimals as numbers (doubles), dates as ISO strings,
    times of day as 'HH:mm'."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd") if isinstance(f.dataType, T.DateType) \
                else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif f.name in time_cols:
            c = hhmm(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def to_json_rows(df: DataFrame, time_cols: tuple[str, ...] = ("AppointmentTime",)) -> DataFrame:
    """One JSON object per row in a ``json`` column."""
    ready = json_ready(df, time_cols)
    return ready.select(F.to_json(F.struct(*ready.columns)).alias("json"))


def write_json(df: DataFrame, path: str, time_cols: tuple[str, ...] = ("AppointmentTime",)) -> None:
    """S4 sink: JSON lines files in a new folder (an existing one is refused)."""
    json_ready(df, time_cols).write.mode("errorifexists").json(path)
