"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

Texts = Callable[[pa.Array], list[pa.Array]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, as --py-files would, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "wardbook.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(root)))
    sc.addPyFile(path)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not sc.getConf().contains(rows):  # texts are long: some MB a batch
        spark.conf.set(rows, "2000")
    _SHIPPED.add(sc.applicationId)


def arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_text(docs: DataFrame, text: str, make: Callable[[], Texts], out: T.StructType) -> DataFrame:
    """``docs`` with the columns ``out`` that ``make()`` computes from the text column,
    a batch at a time; ``make`` is called once in each task. All other columns pass
    through unread; ``out`` replaces columns of the same name."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([packed.schema["row"], *out.fields])
    fields = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            row = b.column(0)
            new = f(row.field(row.type.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([row, *[a.cast(x.type) for a, x in zip(new, fields)]],
                                             names=["row", *fields.names])

    df = arrow(packed, run, schema)
    names = {n.lower() for n in out.names}
    return df.select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in names], *out.names)
