"""Folders of files with several layouts, in both orders of the files' names."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F, types as T

from wardbook.session import scratch_path
from wardbook.sources.tables import load_tables, save_tables, stored_layout, union_layout, widest


def named_files(spark, root, parts):
    """Each DataFrame as one file of the table's folder, under the given name."""
    fs = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
    path = spark._jvm.org.apache.hadoop.fs.Path
    for name, df in parts.items():
        tmp = scratch_path(spark, "one")
        df.coalesce(1).write.parquet(tmp)
        (file,) = [f for f in spark.read.parquet(tmp).inputFiles()]
        fs.mkdirs(path(root))
        assert fs.rename(path(file), path(f"{root}/{name}.parquet"))


@pytest.mark.parametrize("old,new", [("part-0", "part-1"), ("part-1", "part-0")])
def test_a_new_column_keeps_its_values(spark, old, new):
    root = scratch_path(spark, "users")
    first = spark.createDataFrame([(1, "ann"), (2, "bob")], "id int, username string")
    second = spark.createDataFrame([(3, "cyd", 9)], "id int, username string, linked_record_id int")
    named_files(spark, f"{root}/Users", {old: first, new: second})
    users = load_tables(spark, root, ["Users"])["Users"]
    assert {r["id"]: r["linked_record_id"] for r in users.collect()} == {1: None, 2: None, 3: 9}
    assert users.schema["id"].dataType == T.IntegerType() and "full_name" in users.columns


@pytest.mark.parametrize("names", [("a", "b", "c"), ("c", "b", "a"), ("b", "c", "a")])
def test_types_are_widened(spark, names):
    root = scratch_path(spark, "wide")
    parts = [spark.createDataFrame([(1, Decimal("1.25"), 1.5)], "TreatmentID int, TreatmentCost decimal(10,2), f float"),
             spark.createDataFrame([(5_000_000_000, Decimal("12345678901.125"), 0.1)], "TreatmentID long, TreatmentCost decimal(14,3), f double"),
             spark.createDataFrame([(7, "x")], "TreatmentID int, extra string")]
    named_files(spark, f"{root}/Treatment", dict(zip(names, parts)))
    t = load_tables(spark, root, ["Treatment"])["Treatment"]
    assert {(r["TreatmentID"], r["TreatmentCost"], r["f"], r["extra"]) for r in t.collect()} == {
        (1, Decimal("1.250"), 1.5, None), (5_000_000_000, Decimal("12345678901.125"), 0.1, None), (7, None, None, "x")}
    # the caller's own layout is given to the reader as it is
    own = T.StructType([T.StructField("TreatmentID", T.LongType()), T.StructField("extra", T.StringType())])
    t = load_tables(spark, root, ["Treatment"], schemas={"Treatment": own})["Treatment"]
    assert {(r["TreatmentID"], r["extra"]) for r in t.collect()} == {(1, None), (5_000_000_000, None), (7, "x")}


def test_types_that_nothing_holds_are_an_error(spark):
    root = scratch_path(spark, "clash")
    named_files(spark, f"{root}/Doctor", {"a": spark.createDataFrame([(1, "1")], "DoctorID int, Phone string"), "b": spark.createDataFrame([(2, 2)], "DoctorID int, Phone int")})
    with pytest.raises(ValueError, match="Phone is (string|int) in some files and (string|int)"):
        load_tables(spark, root, ["Doctor"])


def test_widest():
    i, l, f, d = T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()
    assert [widest(*x) for x in ((i, l), (l, i), (f, d), (i, d), (l, d), (T.ShortType(), i))] == [l, l, d, d, None, i]
    assert widest(T.DecimalType(10, 2), T.DecimalType(12, 4)) == T.DecimalType(12, 4)
    assert widest(T.DecimalType(10, 2), i) == T.DecimalType(12, 2) and widest(T.DecimalType(38, 2), T.DecimalType(38, 6)) is None
    assert widest(T.DateType(), T.TimestampNTZType()) == T.TimestampNTZType() and widest(T.StringType(), i) is None
    a = T.StructType([T.StructField("Id", i), T.StructField("x", T.StringType())])
    b = T.StructType([T.StructField("id", l), T.StructField("y", d)])
    assert [(x.name, x.dataType) for x in union_layout(a, b)] == [("Id", l), ("x", T.StringType()), ("y", d)]


def test_one_layout_and_folders(spark, seed):
    """Files of one layout need no own layout; folder columns and pruning by them stay."""
    root = scratch_path(spark, "folders")
    save_tables({"Appointment": seed["Appointment"]}, root, partition_by={"Appointment": ["Status"]})
    assert stored_layout(spark, f"{root}/Appointment") is None
    back = load_tables(spark, root, ["Appointment"])["Appointment"]
    cols = seed["Appointment"].columns
    assert back.select(cols).exceptAll(seed["Appointment"].select(cols)).count() == 0 and back.count() == seed["Appointment"].count()
    (seed["Appointment"].withColumn("AppointmentID", F.col("AppointmentID") + F.lit(10_000_000_000)).withColumn("Room", F.lit("7"))
     .write.mode("append").partitionBy("Status").parquet(f"{root}/Appointment"))
    wide = load_tables(spark, root, ["Appointment"])["Appointment"]
    assert wide.where("AppointmentID > 10000000000 AND Room = '7'").count() == seed["Appointment"].count()
    assert wide.where("Status = 'Canceled'").count() == 2 * back.where("Status = 'Canceled'").count() > 0
