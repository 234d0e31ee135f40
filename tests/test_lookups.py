"""Many searches at once, dates over folders by month, largest keys from file footers."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from wardbook.operators import changes as D
from wardbook.operators import listings as L
from wardbook.session import scratch_path
from wardbook.sources import tables as S

ROWS = [(1, "Ann", "Lee"), (2, "BO", None), (3, "Zoë", "ΣΑΣ"), (4, "", ""), (5, None, "lean 𝔘x"), (1, "Ann", "Lee"), (6, "a%b_c", "x\ny")]
SEARCHES = ["ann", "NL", "e", "—", "le", "Lean", "zoë", "𝔘x", "𝔘", "", "%b_", "x\ny", "nobody", "4", "ann", None, "annlee", "1ann", "ανν"]


def test_many_searches_find_what_each_finds(spark):
    df = spark.createDataFrame(ROWS, "id int, first string, search string")
    searches = spark.createDataFrame([(q, 0) for q in SEARCHES], "q string, id int")
    got = L.search_many(df, searches, "q", name="asked")
    assert got.columns == ["asked", "id", "first", "search"]
    want = [(q, *r) for q in set(SEARCHES) - {None} for r in L.search_rows(df, q).collect()]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want) > 25
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (" in plan and "Cartesian" not in plan
    assert L.search_many(df, searches.where("q = 'nobody'"), "q").count() == 0
    assert L.search_many(df.where("id < 0"), searches, "q").count() == 0 == L.search_many(df, searches.where("id > 0"), "q").count()
    # some cells only, and with something between them
    assert {r["id"] for r in L.search_many(df, searches.where("q = 'le'"), "q", ["search"]).collect()} == {1, 5}
    assert L.search_many(df, searches.where("q = 'NL'"), "q", ["first", "search"], sep="|").count() == 0


def files_read(df):
    """Files of the table's scan in the plan that ran."""
    def scans(plan):
        leaves = plan.collectLeaves()
        for x in (leaves.apply(i) for i in range(leaves.size())):
            if x.getClass().getSimpleName() == "FileSourceScanExec":
                yield x
            elif x.getClass().getSimpleName() == "ResultQueryStageExec":
                yield from scans(x.plan())
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    return [x.metrics().apply("numFiles").value() for x in scans(plan)]


def test_dates_read_their_months_only(spark):
    appts = spark.range(2400).select(F.col("id").cast("int").alias("AppointmentID"),
                                     F.when(F.col("id") % 100 > 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 700).cast("int"))).alias("AppointmentDate"))
    root = scratch_path(spark, "test-months")
    S.save_tables({"Appointment": S.with_month(appts).repartition(1)}, root, partition_by={"Appointment": ["AppointmentMonth"]})
    stored = S.load_tables(spark, root, ["Appointment"])["Appointment"]
    days = spark.createDataFrame([("2020-03-05",), ("2020-03-06",), ("2021-07-31",), ("2021-07-31",), (None,), ("1999-01-01",)], "d string").select(F.col("d").cast("date"))
    days_stored = scratch_path(spark, "test-days")
    days.write.parquet(days_stored)
    got = L.by_days(stored, spark.read.parquet(days_stored))
    assert got.columns == stored.columns
    want = appts.where(F.col("AppointmentDate").isin("2020-03-05", "2020-03-06", "2021-07-31"))
    assert got.select(appts.columns).exceptAll(want).count() == 0 and got.count() == want.count() > 5
    assert files_read(got) == [2] and files_read(stored.where("AppointmentID >= 0")) == [24]


def test_largest_key_from_the_footers(spark, tmp_path):
    path = f"{tmp_path}/with"
    spark.range(1, 5001).select("id", F.lit("x").alias("t")).write.parquet(path)
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    assert "PushedAggregation: [MAX(id)]" in S.max_plan(own.read.parquet(path), "id")._jdf.queryExecution().toString()
    before = spark.conf.get("spark.sql.parquet.aggregatePushdown")
    assert S.max_key(spark, path, "id") == 5000 and spark.conf.get("spark.sql.parquet.aggregatePushdown") == before


@pytest.mark.parametrize("case", ["none", "nulls", "mixed", "empty", "later", "order"])
def test_largest_key_without_statistics(spark, tmp_path, case):
    folder = tmp_path / case
    folder.mkdir()
    ids = {"none": [[3, 9], [7, 1]], "nulls": [[None, None], [4, None]], "mixed": [[2, 5], [1 << 40, 3]], "empty": [[]], "later": [[2, 5], [11]], "order": [[2, 5], [6]]}[case]
    for i, x in enumerate(ids):
        kind = pa.int64() if case != "mixed" or i else pa.int32()
        table = pa.table({"id": pa.array(x, kind)})
        if case == "later" and i == 0:
            table = pa.table({"other": pa.array(x, kind)})
        if case == "order":  # another column stands first in one of the files
            table = table.append_column("n", pa.array([x * 100 for x in x], kind)).select(["id", "n"] if i else ["n", "id"])
        pq.write_table(table, folder / f"part-{i}.parquet", write_statistics=case != "none")
    assert S.max_key(spark, str(folder), "id") == {"none": 9, "nulls": 4, "mixed": 1 << 40, "empty": 0, "later": 11, "order": 6}[case]


def test_keys_after_a_given_maximum(spark):
    new = spark.createDataFrame([(None, "b"), (None, "a"), (4, "c")], "id long, t string")
    assert {(r["id"], r["t"]) for r in D.assign_ids(new, 40, "id", ["t"]).collect()} == {(41, "a"), (42, "b"), (4, "c")}


@pytest.mark.parametrize("most", [None, 0])
def test_rows_of_a_search_are_never_broadcast(spark, monkeypatch, most):
    """A stored table looks small, but each of its rows stands once for every run of its text."""
    if most is not None:
        monkeypatch.setattr(L, "BROADCAST_SEARCHES", most)
    path = scratch_path(spark, "test-search")
    spark.range(3000).select("id", F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("name")).write.parquet(path)
    df = spark.read.parquet(path)
    got = L.search_many(df, df.where("id % 100 = 0").select(F.substring("name", -4, 4).alias("q")).union(df.limit(1).select(F.lit("STOMER#"))), "q", ["name"])
    want = df.where("id % 100 = 0").select(F.substring("name", -4, 4).alias("q")).collect()
    found = {(r["search"], r["id"]) for r in got.collect()}
    names = {i: f"customer#{i:09d}" for i in range(3000)}
    assert found == {(q, i) for q in {r["q"] for r in want} | {"STOMER#"} for i in names if q.lower() in names[i]}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and ("BroadcastHashJoin" in plan) == (most is None) == ("SortMergeJoin" not in plan)
