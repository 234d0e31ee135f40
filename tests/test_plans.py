"""Plan guards for every registered query: no cartesian products or nested
loop joins, and scans read only the columns they need."""

import contextlib
import io
import os
import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
EAGER = {"stream_billing", "stream_payments"}  # these run their stream when called


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - EAGER))
def test_no_nested_loops(spark, name):
    text = plan_text(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_lineitem_scan_is_pruned(spark):
    text = plan_text(entry.queries()["report_treatment_by_dept"](spark, SF))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    lineitem = [s for s in schemas if "l_orderkey" in s]
    assert lineitem and all(set(c.split(":")[0] for c in s.split(",")) <= {
        "l_orderkey", "l_linenumber", "l_extendedprice"} for s in lineitem)


def test_key_filter_reaches_the_scan(spark):
    text = plan_text(entry.queries()["billing_for_patient"](spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_custkey,1\)", text)
