"""Scale guarantees of the registered plans, pinned against regressions."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from runlens.plans import catalog as C

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("SortAggregate", "BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython")


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(C.QUERIES))
def test_plan_has_no_unscalable_operators(spark, name):
    plan = _plan(C.QUERIES[name](spark, SF))
    found = [f for f in FORBIDDEN if f in plan]
    assert not found, f"{name}: {found}"


def test_parquet_scans_are_pruned(spark):
    """A query reading two columns of a wide table reads only those columns."""
    plan = _plan(E.queries()["usage_totals"](spark, SF))
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line and "lineitem" in line][0]
    assert "l_shipdate" not in scan and "l_tax" not in scan and "l_discount" not in scan
