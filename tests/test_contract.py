"""The driver's contract: queries against their SQL counterparts, and the shape of their plans."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from gridcast.functions.vocabulary import STATION
from queries import bindings

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer orders lineitem events documents".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")

# One query per operator family; the driver compares all of them.
CHOSEN = (
    "q_scan_coerce",
    "q_quality_mask",
    "q_hour_collapse",
    "q_grid_align",
    "q_flatline",
    "q_mask_report",
    "q_run_interpolate",
    "q_freshest_columnwise",
    "q_covered_folds",
    "q_position_folds",
    "q_run_plan",
    "q_index_ranges",
    "q_climatology",
    "q_anomaly_decay",
    "q_summary_total",
    "q_box_summary",
    "q_stream_flatline",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    out = pdf[sorted(pdf.columns)].copy()
    for c in out.columns:
        if pd.api.types.is_datetime64_any_dtype(out[c]):
            out[c] = out[c].astype("datetime64[us]")
    return out.sort_values(list(out.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    got = ordered(entry.queries()[name](spark, SF).toPandas())
    expected = ordered(duck.execute(entry.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, expected, check_dtype=False, rtol=0, atol=1e-9)


def test_contract_shape(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
    assert entry.entry(spark).count() > 0


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q_freshest_by_cutoff", "q_covered_folds", "q_climatology", "q_persistence", "q_attach_left", "q_position_folds", "q_usable_history", "q_grid_align", "q_bootstrap"])
def test_no_products_of_tables(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(entry.queries()["q_dedupe_exact"](spark, SF))
    assert "ReadSchema" in plan and "user_id" not in plan.split("ReadSchema")[1].split("\n")[0]
    collapsed = plan_of(bindings.readings(spark, SF).groupBy(STATION).count())
    assert "props" not in collapsed.split("ReadSchema")[1].split("\n")[0]


def test_coverage_reduces_before_its_shuffle(spark):
    plan = plan_of(entry.queries()["q_covered_folds"](spark, SF))
    assert "partial_max" in plan and "SortAggregate" not in plan


def hash_joins(plan: str) -> list[str]:
    """Joins that build a table from one side, broadcast or shuffled."""
    return [line for line in plan.split("\n") if "BroadcastHashJoin" in line or "ShuffledHashJoin" in line]


def test_generated_rows_are_never_broadcast(spark):
    from gridcast.operators import compare as K

    rows = [("rolling", "a", "b", f"{i:03d}", float(i)) for i in range(40)]
    diffs = spark.createDataFrame(rows, "folds string, challenger string, reference string, cutoff string, difference double")
    joins = hash_joins(plan_of(K.resample(diffs, 100)))
    assert joins and all("BuildRight" in j for j in joins)
    plan = plan_of(entry.queries()["q_calendar_regression"](spark, SF))
    assert "ShuffledHashJoin" in plan
