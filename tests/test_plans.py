"""Shapes of physical plans that must hold at any size."""

import datetime as dt

import pytest

import __spark_entry__  # noqa: F401  (loads the queries)
from playbill.operators import filters as fl
from playbill.operators.filters import Filters, apply_filters
from playbill.operators.ingest import normalize, upsert
from playbill.plans import tables as tb
from playbill.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
STREAMS = {n for n in QUERIES if n.startswith("stream_")} | {"silver_write", "run_log_written"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "listings")
    tb.listings(spark, FOLDER).write.partitionBy("event_date").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS - {"seed_weights"}))
def test_no_cross_or_nested_loop_join(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_seeding_tests_emptiness_with_one_row(spark):
    """The emptiness test is a one-row subquery, not a join of two tables."""
    assert "CartesianProduct" not in plan(QUERIES["seed_weights"](spark, FOLDER))


def test_merge_has_one_shuffle(spark):
    batch = normalize(tb.raw_listings(spark, FOLDER))
    merged = upsert(upsert(None, batch, tb.ntz("2024-01-01 00:00:00")), batch, tb.ntz("2024-01-02 00:00:00"))
    assert plan(upsert(None, batch, tb.ntz("2024-01-01 00:00:00"))).count("Exchange hashpartitioning") == 1
    assert plan(merged).count("Exchange hashpartitioning") == 2


def test_filters_reach_the_scan(stored):
    f = Filters(category="music", city="ASIA", date_from=dt.date(2024, 1, 8), date_to=dt.date(2024, 1, 14))
    text = plan(apply_filters(stored, f).select("id"))
    assert "PartitionFilters: [isnotnull(event_date" in text
    assert "EqualTo(category,music)" in text and "EqualTo(city" in text
    assert "genre_tags" not in text.split("ReadSchema")[-1]


def test_pages_are_top_k(stored):
    for df in (fl.page(stored, "date", 2, 50), fl.page_after(stored, (dt.date(2024, 1, 9), None, 0))):
        assert "TakeOrderedAndProject" in plan(df)


@pytest.mark.parametrize("name", ["best_method", "jsonld_sample"])
def test_page_text_is_read_once(spark, name):
    assert plan(QUERIES[name](spark, FOLDER)).count("FileScan") == 1


def test_latest_run_sorts_no_log(spark):
    """Only the few rows found are sorted; the log itself is hash-aggregated."""
    assert "SortAggregate" not in plan(QUERIES["latest_run_per_source"](spark, FOLDER))
