"""Merge semantics on small literal tables."""

import pytest
from pyspark.sql import functions as F

from playbill.operators import ingest
from playbill.plans.tables import ntz
from playbill.schema import RAW_LISTING

T1, T2 = "2024-01-01 00:00:00", "2024-01-02 00:00:00"


def merge(target, batch, time):
    return ingest.upsert(target, batch, ntz(time))


def raw(spark, *rows):
    base = dict(source="api", source_name="a", precedence=0, title="Band", artist=None, venue="Hall", city=None,
                date="2024-05-01", time=None, doors_time=None, category=None, genre_tags="", ticket_url=None,
                image_url=None, price_range=None)
    return spark.createDataFrame([tuple((base | {"seq": i} | r)[f.name] for f in RAW_LISTING) for i, r in enumerate(rows)],
                                 RAW_LISTING)


def as_set(df):
    return {tuple(r) for r in df.drop("created_at", "updated_at").collect()}


def test_merge_twice_is_merge_once(spark):
    batch = ingest.normalize(raw(spark, {}, {"title": "bánd!", "precedence": 2}, {"title": "Other"}))
    once = merge(None, batch, T1)
    assert as_set(merge(once, batch, T2)) == as_set(once)
    assert once.count() == 2


def test_nulls_overwrite_and_flags_stay(spark):
    first = merge(None, ingest.normalize(raw(spark, {"city": "Tacoma", "price_range": "$5"})), T1)
    marked = first.withColumns({"interested": F.lit(True), "hidden": F.lit(True)})
    row = merge(marked, ingest.normalize(raw(spark, {"seq": 9, "title": "BAND", "source_name": "b"})), T2).first()
    assert (row.city, row.price_range, row.title, row.source_name) == (None, None, "BAND", "b")
    assert (row.id, row.interested, row.hidden) == (0, True, True)
    assert row.created_at < row.updated_at


def test_counts_add_up(spark):
    target = merge(None, ingest.normalize(raw(spark, {})), T1)
    batch = raw(spark, {}, {}, {"title": "New"}, {"title": "new"}, {"title": ""}, {"date": "TBA"}, {"venue": None})
    assert tuple(ingest.upsert_counts(target, batch).first()) == (7, 1, 3, 3)
    assert tuple(ingest.upsert_counts(None, batch).first()) == (7, 2, 2, 3)


def test_row_order_does_not_matter(spark):
    rows = [{"seq": i, "title": "Band" if i % 2 else "BAND", "precedence": i % 3, "city": str(i)} for i in range(12)]
    forward, back = raw(spark, *rows), raw(spark, *reversed(rows))
    assert as_set(merge(None, ingest.normalize(forward), T1)) == as_set(
        merge(None, ingest.normalize(back), T1))


def test_non_latin_titles_collide(spark):
    keys = [r.dedupe_key for r in ingest.normalize(raw(spark, {"title": "東京"}, {"title": "大阪"})).collect()]
    assert keys == ["|2024-05-01|hall"] * 2


def test_unknown_source_is_an_error(spark):
    batch = ingest.normalize(raw(spark, {}))
    with pytest.raises(ValueError, match="Unknown source"):
        ingest.refresh_one_source(merge(None, batch, T1), batch, "zz", batch.select("source_name"), ntz(T2))
    with pytest.raises(ValueError, match="Unknown adapter"):
        ingest.union_sources({"zz": batch})


def test_scraper_outranks_apis(spark):
    one = raw(spark, {"source": "api"}).drop("precedence")
    two = raw(spark, {"source": "scrape"}).drop("precedence")
    merged = merge(None, ingest.normalize(ingest.union_sources({"scraper": two, "ticketmaster": one})), T1)
    assert [r.source for r in merged.collect()] == ["scrape"]
