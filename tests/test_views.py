"""Views, paging, feedback and run log on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from playbill.operators import feedback as fb
from playbill.operators import filters as fl
from playbill.operators import runs as rn
from playbill.operators import scoring as sc
from playbill.operators import views as vw
from playbill.operators.filters import Filters
from playbill.plans import tables as tb
from playbill.sinks import exports
from playbill.sources import payloads

FOLDER = "/root/testdata/sf0.001"
D = dt.date


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("v") / "listings")
    tb.listings(spark, FOLDER).write.parquet(path)
    return spark.read.parquet(path)


def test_paging_by_key_visits_every_row_once(table):
    expected = [r.id for r in table.orderBy(*fl.date_order()).collect()]
    seen, last = [], (D(2000, 1, 1), None, 0)
    while True:
        rows = fl.page_after(table, last, 200).collect()
        if not rows:
            break
        seen += [r.id for r in rows]
        last = (rows[-1].event_date, rows[-1].event_time, rows[-1].id)
    assert seen == expected


def test_deep_pages_equal_pages(spark):
    """One hot day and time, days and times missing, ids far apart, the last page and one past the end."""
    rows = ([(i * i, None if i % 5 == 0 else dt.date(2024, 1, 7), None if i % 3 == 0 else "20:00") for i in range(120)]
            + [(10**12 + i, dt.date(2024, 1, 8 + i % 2), f"1{i % 4}:00") for i in range(40)])
    many = spark.createDataFrame(rows, "id bigint, event_date date, event_time string").repartition(3)
    for number in (1, 2, 5, 9, 14, 16, 17):
        assert fl.deep_page(many, number, 10, near=4).collect() == fl.page(many, "date", number, 10).collect()
    assert fl.deep_page(many.where("id < 0"), 3, 10, near=4).collect() == []


def test_kept_facets_follow_changes(spark):
    """A value that goes, one that comes, a tag repeated in a listing, empty cities and null tags."""
    kind = "id int, genre_tags string, city string, source_name string"
    old = [(1, "rock, rock, jazz", "Oslo", "a"), (2, "jazz", "", "b"), (3, None, "Rome", None)]
    new = {1: (1, "rock", "Bonn", "a"), 3: (3, "pop", None, None), 4: (4, "", "Oslo", "c")}
    kept = fl.facet_counts(spark.createDataFrame(old, kind))
    changes = fl.facet_changes(spark.createDataFrame([r for r in old if r[0] in new], kind), spark.createDataFrame(list(new.values()), kind))
    rows = [new.get(r[0], r) for r in old] + [new[4]]
    got = {tuple(r) for r in fl.change_facets(kept, changes).collect()}
    assert got == {tuple(r) for r in fl.facet_counts(spark.createDataFrame(rows, kind)).collect()}
    assert ("tag", "rock", 1) in got and ("city", "Bonn", 1) in got and ("source", "c", 1) in got
    assert {tuple(r)[:2] for r in fl.facets_all(spark.createDataFrame(rows, kind)).collect()} == {r[:2] for r in got}


def test_week_always_has_seven_days(table):
    for as_of, busy in ((D(2024, 1, 10), 7), (D(2030, 5, 5), 0)):
        rows = vw.week_counts(table, as_of).collect()
        assert len(rows) == 7 and sum(r.n > 0 for r in rows) == busy
        assert rows[0].event_date.weekday() == 0
    assert vw.week_counts(table, D(2024, 1, 10)).first().label == "Monday, Jan 8"


def test_month(table):
    counts = vw.month_counts(table, "2024-01", D(2024, 1, 10))
    assert counts.agg(F.sum("n")).first()[0] == vw.month_listings(table, "x", D(2024, 1, 10)).count()
    assert vw.month_listings(table, "2024-13", D(2024, 1, 10)).count() == 0
    assert vw.month_of("2024-02", D(2024, 1, 1)) == (D(2024, 2, 1), D(2024, 2, 29))
    grid = vw.month_grid(table, "2024-02", D(2024, 2, 9)).collect()
    assert [c.cell for c in grid] == list(range(1, 33)) and [c.day for c in grid[:4]] == [None, None, None, 1]
    assert not any(c.selected for c in grid)
    picked = [c.event_date for c in vw.month_grid(table, "2024-01", D(2024, 3, 1)).collect() if c.selected]
    assert picked == [D(2024, 1, 1)]


def test_user_wildcards_and_backslashes(spark):
    df = spark.createDataFrame([("100% Live",), ("a\\b",), ("ÉCLAT",)], "t string")
    def hits(q):
        return [r.t for r in df.where(fl.matches("t", q)).collect()]
    assert hits("0_ l") == ["100% Live"] and hits("A\\B") == ["a\\b"] and hits("éclat") == [] and hits("clat") == ["ÉCLAT"]


def test_score_counts_a_genre_once(spark):
    listing = spark.createDataFrame([(1, "indie rock, rock", "Rocky"), (2, "", None), (3, "jazz", "Nobody")],
                                    "id int, genre_tags string, artist string")
    weights = spark.createDataFrame([("rock", 5), ("indie", 2), ("folk", 3)], "genre string, weight int")
    decayed = spark.createDataFrame([("rocky", 1.5), ("rock", 0.5)], "tag string, decayed double")
    rows = {r.id: (r.base, r.boost, r.score) for r in sc.score_listings(listing, weights, decayed).collect()}
    assert rows == {1: (7.0, 2.0, 9.0), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}


def test_decay(spark):
    now = dt.datetime(2024, 3, 1)
    rows = [("old", 4.0, now - dt.timedelta(weeks=2)), ("new", 4.0, now), ("future", 4.0, now + dt.timedelta(weeks=9)), ("none", 4.0, None)]
    signals = spark.createDataFrame(rows, "tag string, signal_count double, last_signal timestamp_ntz")
    got = {r.tag: r.decayed for r in sc.decay_signals(signals, now).collect()}
    assert got == {"old": 2.0, "new": 4.0, "future": 4.0, "none": 4.0}


def test_weights(spark):
    texts = ["4abc", "0", "loud", "9", "-3", " 2", "", "3.9", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(fb.parsed_weight(F.coalesce("t", F.lit("")))).collect()]
    assert got == [4, 3, 3, 5, 1, 2, 3, 3, 3]
    none = spark.createDataFrame([], "genre string, weight int")
    assert fb.seed_weights(none).count() == len(fb.DEFAULT_GENRES)
    assert fb.seed_weights(spark.createDataFrame([("x", 1)], "genre string, weight int")).count() == 1


def test_state_flags_are_independent(spark):
    log = spark.createDataFrame([(1, "k", "interested", 1), (2, "k", "hidden", 1), (3, "k", "interested", 0), (4, "z", "hidden", 0)],
                                "seq long, dedupe_key string, attr string, val int")
    assert {tuple(r) for r in fb.current_state(log).collect()} == {("k", False, True), ("z", False, False)}
    cleared = fb.clear_hidden(log, 9)
    assert [(r.dedupe_key, r.val) for r in cleared.collect()] == [("k", 0)]
    assert not any(r.hidden for r in fb.current_state(log.unionByName(cleared)).collect())


def test_remarking_adds_again(spark):
    actions = spark.createDataFrame([("k", "interested", 1, 1), ("k", "interested", 0, 2), ("k", "interested", 1, 3), ("k", "hidden", 1, 4)],
                                    "dedupe_key string, attr string, val int, ts int")
    listing = spark.createDataFrame([("k", "Rock, rock,  ", "Ann")], "dedupe_key string, genre_tags string, artist string")
    got = {(r.tag, r.signal_count, r.last_signal) for r in fb.signals_from_interest(actions, listing).collect()}
    assert got == {("rock", 4.0, 3), ("ann", 2.0, 3)}


def test_relative_time(spark):
    now = dt.datetime(2024, 1, 10, 12)
    gaps = [(0, "just now"), (29, "just now"), (30, "1m ago"), (59 * 60, "59m ago"), (90 * 60, "2h ago"), (89 * 60, "1h ago"),
            (23.6 * 3600, "1d ago"), (36 * 3600, "2d ago"), (-500, "just now")]
    df = spark.createDataFrame([(i, now - dt.timedelta(seconds=s)) for i, (s, _) in enumerate(gaps)] + [(99, None)], "i int, t timestamp_ntz")
    got = [r[0] for r in df.orderBy("i").select(rn.relative_time(F.col("t"), now)).collect()]
    assert got == [e for _, e in gaps] + ["never"]


def test_health_of_an_empty_log(spark):
    log = tb.run_log(spark, FOLDER)
    assert rn.health_flag(log.where(F.lit(False))).first().flag == ""
    assert rn.health_flag(log.where("status = 'ok'")).first().flag == "ok"


def test_export_files(spark, table, tmp_path):
    none = spark.createDataFrame([], "genre string, weight int"), spark.createDataFrame([], "tag string, decayed double")
    export = vw.export_upcoming(table, *none, D(2024, 1, 20))
    exports.write_export(export, str(tmp_path / "x"), D(2024, 1, 20))
    header = spark.read.json(str(tmp_path / "x/header")).first()
    assert header["count"] == spark.read.json(str(tmp_path / "x/events")).count() > 0
    assert len(export.columns) == 13


def test_filters_show_hidden(table):
    assert fl.apply_filters(table, Filters(show_hidden=True)).count() == table.count()


def test_price_amounts(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["25.0", "59.50", "100", "10.05", "0.0", None])], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(payloads._amount(F.col("v"))).collect()]
    assert got == ["25", "59.5", "100", "10.05", "0", "undefined"]
