"""Queries over scores, views, feedback and the run log."""

from __future__ import annotations

from pyspark.sql import functions as F

from playbill.functions import text
from playbill.operators import feedback as fb
from playbill.operators import runs as rn
from playbill.operators import scoring as sc
from playbill.operators import views as vw
from playbill.operators.filters import Filters, apply_filters, count_listings, deep_page, relevance_order
from playbill.operators.matching import match_pairs
from playbill.plans.registry import query
from playbill.plans.tables import (
    ACTIONS, AS_OF, LISTINGS, NOW, RUN_LOG, SHOWS, SIGNALS, WEIGHTS, actions, listings, marks, ntz, read, run_log,
    shows, signals, weights,
)
from playbill.schema import CURATED, TASTE_PROFILE

NOW_SQL = f"TIMESTAMP '{NOW:%Y-%m-%d %H:%M:%S}'"

DECAYED = SIGNALS + f""", decayed AS (
  SELECT tag, signal_count / greatest(1.0, epoch_us({NOW_SQL} - last_signal) / 1e6 / 604800) AS decayed FROM signals)"""

# Tags and artist of each distinct combination, and what each of them matches.
HITS = DECAYED + ", " + WEIGHTS + """, looks AS (
  SELECT DISTINCT genre_tags, coalesce(artist, '') AS artist FROM listings), tokens AS (
  SELECT genre_tags, artist, unnest(string_split(genre_tags, ', ')) AS token, true AS from_tags FROM looks
  UNION ALL SELECT genre_tags, artist, lower(artist), false FROM looks WHERE artist <> ''), hits AS (
  SELECT genre_tags, artist, genre AS key, max(weight) AS base, 0.0 AS boost FROM tokens JOIN weights
    ON from_tags AND (contains(token, genre) OR contains(genre, token)) GROUP BY ALL
  UNION ALL SELECT genre_tags, artist, tag AS key, 0.0, max(decayed) FROM tokens JOIN decayed
    ON contains(token, tag) OR contains(tag, token) GROUP BY genre_tags, artist, tag), totals AS (
  SELECT genre_tags, artist, sum(base) AS base, sum(boost) AS boost FROM hits GROUP BY genre_tags, artist), scored AS (
  SELECT l.*, coalesce(t.base, 0) AS base, coalesce(t.boost, 0) AS boost, 
    coalesce(t.base, 0) + coalesce(t.boost, 0) AS score
  FROM listings l LEFT JOIN totals t ON t.genre_tags = l.genre_tags AND t.artist = coalesce(l.artist, ''))"""


def _decayed(spark, d):
    return sc.decay_signals(signals(spark, d), NOW)


def _rounded(df):
    return df.withColumns({c: F.round(c, 4) for c in ("base", "boost", "score") if c in df.columns})


# ── matching and scoring ───────────────────────────────────────────────────

@query("token_match", """SELECT c.c_custkey, k.n_nationkey FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN nation k ON contains(n.n_name, k.n_name) OR contains(k.n_name, n.n_name)""")
def _(spark, d):
    """Nations whose whole name contains, or is contained in, that of a customer's nation."""
    nations = read(spark, d, "nation")
    homes = read(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("n_name").alias("token"))
    names = nations.select("n_nationkey", F.col("n_name").alias("key"))
    pairs = match_pairs(homes.select("token"), names.select("key"))
    return homes.join(pairs, "token").join(names, "key").select("c_custkey", "n_nationkey")


@query("token_match_names", """SELECT DISTINCT lower(a.p_name) AS token, w.word AS key FROM part a JOIN (
    SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part
    UNION SELECT DISTINCT lower(p_name) || ' tour' FROM part) w
  ON contains(lower(a.p_name), w.word) OR contains(w.word, lower(a.p_name))""")
def _(spark, d):
    names = read(spark, d, "part").select(F.lower("p_name").alias("token")).distinct()
    words = read(spark, d, "part").select(F.explode(F.array_append(
        F.split("p_name", " "), F.concat(F.lower("p_name"), F.lit(" tour")))).alias("key")).distinct()
    return match_pairs(names, words)


@query("decay_signals", f"WITH {DECAYED} SELECT tag, round(decayed, 4) AS decayed FROM decayed")
def _(spark, d):
    return _decayed(spark, d).select("tag", F.round("decayed", 4).alias("decayed"))


@query("base_score", f"WITH {HITS} SELECT id, round(base, 4) AS base FROM scored")
def _(spark, d):
    none = signals(spark, d).where(F.lit(False)).select("tag", F.lit(0.0).alias("decayed"))
    return sc.score_listings(listings(spark, d), weights(spark, d), none).select("id", F.round("base", 4).alias("base"))


@query("boost_score", f"WITH {HITS} SELECT id, round(boost, 4) AS boost FROM scored")
def _(spark, d):
    none = weights(spark, d).where(F.lit(False))
    return sc.score_listings(listings(spark, d), none, _decayed(spark, d)).select("id", F.round("boost", 4).alias("boost"))


@query("score_listings", f"""WITH {HITS} SELECT id, round(base, 4) AS base, round(boost, 4) AS boost,
  round(score, 4) AS score FROM scored""")
def _(spark, d):
    scored = sc.score_listings(listings(spark, d), weights(spark, d), _decayed(spark, d))
    return _rounded(scored.select("id", "base", "boost", "score"))


@query("match_explain", f"""WITH {HITS} SELECT genre_tags, artist, key, round(sum(base), 4) AS base,
  round(sum(boost), 4) AS boost FROM hits GROUP BY genre_tags, artist, key""")
def _(spark, d):
    looks = listings(spark, d).select("genre_tags", F.coalesce("artist", F.lit("")).alias("artist")).distinct()
    return _rounded(sc.match_explain(looks, weights(spark, d), _decayed(spark, d)))


RANK_SQL = "round(score, 4) DESC, event_date NULLS FIRST, event_time NULLS FIRST, id"


@query("rank_listings", f"WITH {HITS} SELECT id, event_date, event_time, round(score, 4) AS score FROM scored WHERE NOT hidden ORDER BY {RANK_SQL}")
def _(spark, d):
    scored = sc.score_listings(apply_filters(listings(spark, d), Filters()), weights(spark, d), _decayed(spark, d))
    return _rounded(scored).orderBy(*relevance_order()).select("id", "event_date", "event_time", "score")


@query("sort_relevance", f"""WITH {HITS} SELECT id, event_date, round(score, 4) AS score FROM scored
  WHERE NOT hidden AND category = 'music' ORDER BY {RANK_SQL} LIMIT 50 OFFSET 50""")
def _(spark, d):
    scored = sc.score_listings(
        apply_filters(listings(spark, d), Filters(category="music")), weights(spark, d), _decayed(spark, d))
    return _rounded(scored).orderBy(*relevance_order()).offset(50).limit(50).select("id", "event_date", "score")


# ── scored pages ───────────────────────────────────────────────────────────

PAGE = ["id", "title", "venue", "event_date", "event_time"]
PAGED = f"WITH {HITS} SELECT {', '.join(PAGE)}, round(score, 4) AS score FROM scored WHERE NOT hidden"
DATE_SQL = "event_date NULLS FIRST, event_time NULLS FIRST, id"


def _shown(spark, d):
    return apply_filters(listings(spark, d), Filters())


def _scorer(spark, d):
    return sc.scorer(weights(spark, d), _decayed(spark, d))


@query("page_listings", f"{PAGED} ORDER BY {DATE_SQL} LIMIT 50 OFFSET 100")
def _(spark, d):
    return vw.scored_page(_shown(spark, d), _scorer(spark, d), "nonsense", 3).select(*PAGE, "score")


@query("page_deep", f"""WITH {HITS}, numbered AS (
    SELECT *, row_number() OVER (ORDER BY {DATE_SQL}) - 1 AS place, count(*) OVER () // 20 AS half FROM scored WHERE NOT hidden)
  SELECT {', '.join(PAGE)}, round(score, 4) AS score FROM numbered WHERE place BETWEEN half // 2 * 20 AND half // 2 * 20 + 19""")
def _(spark, d):
    """The page of 20 in the middle of all."""
    shown = _shown(spark, d)
    middle = count_listings(shown).first()[0] // 20 // 2
    return _scorer(spark, d)(deep_page(shown, middle + 1, 20, near=100), few=True).select(*PAGE, "score")


@query("page_relevance", f"{PAGED} ORDER BY {RANK_SQL} LIMIT 50 OFFSET 50")
def _(spark, d):
    return vw.scored_page(_shown(spark, d), _scorer(spark, d), "relevance", 2).select(*PAGE, "score")


@query("page_after_venue", f"""{PAGED} AND (lower(venue), event_date, id) > ('nation_12', DATE '2024-01-12', 100)
  ORDER BY lower(venue), event_date, id LIMIT 50""")
def _(spark, d):
    last = ("Nation_12", AS_OF.replace(day=12), 100)
    return vw.scored_page_after(_shown(spark, d), _scorer(spark, d), last, sort="venue").select(*PAGE, "score")


@query("page_after_relevance", f"{PAGED} ORDER BY {RANK_SQL} LIMIT 50 OFFSET 50")
def _(spark, d):
    """The second page, from the key of the first page's last row."""
    shown, score = _shown(spark, d), _scorer(spark, d)
    row = vw.scored_page(shown, score, "relevance", 1).select(*PAGE, "score").collect()[-1]
    last = (row["score"], row["event_date"], row["event_time"], row["id"])
    return vw.scored_page_after(shown, score, last, sort="relevance").select(*PAGE, "score")


# ── views ──────────────────────────────────────────────────────────────────

DAY = f"DATE '{AS_OF}'"
PICK = ["id", "title", "venue", "event_date", "event_time"]
PICK_SQL = ", ".join(PICK)


@query("view_tonight", f"WITH {HITS} SELECT {PICK_SQL}, round(score, 4) AS score FROM scored WHERE event_date = {DAY} AND NOT hidden")
def _(spark, d):
    return _rounded(vw.tonight(listings(spark, d), weights(spark, d), _decayed(spark, d), AS_OF)).select(*PICK, "score")


TOP_SQL = f"""WITH {HITS} SELECT {PICK_SQL}, round(score, 4) AS score FROM scored
  WHERE event_date BETWEEN {DAY} AND {DAY} + 30 AND NOT hidden ORDER BY {RANK_SQL}"""


@query("view_top_picks", TOP_SQL + " LIMIT 50")
def _(spark, d):
    return _rounded(vw.top_picks(listings(spark, d), weights(spark, d), _decayed(spark, d), AS_OF)).select(*PICK, "score")


@query("top_k", TOP_SQL.replace("AND NOT hidden", "AND NOT hidden AND city = 'ASIA'") + " LIMIT 100")
def _(spark, d):
    picks = vw.top_picks(listings(spark, d), weights(spark, d), _decayed(spark, d), AS_OF, Filters(city="ASIA"), limit=500)
    return _rounded(picks).select(*PICK, "score")


@query("view_week", f"""WITH {HITS}, week AS (
    SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-14', INTERVAL 1 DAY)) AS DATE) AS event_date)
  SELECT w.event_date, strftime(w.event_date, '%A, %b %-d') AS label, l.id, l.title, l.event_time, round(l.score, 4) AS score
  FROM week w LEFT JOIN scored l ON l.event_date = w.event_date AND NOT l.hidden""")
def _(spark, d):
    return vw.week_days(listings(spark, d), AS_OF, score=_scorer(spark, d)).select("event_date", "label", "id", "title", "event_time", "score")


@query("view_week_counts", f"""WITH {LISTINGS}, week AS (
    SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-29', TIMESTAMP '2024-02-04', INTERVAL 1 DAY)) AS DATE) AS event_date)
  SELECT w.event_date, strftime(w.event_date, '%A, %b %-d') AS label, count(l.id) AS n
  FROM week w LEFT JOIN listings l ON l.event_date = w.event_date AND NOT l.hidden GROUP BY ALL""")
def _(spark, d):
    """The week at the end of the data: four of its days are empty."""
    return vw.week_counts(listings(spark, d), AS_OF.replace(month=1, day=31))


def _curated_lists(spark, d):
    """One curated list per order; its lines name listings with a reason."""
    orders = read(spark, d, "orders")
    entry = [F.struct((F.col("o_custkey") * n).alias("id"), F.when(F.col("o_orderkey") % 3 != n, F.col("o_orderpriority")).alias("reason"))
             for n in (0, 1, 2, 7)]
    document = F.to_json(F.struct(F.lit("loud").alias("criteria"), F.array(*entry).alias("events")))
    return orders.select(F.col("o_orderkey").alias("doc_id"), F.from_json(document, CURATED).alias("doc")).select(
        "doc_id", "doc.events")


@query("view_curated", f"""WITH {HITS}, wanted AS (
    SELECT o_orderkey AS doc_id, unnest([0, 1, 2, 3]) AS pos, unnest([0, 1, 2, 7]) AS n, o_custkey, o_orderpriority FROM orders)
  SELECT doc_id, CAST(pos AS INTEGER) AS pos, id, title, CASE WHEN doc_id % 3 <> n THEN o_orderpriority END AS reason,
    round(score, 4) AS score
  FROM wanted JOIN scored ON id = o_custkey * n WHERE NOT hidden""")
def _(spark, d):
    return vw.curated(listings(spark, d), _curated_lists(spark, d), _scorer(spark, d)).select("doc_id", "pos", "id", "title", "reason", "score")


@query("view_month", f"""WITH {LISTINGS} SELECT event_date, count(*) AS n FROM listings
  WHERE event_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' AND NOT hidden GROUP BY event_date""")
def _(spark, d):
    return vw.month_counts(listings(spark, d), "2024-01", AS_OF)


@query("view_month_listings", f"""WITH {HITS} SELECT id, title, event_date, round(score, 4) AS score FROM scored
  WHERE event_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' AND NOT hidden AND category = 'comedy'""")
def _(spark, d):
    comedy = vw.month_listings(listings(spark, d), "bad", AS_OF, Filters(category="comedy"), _scorer(spark, d))
    return comedy.select("id", "title", "event_date", "score")


@query("month_grid", f"""WITH {LISTINGS}, days AS (
    SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS event_date)
  SELECT CAST(day(event_date) AS INTEGER) AS cell, event_date, CAST(day(event_date) AS INTEGER) AS day, count(id) AS n,
    event_date = {DAY} AS selected
  FROM days LEFT JOIN (SELECT id, event_date FROM listings WHERE NOT hidden) USING (event_date) GROUP BY event_date""")
def _(spark, d):
    return vw.month_grid(listings(spark, d), "2024-01", AS_OF)


@query("export_upcoming", f"""WITH {HITS} SELECT id, title, artist, venue, city, event_date AS date, event_time AS time, category,
  genre_tags, price_range, ticket_url, interested, round(score, 2) AS score FROM scored WHERE event_date >= {DAY} AND NOT hidden""")
def _(spark, d):
    return vw.export_upcoming(listings(spark, d), weights(spark, d), _decayed(spark, d), AS_OF)


@query("export_header", f"""WITH {LISTINGS} SELECT '{AS_OF}' AS generated_at, count(*) AS count FROM listings
  WHERE event_date >= {DAY} AND NOT hidden""")
def _(spark, d):
    upcoming = vw.export_upcoming(listings(spark, d), weights(spark, d), _decayed(spark, d), AS_OF)
    return vw.export_header(upcoming, AS_OF)


# ── feedback ───────────────────────────────────────────────────────────────

@query("current_state", f"WITH {ACTIONS} SELECT * FROM state")
def _(spark, d):
    return fb.current_state(actions(spark, d))


@query("clear_hidden", f"WITH {ACTIONS} SELECT dedupe_key, 'hidden' AS attr, 0 AS val FROM state WHERE hidden")
def _(spark, d):
    return fb.clear_hidden(actions(spark, d), 2**60).drop("seq")


@query("clear_hidden_count", f"WITH {ACTIONS} SELECT count(*) AS changed FROM state WHERE hidden")
def _(spark, d):
    return fb.clear_hidden(actions(spark, d), 2**60).agg(F.count("*").alias("changed"))


SIGNAL_SQL = "tag, signal_count, strftime(last_signal, '%Y-%m-%d %H:%M:%S') AS last_signal"


def _signal_text(df):
    return df.withColumn("last_signal", F.date_format("last_signal", "yyyy-MM-dd HH:mm:ss"))


@query("record_signals", f"WITH {SIGNALS} SELECT {SIGNAL_SQL} FROM signals")
def _(spark, d):
    return _signal_text(fb.record_signals(fb.signal_rows(marks(spark, d))))


@query("signals_from_interest", f"""WITH {ACTIONS}, looks AS (
    SELECT dedupe_key, max(p_type) AS p_type, max(p_brand) AS artist FROM (
      SELECT p_type, p_brand, event_id AS seq FROM shows) s JOIN (
      SELECT event_id AS seq2, lower(p_name) || '|' || strftime(ts, '%Y-%m-%d') || '|' || lower(n_name) AS dedupe_key FROM shows) k
      ON s.seq = k.seq2 GROUP BY dedupe_key), marked AS (
    SELECT a.ts, l.p_type, l.artist FROM actions a JOIN looks l USING (dedupe_key) WHERE a.attr = 'interested' AND a.val = 1)
  SELECT tag, CAST(count(*) AS DOUBLE) AS signal_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_signal
  FROM (SELECT lower(p_type) AS tag, ts FROM marked UNION ALL SELECT lower(artist), ts FROM marked) GROUP BY tag""")
def _(spark, d):
    looks = shows(spark, d).select(
        text.dedupe_key("p_name", F.date_format("ts", "yyyy-MM-dd"), "n_name").alias("dedupe_key"), "p_type", "p_brand")
    stored = looks.groupBy("dedupe_key").agg(F.max("p_type").alias("genre_tags"), F.max("p_brand").alias("artist"))
    return _signal_text(fb.signals_from_interest(actions(spark, d), stored))


@query("top_signals", f"WITH {SIGNALS} SELECT {SIGNAL_SQL} FROM signals ORDER BY signal_count DESC, tag")
def _(spark, d):
    return _signal_text(fb.top_signals(signals(spark, d)))


def _weight_changes(spark, d):
    """Weight edits from customers: padded, mixed case, fractional and unreadable."""
    number = F.col("c_custkey")
    return read(spark, d, "customer").select(
        number.alias("seq"), F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" "), (number % 50).cast("string")).alias("genre"),
        F.when(number % 7 == 0, "loud").when(number % 7 == 1, "0").when(number % 7 == 2, "4abc")
        .otherwise(F.col("c_acctbal").cast("decimal(20,2)").cast("string")).alias("weight"))


CHANGES = """changes AS (
  SELECT c_custkey AS seq, lower(trim('  ' || c_mktsegment || ' ' || (c_custkey % 50))) AS genre,
    CASE c_custkey % 7 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE
      greatest(1, least(5, coalesce(nullif(trunc(c_acctbal), 0), 3))) END AS weight FROM customer), edited AS (
  SELECT genre, CAST(max_by(weight, seq) AS INTEGER) AS weight FROM changes GROUP BY genre)"""


@query("set_weights", f"WITH {CHANGES} SELECT genre, weight FROM edited")
def _(spark, d):
    return fb.set_weights(_weight_changes(spark, d))


@query("delete_weight", f"""WITH {CHANGES}, log AS (
    SELECT 2 * seq AS seq, genre, CAST(weight AS INTEGER) AS weight FROM changes
    UNION ALL SELECT 2 * s_suppkey * 13 + 1, segment || ' ' || (s_suppkey % 50), 0 FROM supplier,
      (VALUES ('automobile'), ('building'), ('furniture'), ('household'), ('machinery')) v(segment))
  SELECT genre, max_by(weight, seq) AS weight FROM log GROUP BY genre HAVING max_by(weight, seq) > 0""")
def _(spark, d):
    """Deletions between the sets: a genre that is set again afterwards is back."""
    key = F.col("s_suppkey")
    gone = read(spark, d, "supplier").select((2 * key * 13 + 1).alias("seq"), F.explode(F.array(*[
        F.concat(F.lit(f" {s} "), (key % 50).cast("string"))
        for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])).alias("genre"))
    return fb.current_weights(fb.weight_log(_weight_changes(spark, d).withColumn("seq", 2 * F.col("seq")), gone))


@query("seed_weights", f"""WITH {CHANGES}, heavy AS (SELECT * FROM edited WHERE weight > 5)
  SELECT 'edited' AS source, genre, weight FROM edited
  UNION ALL SELECT 'empty', unnest(['indie rock', 'rock', 'jazz', 'comedy', 'punk', 'electronic', 'hip hop', 'folk']), 3
    WHERE NOT EXISTS (SELECT 1 FROM heavy)""")
def _(spark, d):
    """A filled table stays as it is; one left empty by a filter gets the starters."""
    edited = fb.set_weights(_weight_changes(spark, d))
    filled = fb.seed_weights(edited).select(F.lit("edited").alias("source"), "genre", "weight")
    seeded = fb.seed_weights(edited.where("weight > 5")).select(F.lit("empty").alias("source"), "genre", "weight")
    return filled.unionByName(seeded)


def _profiles(spark, d):
    """One taste profile per part, as the JSON text it would be stored in."""
    number = F.col("p_partkey")
    document = F.to_json(F.struct(
        F.when(number % 4 != 0, F.concat(F.lit("v"), (F.floor(number / 3) % 3).cast("string"))).alias("generated_at"),
        F.array(F.struct(F.col("p_type").alias("genre"), F.col("p_size").alias("weight")),
                F.struct(F.col("p_name").alias("genre"), F.lit(None).cast("int").alias("weight"))).alias("genres"),
        F.array(F.struct(F.col("p_brand").alias("name"), (F.col("p_size") % 6).alias("weight"))).alias("artists")))
    return read(spark, d, "part").select(number.alias("seq"), F.from_json(document, TASTE_PROFILE).alias("p")).select("seq", "p.*")


def _applied(spark, d):
    """Stamps applied before, one for each region; the last of them counts."""
    return read(spark, d, "region").select(
        F.col("r_regionkey").cast("long").alias("seq"), F.concat(F.lit("v"), (F.col("r_regionkey") % 3).cast("string")).alias("stamp"))


FRESH = """fresh AS (
    SELECT *, CASE WHEN p_partkey % 4 <> 0 THEN 'v' || (p_partkey // 3 % 3) ELSE 'v1' END AS stamp FROM part
    QUALIFY stamp <> lag(stamp, 1, (SELECT 'v' || (max(r_regionkey) % 3) FROM region)) OVER (ORDER BY p_partkey))"""


@query("apply_taste_profile", f"""WITH {FRESH}, named AS (
    SELECT p_partkey AS seq, 0 AS pos, lower(p_type) AS genre, greatest(1, least(5, p_size)) AS weight FROM fresh
    UNION ALL SELECT p_partkey, 1, lower(p_name), 3 FROM fresh)
  SELECT 'weight' AS layer, genre AS name, CAST(max_by(weight, (seq, pos)) AS DOUBLE) AS value FROM named GROUP BY genre
  UNION ALL SELECT 'signal', lower(p_brand), CAST(sum(greatest(1, p_size % 6)) AS DOUBLE) FROM fresh GROUP BY lower(p_brand)""")
def _(spark, d):
    todo = fb.unapplied(_profiles(spark, d), _applied(spark, d), block=1000)
    layer1 = fb.profile_weights(todo).select(
        F.lit("weight").alias("layer"), F.col("genre").alias("name"), F.col("weight").cast("double").alias("value"))
    layer2 = fb.profile_signals(todo, ntz("2024-01-01 00:00:00")).select(
        F.lit("signal").alias("layer"), F.col("tag").alias("name"), F.col("signal_count").alias("value"))
    return layer1.unionByName(layer2)


# ── run log ────────────────────────────────────────────────────────────────

LOG = "run_id, source, source_name, status, events_found, events_added, error_msg, strftime(run_at, '%Y-%m-%d %H:%M:%S') AS run_at"
LATEST = RUN_LOG + """, latest AS (
  SELECT * FROM run_log QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY run_id DESC) = 1)"""


def _log_text(df):
    return df.withColumn("run_at", F.date_format("run_at", "yyyy-MM-dd HH:mm:ss"))


@query("run_log_append", f"""WITH {RUN_LOG} SELECT {LOG.replace('source_name,', "CASE WHEN run_id % 5 = 0 THEN source ELSE source_name END AS source_name,")
       .replace('events_added,', 'CASE WHEN status = $$ok$$ THEN events_added ELSE 0 END AS events_added,')} FROM run_log""")
def _(spark, d):
    bare = run_log(spark, d).withColumns({
        "source_name": F.when(F.col("run_id") % 5 != 0, F.col("source_name")),
        "events_added": F.when(F.col("status") == "ok", F.col("events_added"))})
    return _log_text(rn.log_rows(bare))


@query("latest_run_per_source", f"WITH {LATEST} SELECT {LOG} FROM latest")
def _(spark, d):
    return _log_text(rn.latest_run_per_source(run_log(spark, d)))


@query("recent_logs", f"WITH {RUN_LOG} SELECT {LOG} FROM run_log ORDER BY run_id DESC LIMIT 200")
def _(spark, d):
    return _log_text(rn.recent_logs(run_log(spark, d), 1000))


@query("status_summary", f"""WITH {LATEST}, {SHOWS} SELECT (SELECT count(*) FROM shows) AS total,
  strftime(max(run_at), '%Y-%m-%d %H:%M:%S') AS last_run_at FROM latest""")
def _(spark, d):
    return rn.status_summary(listings(spark, d), run_log(spark, d)).withColumn(
        "last_run_at", F.date_format("last_run_at", "yyyy-MM-dd HH:mm:ss"))


@query("run_totals", f"""WITH {RUN_LOG} SELECT source, grouping(source) = 1 AS is_total, CAST(sum(events_added) AS BIGINT) AS added,
  count(*) FILTER (status = 'error') AS errors FROM run_log GROUP BY ROLLUP (source)""")
def _(spark, d):
    return rn.run_totals(run_log(spark, d))


@query("health_flag", f"""WITH {LATEST} SELECT CASE WHEN count(*) FILTER (status = 'error') > 0 THEN 'error'
  WHEN count(*) > 0 THEN 'ok' ELSE '' END AS flag FROM latest""")
def _(spark, d):
    return rn.health_flag(run_log(spark, d))


@query("relative_time", f"""WITH {RUN_LOG}, aged AS (
    SELECT run_id, CAST(floor(epoch_us(TIMESTAMP '2024-01-30 12:00:00' - run_at) / 60e6 + 0.5) AS BIGINT) AS m FROM run_log), hours AS (
    SELECT *, CAST(floor(m / 60 + 0.5) AS BIGINT) AS h FROM aged)
  SELECT run_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN h < 24 THEN h || 'h ago'
    ELSE CAST(floor(h / 24 + 0.5) AS BIGINT) || 'd ago' END AS age FROM hours""")
def _(spark, d):
    return run_log(spark, d).select("run_id", rn.relative_time(F.col("run_at"), "2024-01-30 12:00:00").alias("age"))
