"""Two-layer preference score, computed at query time and never stored.

Layer 1 sums the weights of genres matched by any tag; layer 2 sums the decayed
interest signals matched by any tag or by the artist. Both count a key once per
listing. Listings share few distinct (tags, artist) combinations, so matching
runs over those and the score is joined back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playbill.functions.dates import AsOf, moment
from playbill.functions.text import parse_tags, strip
from playbill.operators.matching import match_few, match_pairs

WEEK_SECONDS = 7 * 24 * 60 * 60
#: Scores are added up as decimals, so that their order does not depend on the order of the additions.
EXACT = "decimal(28,8)"


def decay_signals(signals: DataFrame, as_of: AsOf) -> DataFrame:
    """``signal_count`` over the weeks since the last signal, at least one.

    A missing time means no decay.
    """
    seconds = F.unix_micros(moment(as_of).cast("timestamp")) - F.unix_micros(F.col("last_signal").cast("timestamp"))
    weeks = F.coalesce(seconds / 1e6 / WEEK_SECONDS, F.lit(0.0))
    return signals.select("tag", (F.col("signal_count") / F.greatest(F.lit(1.0), weeks)).alias("decayed"))


def _tokens(looks: DataFrame) -> DataFrame:
    """(genre_tags, artist, token, from_tags), each token once per combination."""
    name = F.lower(strip(F.coalesce("artist", F.lit(""))))
    parsed = looks.select("genre_tags", "artist", F.array_distinct(parse_tags("genre_tags")).alias("tags"),
                          name.alias("name"))
    # The artist is a token of its own unless a tag already spells it.
    extra = F.array_except(F.array("name"), F.array_append("tags", F.lit("")))
    labelled = F.concat(
        F.transform("tags", lambda t: F.struct(t.alias("token"), F.lit(True).alias("from_tags"))),
        F.transform(extra, lambda t: F.struct(t.alias("token"), F.lit(False).alias("from_tags"))))
    return parsed.select("genre_tags", "artist", F.explode(labelled).alias("t")).select(
        "genre_tags", "artist", "t.*")


def match_explain(looks: DataFrame, weights: DataFrame, decayed: DataFrame, few: bool = False) -> DataFrame:
    """(genre_tags, artist, key, base, boost): what each combination matched. ``few`` says that there are few combinations."""
    # A word may be a weighted genre and a signal tag; its two rows meet again below.
    keys = weights.select(F.col("genre").alias("key"), F.col("weight").cast("double").alias("weight"),
                          F.lit(None).cast("double").alias("decayed")).unionByName(
        decayed.select(F.col("tag").alias("key"), F.lit(None).cast("double").alias("weight"), "decayed"))
    tokens = _tokens(looks)
    match = match_few if few else match_pairs
    pairs = match(tokens.select("token"), keys.select("key")).join(keys, "key")
    hits = tokens.join(pairs, "token").where(F.col("from_tags") | F.col("decayed").isNotNull())
    return (hits.groupBy("genre_tags", "artist", "key")
            .agg(F.coalesce(F.max(F.when(F.col("from_tags"), F.col("weight"))), F.lit(0.0)).alias("base"),
                 F.coalesce(F.max("decayed"), F.lit(0.0)).alias("boost")))


def _looks(listings: DataFrame) -> DataFrame:
    return listings.select(
        F.coalesce("genre_tags", F.lit("")).alias("genre_tags"),
        F.coalesce("artist", F.lit("")).alias("artist")).distinct()


def scorer(weights: DataFrame, decayed: DataFrame) -> Callable[..., DataFrame]:
    """``score_listings`` with its preferences filled in, as views and pages take it."""
    return lambda listings, few=False: score_listings(listings, weights, decayed, few)


def score_listings(listings: DataFrame, weights: DataFrame, decayed: DataFrame, few: bool = False) -> DataFrame:
    """Add base, boost and score; unmatched listings get 0. ``few`` is for listings of a bounded number, such as a page.

    The final join is keyed on the combination. It is unhinted, so a small score
    table is broadcast and a large one is sort-merged, where adaptive execution
    splits a combination shared by very many listings. What each combination
    matched stays available as rows, from ``match_explain``.
    """
    hits = match_explain(_looks(listings), weights, decayed, few)
    scores = hits.groupBy(F.col("genre_tags").alias("look_tags"), F.col("artist").alias("look_artist")).agg(
        *[F.sum(F.col(c).cast(EXACT)).cast("double").alias(c) for c in ("base", "boost")])
    on = ((F.coalesce(listings["genre_tags"], F.lit("")) == scores["look_tags"])
          & (F.coalesce(listings["artist"], F.lit("")) == scores["look_artist"]))
    zero = F.lit(0.0)
    out = listings.join(scores, on, "left").drop("look_tags", "look_artist")
    parts = {"base": F.coalesce("base", zero), "boost": F.coalesce("boost", zero)}
    return out.withColumns(parts).withColumn("score", F.round(F.col("base") + F.col("boost"), 4))
