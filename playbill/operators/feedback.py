"""User actions and learned preferences as append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from playbill.functions.text import parse_tags, strip, truthy

# Starter genres, each at the middle weight.
DEFAULT_GENRES = ["indie rock", "rock", "jazz", "comedy", "punk", "electronic", "hip hop", "folk"]
DEFAULT_WEIGHT = 3


def current_state(actions: DataFrame) -> DataFrame:
    """Flags per key from (seq, dedupe_key, attr, val); the last action of each
    attribute wins and never touches the other flag."""
    def last(attr: str):
        mine = F.col("attr") == attr
        value = F.max_by(F.when(mine, F.col("val")), F.when(mine, F.col("seq")))
        return F.coalesce(value == 1, F.lit(False)).alias(attr)

    return actions.groupBy("dedupe_key").agg(last("interested"), last("hidden"))


def with_state(listings: DataFrame, state: DataFrame) -> DataFrame:
    """Listings with the flags of the action log; no action means not set."""
    flags = state.select("dedupe_key", *[F.col(c).alias(f"now_{c}") for c in ("interested", "hidden")])
    return listings.drop("interested", "hidden").join(flags, "dedupe_key", "left").withColumns({
        "interested": F.coalesce("now_interested", F.lit(False)),
        "hidden": F.coalesce("now_hidden", F.lit(False))}).drop("now_interested", "now_hidden")


def clear_hidden(actions: DataFrame, at_seq: int) -> DataFrame:
    """Actions that unhide everything hidden so far; their count is the change."""
    return current_state(actions.where(F.col("seq") < at_seq)).where("hidden").select(
        F.lit(at_seq).cast("long").alias("seq"), "dedupe_key",
        F.lit("hidden").alias("attr"), F.lit(0).alias("val"))


def _signal_tags() -> Column:
    return F.array_append(parse_tags("genre_tags"), F.lower(strip(F.coalesce("artist", F.lit("")))))


def signal_rows(marks: DataFrame) -> DataFrame:
    """(tag, ts) rows of interest marks: every tag plus the artist."""
    return marks.select(F.explode(_signal_tags()).alias("tag"), "ts").where(F.col("tag") != "")


def record_signals(signals: DataFrame) -> DataFrame:
    """Signals folded to one row per tag; combines map-side, so hot tags are cheap."""
    cleaned = signals.select(F.lower(strip("tag")).alias("tag"), "ts").where(F.col("tag") != "")
    return cleaned.groupBy("tag").agg(
        F.count("*").cast("double").alias("signal_count"), F.max("ts").alias("last_signal"))


def signals_from_interest(actions: DataFrame, listings: DataFrame) -> DataFrame:
    """Signals of marks only: un-marking subtracts nothing, re-marking adds again.

    Marks are counted per listing before the join, so a listing marked by
    everybody meets its tags as one row.
    """
    marks = actions.where((F.col("attr") == "interested") & (F.col("val") == 1)).groupBy("dedupe_key").agg(
        F.count("*").cast("double").alias("signal_count"), F.max("ts").alias("last_signal"))
    found = marks.join(listings.select("dedupe_key", "genre_tags", "artist"), "dedupe_key")
    rows = found.select(F.explode(_signal_tags()).alias("tag"), "signal_count", "last_signal")
    return merge_signals(rows.where(F.col("tag") != ""))


def merge_signals(signals: DataFrame) -> DataFrame:
    """Signals added up per tag."""
    return signals.groupBy("tag").agg(
        F.sum("signal_count").alias("signal_count"), F.max("last_signal").alias("last_signal"))


def top_signals(signals: DataFrame) -> DataFrame:
    return signals.orderBy(F.desc("signal_count"), F.asc("tag"))


def parsed_weight(text: Column) -> Column:
    """Leading integer clamped to 1..5; unreadable text and zero mean 3."""
    number = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("double")
    return F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.coalesce(
        F.nullif(number, F.lit(0.0)), F.lit(float(DEFAULT_WEIGHT))))).cast("int")


def set_weights(changes: DataFrame) -> DataFrame:
    """Latest weight per genre from (seq, genre, weight text)."""
    return (changes.groupBy(F.lower(strip("genre")).alias("genre"))
            .agg(F.max_by(F.col("weight"), F.col("seq")).alias("weight"))
            .select("genre", parsed_weight(F.coalesce("weight", F.lit(""))).alias("weight")))


def weight_log(sets: DataFrame, deletions: DataFrame) -> DataFrame:
    """One change log of (seq, genre, weight, gone) from sets and deletions, each with a ``seq``."""
    return sets.select("seq", "genre", "weight", F.lit(False).alias("gone")).unionByName(
        deletions.select("seq", "genre", F.lit(None).cast("string").alias("weight"), F.lit(True).alias("gone")))


def current_weights(log: DataFrame) -> DataFrame:
    """Weight per genre after all changes: the last entry of a genre decides, so a genre set again after a deletion is back."""
    last = log.groupBy(F.lower(strip("genre")).alias("genre")).agg(
        F.max_by("weight", "seq").alias("weight"), F.max_by("gone", "seq").alias("gone"))
    return last.where(~F.col("gone")).select("genre", parsed_weight(F.coalesce("weight", F.lit(""))).alias("weight"))


def seed_weights(weights: DataFrame) -> DataFrame:
    """The table itself, or the starter genres when it is empty."""
    names = F.array(*[F.lit(g) for g in DEFAULT_GENRES])
    starters = weights.sparkSession.range(1).select(
        F.explode(names).alias("genre"), F.lit(DEFAULT_WEIGHT).alias("weight"))
    return weights.select("genre", "weight").unionByName(starters.where(~weights.exists()))


def unapplied(profiles: DataFrame, applied: DataFrame, block: int = 100_000) -> DataFrame:
    """Profiles to apply, in the order of ``seq``: those whose stamp differs from the one applied before.

    ``applied`` is the log (seq, stamp) of earlier applications; its last stamp stands before the first
    profile. A profile with the stamp of its predecessor is skipped, so each run of equal stamps is applied
    once. Predecessors are found within blocks of ``seq``; only one row a block meets in one task.
    """
    stamped = profiles.withColumns({
        "stamp": F.coalesce(truthy("generated_at"), F.lit("v1")), "block": F.floor(F.col("seq") / block)})
    ends = stamped.groupBy("block").agg(F.max_by("stamp", "seq").alias("last"))
    earlier = applied.agg(F.lit(None).cast("long").alias("block"), F.max_by("stamp", "seq").alias("last"))
    before = ends.unionByName(earlier).select(
        "block", F.lag("last").over(W.orderBy(F.asc_nulls_first("block"))).alias("before_block")).where("block IS NOT NULL")
    within = stamped.withColumn("before", F.lag("stamp").over(W.partitionBy("block").orderBy("seq")))
    placed = within.join(before, "block")
    return placed.where(~F.col("stamp").eqNullSafe(F.coalesce("before", "before_block"))).drop("block", "before", "before_block")


def profile_weights(profiles: DataFrame) -> DataFrame:
    """Genre weights of taste profiles; a later entry of a genre wins."""
    rows = profiles.select("seq", F.posexplode("genres").alias("pos", "g")).where(
        F.coalesce(F.col("g.genre"), F.lit("")) != "")
    return (rows.groupBy(F.lower(strip(F.col("g.genre"))).alias("genre"))
            .agg(F.max_by(F.coalesce(F.col("g.weight"), F.lit("3")), F.struct("seq", "pos")).alias("weight"))
            .select("genre", parsed_weight(F.col("weight")).alias("weight")))


def profile_signals(profiles: DataFrame, at: Column) -> DataFrame:
    """Each artist counts as ``weight`` signals, at least one.

    Summing the weight equals repeating the row, without writing the copies.
    """
    rows = profiles.select(F.explode("artists").alias("a"))
    number = F.regexp_extract(F.coalesce(F.col("a.weight"), F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("double")
    times = F.greatest(F.lit(1.0), F.coalesce(F.nullif(number, F.lit(0.0)), F.lit(1.0)))
    named = rows.select(F.lower(strip(F.col("a.name"))).alias("tag"), times.alias("times")).where(F.col("tag") != "")
    return named.groupBy("tag").agg(F.sum("times").alias("signal_count")).withColumn("last_signal", at)
