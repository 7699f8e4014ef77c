"""Schemas of the canonical tables."""

from __future__ import annotations

from pyspark.sql import types as T

# What a source adapter hands over, before validation.
RAW_LISTING = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("precedence", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("artist", T.StringType()),
    T.StructField("venue", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("time", T.StringType()),
    T.StructField("doors_time", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("genre_tags", T.StringType()),
    T.StructField("ticket_url", T.StringType()),
    T.StructField("image_url", T.StringType()),
    T.StructField("price_range", T.StringType()),
])

# Fields a later write replaces, nulls included.
MUTABLE = [
    "source", "source_name", "title", "artist", "venue", "city", "event_date",
    "event_time", "doors_time", "category", "genre_tags", "ticket_url",
    "image_url", "price_range",
]

# Fields that survive every later write.
KEPT = ["id", "created_at", "interested", "hidden"]

SELECTORS = T.StructType([
    T.StructField(name, T.StringType())
    for name in ["item", "name", "date", "ticketLink", "image", "price"]
])

REGISTRY = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("venue", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("note", T.StringType()),
    T.StructField("waitFor", T.StringType()),
    T.StructField("selectors", SELECTORS),
])

TASTE_PROFILE = T.StructType([
    T.StructField("generated_at", T.StringType()),
    T.StructField("genres", T.ArrayType(T.StructType([
        T.StructField("genre", T.StringType()), T.StructField("weight", T.StringType())]))),
    T.StructField("artists", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("weight", T.StringType())]))),
])

CURATED = T.StructType([
    T.StructField("criteria", T.StringType()),
    T.StructField("generated_at", T.StringType()),
    T.StructField("events", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("reason", T.StringType())]))),
])
