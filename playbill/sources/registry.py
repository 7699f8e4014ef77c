"""Source registry: feeds and scrapers listed in JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from playbill.functions.text import col, strip
from playbill.functions.urls import SCHEME, url_guard
from playbill.schema import REGISTRY

WEB_SCHEMES = ("http", "https")


def document_schema(kind: str) -> T.StructType:
    """Schema of a registry document; ``kind`` is 'feeds' or 'scrapers'."""
    return T.StructType([T.StructField(kind, T.ArrayType(REGISTRY))])


def enabled(documents: DataFrame, kind: str) -> DataFrame:
    """Enabled entries of parsed documents; an absent flag means enabled."""
    entries = documents.select(F.explode(kind).alias("entry")).select("entry.*")
    return entries.where(F.coalesce("enabled", F.lit(True)))


def read_registry(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Enabled entries of the document files at ``path``; none when it is missing."""
    try:
        documents = spark.read.schema(document_schema(kind)).option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        documents = spark.createDataFrame([], document_schema(kind))
    return enabled(documents, kind)


def violation(url: Column | str, item: Column | str) -> Column:
    """First rule a scraper entry breaks, or null when it can run."""
    # The messages below.
    text = F.coalesce(strip(col(url)), F.lit(""))
    scheme = F.lower(F.regexp_extract(text, SCHEME, 1))
    return (F.when(F.coalesce(col(url), F.lit("")) == "", "No url configured")
            .when(scheme == "", F.concat(F.lit('Invalid url "'), col(url), F.lit('"')))
            .when(~scheme.isin(*WEB_SCHEMES), F.concat(
                F.lit('Unsupported URL scheme "'), scheme, F.lit(':" — only http(s) is scraped')))
            .when(url_guard(url).isNull(), F.concat(F.lit('Invalid url "'), col(url), F.lit('"')))
            .when(F.coalesce(strip(col(item)), F.lit("")) == "",
                  "selectors.item is not configured — set it to the repeating per-event element"))
