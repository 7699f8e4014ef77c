"""Two-way substring matching between two vocabularies, as equi-joins.

A token matches a key when either contains the other. Comparing all of one
side with all of the other grows with the product of both vocabularies, so the
pairs are found through character grams instead:

* every text is indexed under its distinct grams of one to three characters;
* every text also picks one *anchor*: the rarest of its own three-grams, or the
  whole text when it is shorter than three characters;
* if x contains y then x holds y's anchor, so joining anchors with the index on
  the gram finds every pair, and ``contains`` removes the false ones.

Choosing the rarest gram keeps common grams from pairing large groups. Nothing
is hinted: small sides are broadcast at run time, big ones are sort-merged with
adaptive skew splitting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(text: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
    found = F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(n))))
    return F.when(F.length(text) >= n, found).otherwise(F.array().cast("array<string>"))


def match_few(tokens: DataFrame, keys: DataFrame) -> DataFrame:
    """As ``match_pairs``, for a bounded number of tokens, such as those of one page.

    No anchor is chosen by how rare it is, so no vocabulary is counted: each key is read once and meets the tokens by grams. A
    token's or key's anchor is its first gram; the other side holds it if it holds the text. At worst, with one first gram for all,
    that is a test of each key against each of the few tokens.
    """
    few = tokens.select("token").where("token <> ''").distinct()
    known = keys.select("key").where("key <> ''")
    held = few.select("token", F.explode(F.concat(*[_grams(F.col("token"), n) for n in range(1, GRAM + 1)])).alias("gram"))
    first = few.select("token", F.substring("token", 1, GRAM).alias("gram"))
    inside = known.withColumn("gram", F.substring("key", 1, GRAM)).join(held, "gram").where(F.contains("token", "key"))
    grams = known.select("key", F.explode(F.concat(*[_grams(F.col("key"), n) for n in range(1, GRAM + 1)])).alias("gram"))
    around = grams.join(first, "gram").where(F.contains("key", "token") & (F.col("key") != F.col("token")))
    return inside.select("token", "key").unionByName(around.select("token", "key")).distinct()


def match_pairs(tokens: DataFrame, keys: DataFrame) -> DataFrame:
    """Distinct (token, key) pairs that match, from columns of those names.

    Either input may repeat its texts; empty ones never match.
    """
    texts = (tokens.select(F.col("token").alias("text"), F.lit(True).alias("is_token"), F.lit(False).alias("is_key"))
             .unionByName(keys.select(F.col("key").alias("text"), F.lit(False).alias("is_token"),
                                      F.lit(True).alias("is_key")))
             .where(F.col("text") != "")
             .groupBy("text").agg(F.bool_or("is_token").alias("is_token"), F.bool_or("is_key").alias("is_key")))

    text = F.col("text")
    index = texts.select("*", F.explode(F.concat(*[_grams(text, n) for n in range(1, GRAM + 1)])).alias("gram"))

    # Texts shorter than a gram are their own anchors, so only whole grams are counted.
    own = texts.where(F.length(text) >= GRAM).select("*", F.explode(_grams(text, GRAM)).alias("gram"))
    spread = own.groupBy("gram").agg(F.count("*").alias("n"))
    anchors = (own.join(spread, "gram")
               .groupBy("text", "is_token", "is_key")
               .agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
               .unionByName(texts.where(F.length(text) < GRAM).withColumn("gram", text)))

    inner = anchors.select("gram", F.col("text").alias("y"), F.col("is_token").alias("y_token"),
                           F.col("is_key").alias("y_key"))
    outer = index.select("gram", F.col("text").alias("x"), F.col("is_token").alias("x_token"),
                         F.col("is_key").alias("x_key"))
    useful = (F.col("x_token") & F.col("y_key")) | (F.col("x_key") & F.col("y_token"))
    found = outer.join(inner, "gram").where(useful & F.contains("x", "y"))

    def pair(token: str, key: str, when: Column) -> Column:
        return F.when(when, F.struct(F.col(token).alias("token"), F.col(key).alias("key")))

    both = F.array(pair("x", "y", F.col("x_token") & F.col("y_key")),
                   pair("y", "x", F.col("x_key") & F.col("y_token")))
    return found.select(F.explode(F.array_distinct(F.array_compact(both))).alias("p")).select("p.*")
