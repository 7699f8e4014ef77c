"""Quality rules as a short-circuit cascade of column expressions.

Every rule is a condition that rejects a text. Work and selectivity of each are
counted on a bounded sample, and the rules run in order of rejections per work;
a CASE expression stops at the first that holds. The order never changes which
documents are rejected, only how much work it takes and which rule is named.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playbill.functions.text import let, project_where
from playbill.llm.storage import clean_columns

SPACE = r"[ \t-\r]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
PARTS = ["_words", "_lines"]
WINDOW = 5
SAMPLE_ROWS = 256
SAMPLE_CHARS = 4_000_000


def text_of(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def words_of(c: str = "text") -> Column:
    """Only the ends can give empty pieces, so they are trimmed first."""
    body = F.btrim(text_of(c), F.lit(SPACES))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE))


def wordy_lines(c: str = "text") -> Column:
    return F.filter(F.split(text_of(c), "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")


def _join(words: Column, i: Column) -> Column:
    return F.concat_ws(" ", *[F.get(words, i + j) for j in range(WINDOW)])


def _covered(words: Column, n: Column) -> Column:
    """Words in repeated windows: sort the windows, keep those equal to a neighbour, add up what each covers."""
    rows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.struct(_join(words, i).alias("w"), i.alias("p")))

    def repeated(s: Column) -> Column:
        same = lambda x, j: F.coalesce(x["w"] == F.get(s, j)["w"], F.lit(False))
        return F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["p"])

    zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(F.array_sort(let(F.array_sort(rows), repeated)), zero, lambda a, p: F.struct(
        (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])


def _repeat_words(words: Column) -> Column:
    """Distinct window hashes prove that nothing repeats; only other texts compare the windows themselves."""
    n = F.size(words)

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(words, n))

    return F.when(n < WINDOW, 0).otherwise(let(let(F.transform(words, lambda w: F.xxhash64(w)), hashes), count))


def measure(name: str) -> Column:
    """A base measure as an expression over ``text``, ``_words`` and ``_lines``."""
    made = {
        "n_words": lambda: F.size("_words"),
        "word_chars": lambda: F.char_length(F.array_join("_words", "")),
        "n_symbols": lambda: F.regexp_count(text_of(), F.lit(SYMBOLS)),
        "n_dup_lines": lambda: F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": lambda: let(F.col("_words"), _repeat_words),
    }
    return made[name]().cast("bigint")


def with_parts(docs: DataFrame) -> DataFrame:
    """The input with ``_words`` and ``_lines``; its columns that have their or a measure's name are dropped."""
    return docs.select(*clean_columns(docs, [*MEASURES, *PARTS]), words_of().alias("_words"), wordy_lines().alias("_lines"))


def with_measures(docs: DataFrame) -> DataFrame:
    """The input with the base measures, and ``_words`` and ``_lines`` for the rules; input columns of their names are dropped.

    A null or empty text has no words and all measures 0. Words are whole, whatever the
    length of the text; everything happens inside the row, so nothing is shuffled.
    """
    split = with_parts(docs)
    return split.select(*split.columns, *[measure(name).alias(name) for name in MEASURES])


#: Gives the column of a measure: a stored one (``F.col``) or its expression (``measure``).
Measured = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    """``rejects`` makes the condition under which a document goes, ``work`` what it costs to test one, its measures included.

    Work is counted in characters passed through a pattern; see ``PER_WORD`` and its like for the rest.
    """

    name: str
    rejects: Callable[[Measured], Column]
    work: Callable[[], Column]


def _upper() -> Column:
    return F.length(text_of()) - F.length(F.regexp_replace(text_of(), r"\p{Lu}+", ""))


def _stutter(_: Measured) -> Column:
    """10 * words equal to the one before > 3 * words."""
    return let(F.col("_words"), lambda w: 10 * F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))) > 3 * F.size(w))


def _share(pattern: str, tenths: int) -> Callable[[Measured], Column]:
    """More than so many tenths of the lines with a word match."""
    return lambda _: 10 * F.size(F.filter("_lines", lambda x: F.regexp_like(x, F.lit(pattern)))) > tenths * F.size("_lines")


# Work of a word that is joined, of one that a lambda visits, of one whose window is hashed, of a line, and of a plain comparison,
# in characters passed through a pattern (8 ns); rounded from the times of each rule alone over 168 million characters.
PER_JOINED, PER_WORD, PER_WINDOW, PER_LINE, PER_TEST = 3, 2, 70, 50, 1


def _chars() -> Column:
    return F.char_length(text_of())


def _words(each: int) -> Callable[[], Column]:
    return lambda: F.size("_words") * each


def _lines() -> Column:
    return F.size("_lines") * PER_LINE


#: Over the base measures. They are chosen to hold for natural prose of any language.
RULES = [
    Rule("few_words", lambda m: m("n_words") < 10, lambda: F.lit(PER_TEST)),
    Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > 20 * m("n_words"), _words(PER_WINDOW)),
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words"), _chars),
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 25 * m("n_words")), _words(PER_JOINED)),
    Rule("capitals", lambda m: 2 * _upper() > m("word_chars"), lambda: _chars() + _words(PER_JOINED)()),
    Rule("stutter", _stutter, _words(PER_WORD)),
    Rule("duplicate_lines", lambda m: 2 * m("n_dup_lines") > F.size("_lines"), _lines),
    Rule("ellipsis_lines", _share(r"(\.\.\.|…)[ \t-\r]*$", 3), lambda: 2 * _chars() + _lines()),
    Rule("bullet_lines", _share(r"^[ \t-\r]*[•‣*-][ \t]", 9), _lines),
]
BASE = RULES[:2]


def sample_of(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """At most ``sample_rows`` whole texts, those with the smallest hash of ``doc_id`` (of the text where there is none).

    Rows of one hash count once, with their least text. Texts in order of the hash go in while they have ``sample_chars``
    characters together; the first always does. The number of rows tells below which hash about eight times as many rows lie as are wanted,
    so what leaves the scan does not grow with the table, and nothing passes the driver.
    """
    key = "doc_id" if "doc_id" in docs.columns else "text"
    share = 8 * sample_rows / max(docs.count(), 1)
    hashed = docs.select("text", F.xxhash64(key).alias("h"))
    if share < 1:
        hashed = hashed.where(F.col("h") < int(-(2**63) + share * 2**64))
    least = hashed.groupBy("h").agg(F.min("text").alias("text")).orderBy("h").limit(sample_rows)
    so_far = F.sum(F.char_length(text_of())).over(Window.orderBy("h", "text").rowsBetween(Window.unboundedPreceding, 0))
    first = F.row_number().over(Window.orderBy("h", "text")) == 1
    return least.select("text", (first | (so_far <= sample_chars)).alias("in")).where("in").select("text")


def estimate(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, rejected share, work a row) on the first ``sample_rows`` documents it is given, all rules in one job.

    Of a large table give it ``sample_of`` the table. Work is counted, not timed, so the same documents always give the
    same order. It only decides the order of the rules. An empty sample gives 0 for both.
    """
    measured = with_measures(docs.select("text").limit(sample_rows))
    figures = [f for r in rules for f in (F.avg(F.coalesce(r.rejects(F.col), F.lit(False)).cast("double")), F.avg(r.work().cast("double")))]
    found = [x or 0.0 for x in measured.agg(*[f.alias(f"f{i}") for i, f in enumerate(figures)]).first()]
    return [(r.name, found[2 * i], found[2 * i + 1]) for i, r in enumerate(rules)]


def order(rules: list[Rule], estimates: list[tuple[str, float, float]]) -> list[Rule]:
    """Most rejections per work first; of rules that reject nothing in the sample, those of less work; ties stay in the given order."""
    told = {name: (-share / cost if cost else 0.0, cost) for name, share, cost in estimates}
    return sorted(rules, key=lambda r: told[r.name])


def best_order(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in the order that a sample from all over the table gives."""
    return order(rules, estimate(sample_of(docs, sample_rows), rules, sample_rows))


def first_rejection(rules: list[Rule], measured: Measured = F.col) -> Column:
    """The name of the first rule that holds, else null; later rules are not evaluated. A null condition does not reject.

    With ``measured`` as ``measure``, neither are the measures that only later rules need.
    """
    name = F.when(F.lit(False), F.lit(""))
    for r in rules:
        name = name.when(r.rejects(measured), F.lit(r.name))
    return name


def cascade(measured: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``rejected_by`` (see ``first_rejection``) and ``kept``."""
    out = measured.select(*clean_columns(measured, ["rejected_by", "kept"]), first_rejection(rules).alias("rejected_by"))
    return out.withColumn("kept", F.col("rejected_by").isNull()).drop(*PARTS)


def quality_filter(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All documents with measures, ``rejected_by`` and ``kept``, the rules in their estimated best order."""
    measured = with_measures(docs)
    return cascade(measured, best_order(docs, rules, sample_rows))


def passing(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with their own columns.

    Measures are expressions inside the cascade, so a text pays for those of the rules it reaches. The verdict is tested
    inside the projection: a filter after it would be pushed below and compute it again.
    """
    ordered = best_order(docs, rules, sample_rows)
    names = docs.columns
    inside = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("text", F.col(f"c{names.index('text')}"))
    kept = project_where(with_parts(inside), [f"c{i}" for i in range(len(names))], {"rejected_by": first_rejection(ordered, measure)},
                         lambda r: r["rejected_by"].isNull())
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
