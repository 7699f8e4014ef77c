import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from playbill.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


TEXTS = [
    None, "", " \t\n\x0b\x0c\r", "one", " a b c d e a b c d e ", "a a a a a a a", "x y\n\nx y\n x y", " a   b", "é" * 50,
    "# * $ | < > & %", "a b c d e f g h i j " * 300, "\n".join(["same line here"] * 7), "w " * 4, "\x00 \x1f a",
    " ".join(f"w{i}" for i in range(5000)) + " " + " ".join(f"w{i}" for i in range(100)),
]


def test_measures_equal_plain_python(documents):
    rows = {r["doc_id"]: tuple(r[m] for m in q.MEASURES) for r in q.with_measures(documents(enumerate(TEXTS))).collect()}
    assert rows == {i: measures(t) for i, t in enumerate(TEXTS)}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#é\x0b", max_size=60), min_size=1, max_size=40))
def test_measures_of_any_text(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r["doc_id"]: tuple(r[m] for m in q.MEASURES) for r in q.with_measures(docs).collect()}
    assert rows == {i: measures(t) for i, t in enumerate(texts)}


PROSE = "The quick brown fox jumps over the lazy dog while seven wise owls watch from a branch. "


def test_junk_goes_and_prose_stays(documents):
    junk = ["short text", PROSE * 3, "word$$$ other### " * 3 + PROSE, PROSE.upper(), "go go go go go stop stop stop now now now then then",
            "\n".join(["a line that comes back again"] * 3 + ["and one more that is different"]), "\n".join(f"read on {i} ..." for i in range(9))]
    clean = [PROSE, PROSE + "\n" + "Ein zweiter Satz, der etwas anderes sagt als der erste: viele schöne Wörter."]
    rows = {r["doc_id"]: r for r in q.quality_filter(documents(enumerate(junk + clean))).collect()}
    assert [rows[i]["kept"] for i in range(len(junk + clean))] == [False] * len(junk) + [True] * len(clean)
    assert all((rows[i]["rejected_by"] is None) == rows[i]["kept"] for i in rows)


def test_the_order_names_another_rule_but_rejects_the_same(documents):
    docs = q.with_measures(documents(enumerate([*TEXTS, PROSE, PROSE.upper()])))
    forward = {r["doc_id"]: r["kept"] for r in q.cascade(docs, q.RULES).collect()}
    backward = {r["doc_id"]: r["kept"] for r in q.cascade(docs, q.RULES[::-1]).collect()}
    assert forward == backward


def test_rules_are_ordered_by_rejections_per_cost():
    rules = q.RULES[:3]
    estimates = [(rules[0].name, 0.5, 1.0), (rules[1].name, 0.2, 0.1), (rules[2].name, 0.0, 0.001)]
    assert q.order(rules, estimates) == [rules[1], rules[0], rules[2]]


def test_estimates_come_from_a_bounded_sample(documents):
    found = q.estimate(documents([(i, PROSE if i % 2 else "x") for i in range(50)]), q.RULES, sample_rows=20)
    share = {name: s for name, s, _ in found}
    assert share["few_words"] == 0.5 and share["symbols"] == 0.0 and all(c > 0 for _, _, c in found)


def test_estimates_repeat_and_fit_the_work(documents):
    docs = documents([(i, (PROSE if i % 3 else PROSE.upper()) * (i % 7 + 1)) for i in range(300)])
    found = q.estimate(q.sample_of(docs), q.RULES)
    again = [q.estimate(q.sample_of(d), q.RULES) for d in (docs, docs.repartition(7), docs.orderBy(F.desc("doc_id")).coalesce(1))]
    assert [[(n, round(s, 9), round(c, 6)) for n, s, c in e] for e in again] == [[(n, round(s, 9), round(c, 6)) for n, s, c in found]] * 3
    by = {n: c for n, _, c in found}
    assert by["few_words"] < by["stutter"] < by["word_length"] < by["capitals"] < by["repeated_words"]
    names = [r.name for r in q.order(q.RULES, found)]
    assert names.index("capitals") < names.index("ellipsis_lines") and [r.name for r in q.order(q.RULES, again[1])] == names


def test_the_sample_is_spread_and_bounded(documents):
    docs = documents([(i, f"{i} " * 100) for i in range(400)])
    some = [int(r["text"].split()[0]) for r in q.sample_of(docs, 40).collect()]
    assert len(some) == 40 and max(some) > 200 > min(some)
    assert 1 < q.sample_of(docs, 40, 1500).count() < 8 and q.sample_of(docs, 40, 1).count() == 1
    assert q.sample_of(docs.where("false")).count() == 0 and q.sample_of(docs.select("text"), 9).count() == 9
    assert [(s, c) for _, s, c in q.estimate(docs.where("false"), q.RULES)] == [(0.0, 0.0)] * len(q.RULES)


def test_passing_computes_measures_inside_the_cascade(documents):
    plan = q.passing(documents([(1, PROSE)]))._jdf.queryExecution().optimizedPlan().toString()
    assert not any(f"{name}#" in plan for name in q.MEASURES) and "CASE WHEN" in plan


def test_clashing_columns_and_repeated_rows(documents):
    docs = documents([(1, PROSE), (1, PROSE), (None, None)]).withColumns({"KEPT": F.lit(1), "_words": F.lit(2), "n_words": F.lit("x")})
    out = q.quality_filter(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", *q.MEASURES, "rejected_by", "kept"]
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in out.collect()) == [(0, False), (1, True), (1, True)]


def test_passing_keeps_the_same_documents(documents):
    docs = documents(enumerate([*TEXTS, PROSE, PROSE.upper()])).withColumns({"N_Words": F.lit(5), "kept": F.lit("x")})
    kept = {r["doc_id"] for r in q.quality_filter(docs).where("kept").collect()}
    out = q.passing(docs)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == kept != set()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan.replace("filter(", "")


def test_the_main_path_is_native(documents):
    plan = q.quality_filter(documents([(1, PROSE)]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
