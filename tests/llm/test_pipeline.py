"""run() against every stage in plain Python, one after the other."""

import hashlib
import math
import re
from collections import Counter

import test_decontam
import test_lines
import test_neardup
import test_quality

import corpus_pipeline
from playbill.llm import decontam
from playbill.llm.queries import SEED, WEIGHTS, read

FOLDER = "/root/testdata/sf0.001"


def passes(text):
    n, chars, symbols, dup, repeated = test_quality.measures(text)
    words = test_quality.WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if test_quality.WORD.search(x)]
    upper = sum(c.isupper() for c in text or "")
    return not (n < 10 or 100 * repeated > 20 * n or 10 * symbols > n or chars < 2 * n or chars > 25 * n or 2 * upper > chars
                or 10 * sum(a == b for a, b in zip(words, words[1:])) > 3 * n or 2 * dup > len(lines)
                or 10 * sum(bool(re.search(r"(\.\.\.|…)[ \t-\r]*$", x)) for x in lines) > 3 * len(lines)
                or 10 * sum(bool(re.match(r"[ \t-\r]*[•‣*-][ \t]", x)) for x in lines) > 9 * len(lines))


def holds(text, items):
    ids = {}
    own = [ids.setdefault(w, len(ids)) for w in test_decontam.words(text) if w]
    for item in items:
        p = [ids.setdefault(w, len(ids)) for w in test_decontam.words(item) if w]
        masks = {}
        for i, w in enumerate(p):
            masks[w] = masks.get(w, 0) | 1 << i
        if p and decontam.myers(masks, len(p), own)[0] <= decontam.budget(len(p)):
            return True
    return False


def copies(doc_id, rate):
    u = int(hashlib.md5(f"{SEED}|{doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_run_equals_plain_python(spark):
    docs = {r["doc_id"]: r for r in read(spark, FOLDER, "documents").collect()}
    texts = {i: r["text"] for i, r in docs.items() if passes(r["text"])}
    texts = {i: t for i, _, _, t in test_lines.brute(list(texts.items()))}
    texts = {i: texts[i] for i, _, _, kept in test_neardup.brute(list(texts.items())) if kept}
    items = [r["text"] for r in read(spark, FOLDER, "benchmark").collect()]
    texts = {i: t for i, t in texts.items() if not holds(t, items)}
    size, weight = Counter(), {}
    for i, t in texts.items():
        size[docs[i]["source"]] += max(1, len(t))
        weight[docs[i]["source"]] = WEIGHTS.get(docs[i]["source"], 1.0)
    want = []
    for i, t in texts.items():
        source = docs[i]["source"]
        n = copies(i, weight[source] / sum(weight.values()) * sum(size.values()) / size[source])
        want += [(i, t, docs[i]["lang"], source, len(t), c, n) for c in range(n)]
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, FOLDER).collect()) == sorted(want)
    assert 0 < len(texts) < len(docs)


def test_stages_keep_clean_documents_and_columns(spark, documents):
    prose = "Dieses Dokument Nummer {0} ist sauber, lang genug und kommt nur ein einziges Mal im Bestand vor, mit Wort{0}."
    rows = documents([(i, prose.format(i) + f" x{i}" * 2) for i in range(8)] + [(None, None), (9, "")])
    docs = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == rows.columns
        assert {r["doc_id"] for r in docs.collect()} >= set(range(8)), name


def test_line_stage_counts_anew(spark, documents):
    line = "a line of more than forty characters that all of them hold"
    docs = documents([(i, f"{line}\nown text {i}") for i in range(5)] + [(7, line)])
    rows = {r["doc_id"]: r for r in corpus_pipeline.line_dedup(spark, docs, FOLDER).collect()}
    assert rows[0]["text"] == "own text 0" and rows[0]["n_chars"] == 10 and rows[7]["text"] == line
