import math
import re
from collections import Counter

import pytest

from crashgrid.llm import quality, queries
from crashgrid.llm.texts import read


def base(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": len(words) < 10 or 100 * len(covered) > 20 * len(words),
    }


def classes(text):
    sets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>", ".,;:!?'\"()[]{}/+=_~^`@\\-"]
    counts = [sum(c in s for c in text) for s in sets]
    counts += [sum(ord(c) > 127 for c in text), sum(c in " \t\n\x0b\f\r" for c in text)]
    return [*counts, len(text) - sum(counts)]


def common(text, lang):
    words = [w.lower() for w in re.findall("[^\x20\x09-\x0d]+", text)]
    counts = [words.count(w) for w in quality.COMMON_WORDS[lang]]
    return [*counts, len(words) - sum(counts)]


def distance(one, other):
    p, q = [x / sum(one) for x in one], [x / sum(other) for x in other]
    terms = [x * math.log2(2 * x / (x + y)) if x else 0 for x, y in [*zip(p, q), *zip(q, p)]]
    return math.sqrt(max(sum(terms) / 2, 0))


def test_query_matches_brute_force(spark, small):
    docs = read(spark, small).collect()
    rows = {r.doc_id: r for r in queries.QUERIES["op4_divergence_rules"](spark, small).collect()}
    assert len(rows) == len(docs)
    sums = {}
    for d in docs:
        for kind, found in (("c", classes(d.text)), ("w", common(d.text, d.lang))):
            old = sums.get((d.lang, kind), [0] * len(found))
            sums[d.lang, kind] = [a + b for a, b in zip(old, found)]
    for d in docs:
        r, want = rows[d.doc_id], base(d.text)
        assert {k: getattr(r, k) for k in want} == want
        far = False
        if len(d.text) >= quality.LEAST_CHARS:
            x = distance(classes(d.text), sums[d.lang, "c"])
            assert r.class_distance == pytest.approx(x, abs=1e-9)
            far |= x > quality.MAX_CLASS_DISTANCE
        if want["n_words"] >= quality.LEAST_COMMON_BASE:
            x = distance(common(d.text, d.lang), sums[d.lang, "w"])
            assert r.word_distance == pytest.approx(x, abs=1e-9)
            far |= x > quality.MAX_WORD_DISTANCE
        assert r.kept == (not want["base_failed"] and not far)


ODD = [
    None,
    "",
    " \n\t\x0b ",
    "a b c d e a b c d e",
    "x x x x x x x x x x x x",
    "one line\n\none line\n one line\n#$%&|<>*",
    "é😀 ﬁ x y z",
    "the of and " * 20_000,
    "a b c d e f g a b c d e f h a b c d e",
]


def test_odd_texts(make_docs):
    docs = make_docs(ODD).unionAll(make_docs([(8, ODD[8]), (None, None)]))
    docs = docs.withColumnRenamed("source", "n_words").withColumnRenamed("n_chars", "_w")
    rows = quality.judge(docs).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        want = base(r.text)
        assert {k: r[k] for k in want} == want, r.text


def test_languages_missing_and_unknown(spark):
    text = "Some words of a text that has a common length and the usual letters in it, on and on. " * 3
    rows = [(1, text, None), (2, text, "xx"), (3, text, "en"), (4, text, ""), (5, None, None)]
    found = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(found) == 5 and found[1].class_distance is not None
    assert found[1].word_distance is None and found[2].word_distance is None
    assert found[2].class_distance == pytest.approx(0, abs=1e-6)


def test_empty_table(make_docs):
    assert quality.judge(make_docs([])).count() == 0


def test_no_python_in_the_plan(spark, small):
    plan = queries.QUERIES["op4_divergence_rules"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
