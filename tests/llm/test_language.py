import zlib

from crashgrid.llm import language, queries
from crashgrid.llm.texts import read


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op10_string_kernel"](spark, sf_dir).collect()
    lang = {r.doc_id: r.lang for r in read(spark, sf_dir).select("doc_id", "lang").collect()}
    assert len(rows) == len(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.99 * len(held)


def test_odd_texts(spark, make_docs):
    model = language.train(read(spark, "/root/testdata/sf0.001"))
    texts = [None, "", "123 !?", "the and of " * 20_000, "der und die nicht", "Ö", "the and of", "the and of"]
    docs = make_docs(texts).withColumnRenamed("source", "score").withColumnRenamed("n_chars", "_row")
    rows = language.identify(docs.drop("score"), model).select("doc_id", "lang_pred", "score").collect()
    got = {r.doc_id: r for r in rows}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and [got[i].score for i in range(3)] == [0.0] * 3
    assert got[3].lang_pred == "en" and got[4].lang_pred == "de"
    assert got[5].lang_pred in model.languages and got[6][1:] == got[7][1:]
    assert language.identify(make_docs([]), model).count() == 0


def test_nothing_to_learn_from(spark, make_docs):
    none = spark.createDataFrame([(1, None, "en"), (2, "text", None), (None, "text", "en")], "doc_id long, text string, lang string")
    model = language.train(none)
    assert model.languages == []
    assert [r.lang_pred for r in language.identify(make_docs(["some text"]), model).collect()] == ["und"]


def test_one_language_and_equal_rows(spark, make_docs):
    rows = [(1, "a b c", "xx"), (1, "a b c", "xx"), (1, "d e f", "xx")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [r.lang_pred for r in language.identify(make_docs(["anything"]), model).collect()] == ["xx"]


def test_only_the_text_is_read(spark):
    docs = read(spark, "/root/testdata/sf0.001")
    model = language.train(docs)
    changed = docs.selectExpr("doc_id + 1000 as doc_id", "text", "'xx' as lang", "'yy' as source")
    one = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    other = {r.doc_id - 1000: (r.lang_pred, r.score) for r in language.identify(changed, model).collect()}
    assert one.keys() == other.keys()
    assert all(one[i][0] == other[i][0] and abs(one[i][1] - other[i][1]) < 1e-3 for i in one)
