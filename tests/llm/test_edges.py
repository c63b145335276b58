"""Empty tables, repeated rows and columns with the names of results."""

import pytest
from pyspark.sql import functions as F
from quillrank.llm import chat_format, kneser_ney, language, topk_search, toxicity, training_order

CLASHING = "doc_id long, text string, lang string, keep string, perplexity string, n_bytes string, f string, lang_pred string, score string, toxic string, slot string"


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["the old mill by the river", "the river and the stone", "", None, "old stone, old mill"]
    rows = [(i, t, "en" if i % 2 else None) + ("taken",) * 8 for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, "no id", "en") + ("taken",) * 8], CLASHING)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASHING)


def test_quality_of_repeated_rows_and_clashing_names(spark, docs):
    got = [tuple(r) for r in kneser_ney.quality(docs, docs.select("doc_id")).select("doc_id", "n_bytes", "perplexity", "keep").collect()]
    assert len(got) == docs.count() and len({r for r in got if r[0] == 0}) == 1 and sum(r[0] == 0 for r in got) == 2
    assert {r[0]: r[1:] for r in got}[2] == {r[0]: r[1:] for r in got}[3] == (0, None, False)


def test_quality_without_trusted_documents_keeps_what_has_a_perplexity(docs):
    got = kneser_ney.quality(docs, docs.select("doc_id").filter("false")).collect()
    assert all(r["keep"] == (r["perplexity"] is not None) for r in got) and sum(r["keep"] for r in got) == 5


def test_language_of_empty_and_repeated(docs, empty):
    model = language.fit(docs, F.lit(True))
    got = language.identify(docs, model)
    assert got.columns == [*docs.columns, "_lang_pred", "_score"] and got.count() == docs.count()
    assert language.identify(empty, model).count() == 0


def test_toxicity_of_an_empty_table(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.without_toxic(empty, labels).count() == 0
    assert toxicity.without_toxic(docs, labels.filter("false")).columns == docs.columns


def test_search_with_clashing_names(spark):
    rows = [(i, [float(i), 1.0], "taken", "taken", "taken") for i in (0, 1, 20, 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id string, rank string, score string")
    got = topk_search.top_k(df.filter("vec_id % 20 = 0"), df, 2).collect()
    assert {r["query_id"] for r in got} == {0, 20} and all(r["score"] == 4096 * (r["query_id"] * r["vec_id"] + 1) for r in got)


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, tree string, formatted string")
    assert chat_format.conversations(chat_format.linear_messages(none)).count() == 0


def test_training_order_of_an_empty_table(spark, empty, tmp_path):
    path = str(tmp_path / "none")
    assert training_order.materialise(training_order.byte_ids(empty), path) == 0
    assert training_order.read_slots(spark, path).count() == 0
