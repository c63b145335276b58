from quillrank.llm import suffix_dedup


def test_replacement_characters_of_the_text_stay(spark):
    shared = "é" * 40
    df = spark.createDataFrame([(1, "a" + shared), (2, "b�" + shared + "c")], "doc_id long, text string")
    got = {r[0]: r[1] for r in suffix_dedup.removed_text(df).collect()}
    assert got == {1: "a" + shared, 2: "b�c"}
