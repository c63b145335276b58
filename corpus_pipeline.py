"""The corpus pipeline over documents: each stage works on all that the one before has kept.

1. toxicity: documents that the classifier chain finds toxic go.
2. near-duplicates: one document, of the smallest id, of each group stays.
3. repeated passages: every byte under a 50-byte string of a document with a smaller id is cut out
   of the text (what a cut leaves of a character goes too); n_chars follows. Emptied documents stay.
4. benchmark passages: contaminated documents go.
5. tokens: the ids of every text, and the text decoded from them.

All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillrank.llm.common import table, written
from quillrank.llm.decontaminate import remove_contaminated
from quillrank.llm.minhash_join import one_of_each
from quillrank.llm.sentencepiece_codec import default_model, encode_decode
from quillrank.llm.suffix_dedup import removed_text
from quillrank.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return removed_text(docs, length_col="n_chars")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and decoded."""
    return encode_decode(docs, default_model()).select("doc_id", "lang", "source", "ids", "decoded")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("suffix_array", repeated_passages),
    ("decontamination", benchmark_passages),
    ("sentencepiece", tokens),
]

#: SQL can express neither the trained chain nor merge-order encoding; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
