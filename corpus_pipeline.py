"""A cleaning pipeline over `documents`: toxicity, near-duplicates, benchmark passages, personal data, packing.

Every stage takes the documents its predecessor kept, written as Parquet in the shared folder and read again. All but the last
return the columns of documents, in their order, and further columns as they are. Null texts pass as empty texts; rows without
doc_id are kept, but by the toxicity stage only if their text is. Texts of any length are read whole. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nubila.llm import decontaminate, near_dedup, packing, pii, toxicity
from nubila.llm.common import stored, table
from nubila.llm.queries import tokenizer_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier scores below 0.5; it is fitted on the labelled documents.

    A score of exactly 0.5 rejects. Equal texts have equal scores, so copies go or stay together.
    """
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each component of texts alike at 0.8 in five-word shingles.

    Texts without words are alike to nothing and stay. Rows that repeat a doc_id: see drop_near_duplicates.
    """
    return near_dedup.drop_near_duplicates(docs, shingle=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose text no benchmark item is covered by 0.8 or more; repeated rows go or stay together."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that reveal it replaced; n_chars follows the new text. Null texts become empty."""
    own = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c != "text"}  # names that no result of the operator has
    found = pii.sanitise_documents(docs.toDF(*[own.get(c, c) for c in docs.columns]))

    def kept(c: str) -> Column:
        return F.col("sanitised") if c == "text" else F.char_length("sanitised").cast("long") if c == "n_chars" else F.col(own[c])

    return found.select(*[kept(c).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 2048; texts that are longer become several pieces, repeated rows repeated pieces."""
    return packing.pack_documents(docs, tokenizer_path(), max_tokens=2048, end_id=0)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: Dictionaries, signatures and tilings cannot be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
