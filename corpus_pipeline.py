"""The training-text pipeline: good documents, one of each near-duplicate group, without benchmark passages or personal data, packed.

Every stage but the last returns the columns of its documents, whatever else they hold beside doc_id, text and lang; names that begin with __ are ours. An empty table gives an empty
one. Null and empty texts, and repeated rows, are said of each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skerry.llm.common import cut_alone, named_paths
from skerry.llm.decontaminate import without_leaks
from skerry.llm.ngram_join import first_of_groups
from skerry.llm.packing import pack
from skerry.llm.pii import redact_texts
from skerry.llm.quality import good_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the language model of trusted text rejects go, and those whose text is null or empty. Repeated rows are judged alike."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of documents linked at 0.8 on five-word shingles one stays, of repeated rows too. Those without words link with nothing and stay."""
    return first_of_groups(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents with a passage of the benchmark go. Those with null or empty texts stay, and all if the benchmark is empty."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: personal data is replaced by its kind, and n_chars is the new text's. Null texts stay null."""
    return redact_texts(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: pieces of documents in sequences. Null and empty texts have their end id alone; repeated rows are packed each."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packing)]
#: SQL can't express the language model, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for documents; every stage's output is written and read again, and what it was made of is dropped then."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), named_paths()
    for name, stage in STAGES[:-1]:
        docs = cut_alone(stage(spark, docs, sf_dir), name, since)
    return STAGES[-1][1](spark, docs, sf_dir)
