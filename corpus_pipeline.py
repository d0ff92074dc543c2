"""From raw documents to token ids: five stages over the whole table.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which
is written as Parquet and read again. Toxic documents go; one document of each group of near-duplicates (word
5-grams, similarity of 0.8 or more) stays; documents that share 13 words in a row with a benchmark item go, however long
they are; personal data is replaced by its kind;
the last stage encodes the texts and returns, beside the columns, n_tokens, ids and the text decoded from them
(columns of these names are replaced). Each stage is right for null ids and texts as its operator's module says;
a null text is neither toxic nor contaminated nor anyone's copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontam, neardup, pii
from millrace.llm import toxicity as tox
from millrace.llm.common import discard, saved, table, tidied, unused
from millrace.llm.queries import tokenizer_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = tox.fit(docs, table(spark, sf_dir, "labels"))
    name = unused(docs, "_toxicity")
    return tox.score(docs, model, output=name).where(F.col(name) < 0.5).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenise(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: the stages that learn or tokenise have no SQL; tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with tidied():
            out = saved(stage(spark, docs, sf_dir), name, keep=True)
        discard(docs)
        docs = out
    return docs
