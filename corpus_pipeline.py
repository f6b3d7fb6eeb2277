"""From raw documents to token files: language, near-duplicates, benchmark leaks, mixing, output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's documents. All stages but the last return the columns of ``documents``. Rows
are kept or dropped by their ids; repeated rows of an id share its decision. Rows of a null id have no
decision and stay until the output, which writes them first. Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm import decontaminate, langid, minhash, mixing, tokens
from stepweave.llm.registered import PIPELINE_MIX, source_domain, table, tokenizer_path
from stepweave.llm.shared import folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no language (``und``), and correct ``lang`` of the others to what was found.

    Where no language was learned, only texts without a letter have none, and ``lang`` stays as it is."""
    model = langid.fit(docs)
    if not model.automata:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    others = [c for c in docs.columns if c != "doc_id"]
    found = langid.predict(docs, model, keep=others, prefix="__").where(F.col("__lang_pred") != langid.UND)
    return found.withColumn("lang", F.col("__lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: five-word shingles, similarity 0.8."""
    found = minhash.near_duplicates(docs)
    return docs.join(found.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Select documents to the target weights: 90 percent of the words, each document at most once.

    Rows of a null id all stay, beside those selected."""
    found = mixing.mix(docs, PIPELINE_MIX, source_domain())
    taken = docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi").select(*docs.columns)
    return taken.union(docs.where("doc_id is null"))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files; a row per document read back from them."""
    path = folder(spark, "ids")
    tokens.write(docs, path, tokens.Output(tokenizer_path()))
    return tokens.digest(spark, path)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("leaks", leaks),
    ("target_mix", target_mix),
    ("token_files", token_files),
]

#: Cross-parsing, shingle hashing and range coding can't be said in SQL; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
