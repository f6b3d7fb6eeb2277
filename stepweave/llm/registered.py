"""The queries of the subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm import (
    bpe,
    chat,
    decontaminate,
    embeddings,
    langid,
    lines,
    minhash,
    mixing,
    periods,
    suffix,
    tokens,
    toxicity,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_domain() -> Column:
    """The tables have no domain: sources are dealt to four by the number in their names."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"(\d+)$", 1)
    return F.concat(F.lit("domain"), F.pmod(F.coalesce(number.try_cast("int"), F.lit(0)), F.lit(4)).cast("string"))


WEIGHTS = {
    "domain": {"domain0": 4, "domain1": 3, "domain2": 2},
    "lang": {"en": 5, "de": 2, "fr": 2},
    "source": {"src0": 3},
}

PIPELINE_MIX = mixing.Mix(WEIGHTS, percent=90, epochs=1)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.Mix(WEIGHTS, percent=110), source_domain())


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.remove_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_documents(table(spark, sf_dir, "documents"), tokens.Output(tokenizer_path()))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link_embeddings(table(spark, sf_dir, "embeddings"))


def op7_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.rotate(table(spark, sf_dir, "conversations"))
    return found.withColumn("mask", chat.mask_text(F.col("mask")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.MinMax(words=2))


def byte_bpe() -> bpe.Bpe:
    import public_tokenizers

    return bpe.Bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = byte_bpe()
    found = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), config), config.path)
    return found.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """Documents of which about a tenth, by their ids, get an end that repeats a stretch of their words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    start = F.pmod(g, n).cast("int")
    period = (1 + F.floor((n - start) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    # Whole copies of the stretch, cut to the length of the text.
    copies = F.ceil((n - start) / period).cast("int")
    end = F.flatten(F.array_repeat(F.slice(words, start + 1, period), copies))
    changed = F.concat(F.slice(words, F.lit(1), start), F.slice(end, F.lit(1), n - start))
    text = F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), F.array_join(changed, " ")).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return found.select(
        "doc_id",
        "n_runs",
        "start",
        "length",
        "period",
        "exponent_milli",
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def build() -> dict[str, Query]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_toxicity": op2_toxicity,
        "op3_line_dedup": op3_line_dedup,
        "op4_decontaminate": op4_decontaminate,
        "op5_token_output": op5_token_output,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_chat_rotation": op7_chat_rotation,
        "op8_language_id": op8_language_id,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_minhash": op10_minhash,
        "op11_byte_bpe": op11_byte_bpe,
        "op12_whitening": op12_whitening,
        "op13_periodic_runs": op13_periodic_runs,
    }
