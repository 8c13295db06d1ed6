"""A training corpus from raw documents: five stages, each one operator of
``cyclewise.llm`` over all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents``; what they drop is gone, what they change stays changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclewise.llm.decontaminate import contaminated, decontaminate
from cyclewise.llm.language_id import identify, learn
from cyclewise.llm.line_dedup import dedup_lines
from cyclewise.llm.near_dedup import near_duplicates
from cyclewise.llm.sentencepiece_codec import encode_decode
from cyclewise.session import materialise

#: with four languages a score of a quarter says nothing
MIN_SCORE = 0.3


def _rows(docs: DataFrame) -> DataFrame:
    """Whole rows beside the hashes of id and text that operators know them by."""
    return docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id").alias("dk"), F.xxhash64("text").alias("th"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Text without letters or without any leading language goes; a missing
    ``lang`` is filled in. The model learns from the rows that have one."""
    model = learn(docs, F.lit(True))
    out = identify(docs, model, whole_rows=True)
    out = out.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return out.select("row.*", "lang_pred").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents repeat stay in one of them. A document of
    which no text is left goes."""
    out = dedup_lines(docs).where((F.col("n_dropped") == 0) | (F.btrim("text", F.lit(" \t\n\x0b\f\r")) != ""))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five words, a
    similarity of 0.8 or more), the one with the least id."""
    found = near_duplicates(docs)
    first = found.where((F.col("dk") == F.col("first_dk")) & (F.col("th") == F.col("first_th"))).select("dk", "th").distinct()
    # rows equal in id and text are one document
    return _rows(docs).join(first, ["dk", "th"]).dropDuplicates(["dk", "th"]).select("row.*")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are words of benchmark windows go."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.where(contaminated()).select("dk", "th").distinct()
    return _rows(docs).join(gone, ["dk", "th"], "left_anti").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and the text they decode to."""
    import public_tokenizers

    out = encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("language", language), ("lines", lines), ("near", near), ("benchmark", benchmark), ("tokens", tokens)]

# the first stage learns a model, which SQL can't express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
