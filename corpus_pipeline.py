"""Training-data pipeline: documents to token ids in five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlore.llm import decontaminate, language_id, ngram_join, piece_codec, substring_dedup
from pathlore.llm.queries import piece_model
from pathlore.session import cut_lineage

SURE = 0.5  # mean probability that the words' languages must have


def _others(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c != "doc_id")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts whose words no language explains with confidence.

    A text of several languages stays if the language of each word is sure. A null ``lang`` is
    filled in. Ids are not used: rows with a null or a repeated id are judged each.
    """
    model = language_id.fit(docs)
    found = language_id.predict(docs, model, carry=_others(docs))
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("sure") >= SURE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every near-duplicate group.

    Rows of one id and one text are one; other texts of a repeated id stay with the first of them
    whose component has that id. Rows with a null id are compared with nothing and stay.
    """
    groups = ngram_join.near_duplicates(docs)
    stays = groups.where("component_id = doc_id").select("doc_id").distinct()
    return docs.join(stays, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that an earlier document has; untouched texts stay as they are, emptied ones go.

    Every row is a text of its own, also with a null or a repeated id.
    """
    out = substring_dedup.drop_repeated_passages(docs, carry=_others(docs))
    cut = F.col("n_removed") > 0
    out = out.where(~cut | (F.col("kept") != ""))
    out = out.withColumn("text", F.when(cut, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item, also with other numbers, names or units.

    Rows that share an id go together; rows with a null id stay.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without(docs, decontaminate.contaminated(docs, items)).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    out = piece_codec.encode(docs, piece_model(), carry=("lang", "source"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("passages", without_passages),
    ("benchmark", without_benchmark),
    ("tokens", encoded),
]

ORACLE_SQL = None  # fitted model, similarity components and tokenizer have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
