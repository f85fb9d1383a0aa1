"""From raw documents to token ids: five stages, each written as Parquet and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import bytepairs, jaccard, languages, mixing, secrets
from quarrylens.llm.common import cut, marked, small_batches

#: A document most of whose words fit no learned language is rejected.
MOST_NOISE = 0.5
#: Near duplicates: words of a shingle, and percent of Jaccard similarity.
WIDTH, PERCENT = 5, 80


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without text or letters and those whose words mostly fit no learned language.

    Rows are judged by their text alone: equal texts share a verdict. Null and empty texts go, long ones are read whole; an empty
    table gives no rows, and all columns are kept, whatever their names.
    """
    own = F.concat_ws(":", F.xxhash64("text"), F.length("text"))
    with small_batches(spark):
        model = languages.learn(docs)
        judged = languages.identify(docs.select(own.alias("row"), "text"), model, "row")
        rejected = judged.where((F.col("lang_pred") == languages.UNKNOWN) | (F.col("noise") > MOST_NOISE)).select(F.col("row").alias("__rejected")).distinct()
        rejected = cut(rejected, "rejected")
    parts = marked(docs, own, rejected, "__perhaps")  # texts of accepted documents are not shuffled
    checked = parts.where("__perhaps").join(rejected, own == F.col("__rejected"), "left_anti")
    return parts.where("not __perhaps").select(docs.columns).union(checked.select(docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near duplicates, and one row of it.

    An id that occurs once stands for its row. Rows of a repeated id are told apart by their sets: those of one id and group
    are one document, whose row of the smallest digest stays.
    """
    found = cut(jaccard.set_classes(docs, width=WIDTH, percent=PERCENT).select("doc_id", "set", "component", "component_id"), "classes")
    alone = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = cut(found.groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("rows"), F.max(alone).alias("head"))
              .where("rows > 1 or not head"), "ids")
    parts = marked(docs, F.col("doc_id"), ids.select("__id"), "__perhaps")  # other texts are not shuffled
    once = parts.where("__perhaps").join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")
    more = ids.where("rows > 1 and head")
    heads = (found.where(alone).join(more, F.col("doc_id").eqNullSafe(F.col("__id"))).select("__id", F.col("set").alias("__set"), "component").distinct())
    several = jaccard.with_sets(marked(docs, F.col("doc_id"), more.select("__id"), "__several").where("__several").select(docs.columns), width=WIDTH)
    digest = F.sha2("row.text", 256)
    chosen = (several.join(heads, F.col("row.doc_id").eqNullSafe(F.col("__id")) & F.col("set").eqNullSafe(F.col("__set")))
              .groupBy("__id", "component", F.when(F.col("set").isNull(), digest).alias("wordless"))
              .agg(F.min_by("row", F.struct(digest, F.xxhash64("row"))).alias("row")))
    return parts.where("not __perhaps").select(docs.columns).union(once.select(docs.columns)).union(chosen.select("row.*"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets; ``n_chars`` follows the text. A null text stays null; every row and column is kept."""
    masked = secrets.redacted(docs, cut(secrets.scan(docs), "findings"))
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources meet their target weights.

    Documents without words have nothing to give. Rows that share an id are taken alike. Columns are kept, an empty table stays empty.
    """
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document and of the bytes that they decode to; null texts have no ids, other columns go."""
    import public_tokenizers

    coded = bytepairs.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bytepairs.digests(coded)


STAGES = [("language", language_stage), ("near_duplicates", near_duplicate_stage), ("secrets", secret_stage),
          ("mixing", mixing_stage), ("tokens", token_stage)]

#: A language model, a forest and byte pairs are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
