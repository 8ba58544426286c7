"""From raw documents to packed training sequences, in five stages.

Each stage gets what its predecessor kept, judges all of it, and is written as
Parquet in the shared folder before the next one reads it. All stages but the last
return the columns of documents.

Every stage takes empty tables, giving empty ones, and texts of any length. Extra columns
stay and never clash with what a stage computes. Repeated rows are judged like others;
only the second stage drops any for being equal.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm import decontamination, neardup, packing, sanitise, toxicity
from tallyframe.llm.shared import crc_remainder, scratch_folder, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects (a score of at least one half) go.

    Null and empty texts are scored as texts without words, and rows without an id like
    others; equal texts have equal scores.
    """
    out = toxicity.rate(docs, _table(spark, sf_dir, "labels"), lambda i: crc_remainder(i, 5) != 0)
    return out.where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that near duplicates link stays: of the smallest id, then by the row's hash.

    Each row is judged by its own text, also where rows share an id. Texts without words
    link with nothing; of those with the same id one stays. Rows without an id stay.

    Rows go by their id where no two share one, and else by a number: a group's smallest
    id is mostly its original, which its copies are nearer to than to one another.
    """
    rows = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    rows = stored(docs.select(F.monotonically_increasing_id().alias("at"), rows))
    named, unnamed = rows.where("row.doc_id is not null"), rows.where("row.doc_id is null")
    repeated = named.groupBy("row.doc_id").count().where("count > 1")
    if docs.schema["doc_id"].dataType == T.LongType() and not repeated.limit(1).count():
        named = named.withColumn("at", F.col("row.doc_id"))
    groups = neardup.near_duplicates(named.select(F.col("at").alias("doc_id"), F.col("row.text").alias("text")))
    groups = groups.select(F.col("doc_id").alias("at"), "n_shingles", "component_id")
    # rows with equal hashes are equal, so it does not matter which of them stays
    order = F.struct(F.col("row.doc_id").alias("doc_id"), F.md5(F.to_json("row")).alias("hash"), "at").alias("order")
    each = named.select("at", order).join(groups, "at")
    worded = F.col("n_shingles") > 0
    firsts = each.groupBy(F.when(worded, F.col("component_id")), F.when(~worded, F.col("order.doc_id")))
    kept = firsts.agg(F.min("order").alias("first")).select("first.at")
    return named.join(kept, "at", "left_semi").unionByName(unnamed).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words lie in benchmark windows go.

    Null and empty texts have no words and stay; an empty benchmark rejects nothing. Rows
    without an id are judged like others.
    """
    out = decontamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return out.where(~F.col("contaminated")).select("row.*")


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are replaced by general names; n_chars follows the text.

    Null texts stay null and empty ones empty; all rows stay. Matches that overlap are replaced
    as one, by the name of the first of them by place and kind.
    """
    out = sanitise.sanitised(docs)
    if "n_chars" not in out.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.select(
        *[F.length("text").cast(kind).alias(c) if c == "n_chars" else F.col(c) for c in out.columns]
    )


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens.

    A null or empty text is its end token. Equal rows are packed as often as they occur; ties in
    length go by id, null last, and by checksum.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", hide_personal_data),
    ("packing", pack_sequences),
]

#: No SQL computes the classifier, the groups or the packing; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage makes of the documents."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = scratch_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
