"""From raw documents to packed token sequences, in five stages over the whole table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm import decontam, jaccard, packing, pii, toxicity
from offerloom.llm.durable import durable, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go.

    Null and empty texts get the share of toxic labels as their score; equal
    rows are judged alike; a long text is judged by all its windows; without
    labels of both kinds the score is that share for all. Other columns pass.
    """
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.held_out)
    return toxicity.score(docs, net, keep=tuple(COLUMNS)).filter("predicted = 0").select(COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle similarity only the one with the smallest id stays.

    Null and empty texts are linked with nothing and stay. A row without an id
    takes part under a number from its text, above 2 ** 62, so it goes where a
    row with an id is like it. Rows with one id are one document; of its equal
    texts one row stays (the least by lang, source and n_chars).
    """
    given = docs.withColumn("_id", F.coalesce(F.col("doc_id"), F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62)))
    later = jaccard.join(given.select("_id", "text"), "_id").filter("component_id <> _id").select("_id").distinct()
    left = given.join(later, "_id", "left_anti")
    # Only ids met more than once need a second look.
    again = left.groupBy("_id").agg(F.count("*").alias("n")).filter("n > 1").select("_id")
    odd = left.join(again, "_id", "left_semi").groupBy("_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("r"), F.first("doc_id").alias("doc_id"))
    return left.join(again, "_id", "left_anti").select(COLUMNS).union(odd.select("doc_id", "text", "r.lang", "r.source", "r.n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go.

    Rows are told apart by id and text together, so one without an id goes for
    its own text alone. Null and empty texts hold nothing and stay; a long text
    is searched whole; an empty benchmark drops nothing.
    """
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256))
    keyed = docs.withColumn("_key", key)
    found = decontam.contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "_key")
    return keyed.join(found.select("_key").distinct(), "_key", "left_anti").select(COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows the text.

    All rows stay, those with null or empty texts and repeated ones as they are.
    """
    found = pii.find(docs, keep=("lang", "source", "n_chars", "text"))
    changed = F.col("spans") != ""
    return found.select("doc_id", F.when(changed, F.col("redacted")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(changed, F.char_length("redacted").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 1024; a null or empty text is one piece, the end token."""
    return packing.pack(durable(packing.pieces(docs)))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: A trained network decides in the first stage, which SQL cannot express; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
