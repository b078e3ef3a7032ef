"""From raw documents to packed training sequences, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pramana.llm import decontaminate, packing, pii, simhash, toxicity
from pramana.llm._spark import checkpoint, table, unused

#: No SQL: training a network, hashing shingles and tokenizing have no SQL form. Tests hold every
#: stage against a plain version.
ORACLE_SQL = None


def _all(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst window stays below the threshold. Labels of held-out rows are not learned from.

    Null and empty texts, repeated rows and rows without an id are scored like others; an empty table stays empty.
    """
    apart = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    w = toxicity.fit(docs, table(spark, sf_dir, "labels"), kept_apart=apart)
    score = unused(docs, "toxicity")
    return toxicity.score(docs, w, score).where(F.col(score) < toxicity.THRESHOLD).select(_all(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the smallest id, of its texts the one with the smallest hash.

    Unlike texts under one id are documents of their own; of rows equal in id and text one stays,
    whatever their other columns. Rows without an id join no group: exact copies among them go, the rest stays.
    """
    th = unused(docs, "th")
    known = docs.where("doc_id is not null").withColumn(th, simhash.text_hash(F.col("text").cast("string")))
    one = simhash.classes(known).groupBy("root").agg(F.min(F.struct("id", "th")).alias("r"))
    kept = one.select(F.col("r.id").alias("doc_id"), F.col("r.th").alias(th)).distinct()
    left = known.join(kept, ["doc_id", th], "left_semi").dropDuplicates(["doc_id", th])
    return left.select(_all(docs)).unionByName(docs.where("doc_id is null").dropDuplicates(["text"]).select(_all(docs)))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the removal spans; a document of which no word is left goes, n_chars is counted anew where words went.

    Null and empty texts stay as they are, repeated rows and rows without an id too.
    """
    hits = unused(docs, "n_hit")
    left = decontaminate.remove(docs, table(spark, sf_dir, "benchmark"), hits=hits)
    left = left.where((F.col(hits) == 0) | F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    return left.withColumn("n_chars", F.when(F.col(hits) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(_all(docs))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind, n_chars counted anew; null texts and their n_chars stay, repeated rows too."""
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(_all(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences; a null or empty text is its end token alone."""
    return packing.pack(packing.pieces(docs)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", cut_benchmark),
    ("pii", redact_personal),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written to and read from the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpoint(docs)
    return docs
