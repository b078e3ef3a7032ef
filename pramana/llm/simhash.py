"""SimHash near-duplicates: pigeonhole blocks, verified Hamming distance, components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pramana.llm._graph import components
from pramana.llm._spark import checkpoint, table

BITS, DISTANCE, SHINGLE, SEED = 64, 2, 3, 42
BLOCKS = 4
#: Blocks of a fingerprint with more members than this are linked by one-bit variants.
CROWD = 32
#: Fingerprints of more than one in so many rows are looked up by broadcast in the last join.
HOTTEST = 2000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_WEIGHT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of one text."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        h = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        start = end - size
        digest = xxhash.xxh64_intdigest
        h = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(start[: 1 - SHINGLE].tolist(), end[SHINGLE - 1 :].tolist())], np.uint64, len(words) - SHINGLE + 1)
    cols = h.view(np.uint8).reshape(-1, 8)
    if len(h) < 256:
        ones = np.unpackbits(cols, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(cols[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(_WEIGHT[2 * ones > len(h)].sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th long, fp long) of every whole text, one row for each row; th is a hash of the text, null text counts as empty."""

    def run(batches):
        for b in batches:
            fp = [fingerprint(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["id", "th", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), text_hash(text).alias("th"), text.alias("text")).mapInArrow(run, f"id {kind}, th long, fp long")


def text_hash(text: Column) -> Column:
    """A hash that tells rows of one id apart; null text and empty text differ."""
    return F.xxhash64(text, text.isNull())


def _shift(fp: Column, by: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, by).bitwiseAND(F.lit((1 << width) - 1))


def link_fingerprints(reps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """``reps`` (fp long distinct, node long) -> links (a, b) between all pairs within ``distance`` bits.

    With ``blocks`` blocks at least ``blocks - distance`` are alike in a close pair, so each choice of
    that many blocks is a join key. A key shared by up to ``crowd`` fingerprints is joined with
    itself and verified. The members of a larger one get their 65 one-bit variants instead: two
    fingerprints differ in at most two bits exactly if they share a variant, and at most 65
    fingerprints share one, so that each is hung on the smallest. No pair is lost either way.
    """
    if distance != 2 or BITS % blocks:
        raise ValueError("one-bit variants serve a distance of 2 and blocks of equal width")
    width = BITS // blocks
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        key = F.lit(0).cast("long")
        for c in chosen:
            key = F.shiftleft(key, width).bitwiseOR(_shift(F.col("fp"), c * width, width))
        keys.append(F.struct(F.lit(k).alias("k"), key.alias("key")))
    keyed = reps.select("fp", "node", F.explode(F.array(*keys)).alias("b")).select("b.k", "b.key", "fp", "node")
    size = keyed.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = checkpoint(keyed.join(size, ["k", "key"]))
    few = met.where(F.col("n") <= crowd)
    pairs = few.alias("x").join(few.alias("y"), ["k", "key"]).where("x.fp < y.fp").where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= distance).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    one_bit = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(BITS)])
    variants = met.where(F.col("n") > crowd).select("fp", "node").distinct().select("node", F.explode(F.transform(one_bit, lambda m: m.bitwiseXOR(F.col("fp")))).alias("v"))
    stars = variants.groupBy("v").agg(F.collect_list("node").alias("nodes")).where(F.size("nodes") > 1)
    stars = stars.select(F.array_min("nodes").alias("a"), F.explode("nodes").alias("b")).where("a <> b")
    return pairs.union(stars).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, fp long, root long, component) for every row of ``docs``; th is ``text_hash``, root names the class.

    Two classes may hold rows of one id and so have one component; their roots differ.
    """
    fps = checkpoint(fingerprints(docs, id_col, text_col))
    groups = fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    # nodes are fingerprints: they are distinct, so equal ids on unlike texts do not link them
    found = components(link_fingerprints(groups.select("fp", F.col("fp").alias("node"))))
    rooted = groups.join(found, groups.fp == found.node, "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_fp = checkpoint(rooted.join(lowest, "root").select("fp", "root", "component", "n"))
    # fingerprints of more than a HOTTEST-th of all rows are at most HOTTEST: they go to the rows, the others meet theirs
    most = by_fp.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // HOTTEST
    hot = by_fp.where(F.col("n") > most) if most else by_fp.limit(0)
    met = fps.join(F.broadcast(hot.select("fp", "root", "component", F.lit(True).alias("hot"))), "fp", "left")
    rest = met.where("hot is null").select("id", "th", "fp").join(by_fp.where(F.col("n") <= most) if most else by_fp, "fp")
    named = ["id", "th", "fp", "root", "component"]
    return met.where("hot").select(*named).unionByName(rest.select(*named))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, component) for every row of ``docs``.

    Fingerprints within two bits are linked; the component is the smallest id reachable.
    Rows with equal ids each get a row. Null and empty texts have fingerprint zero and are
    linked like any other. A null id gets the component of its fingerprint, null if no row there
    has an id. An empty table gives an empty result.
    """
    return classes(docs, id_col, text_col).select("id", "fp", "component")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document; see ``near_duplicates`` for nulls and repeats."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
