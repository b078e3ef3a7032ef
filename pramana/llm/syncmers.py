"""Document fingerprints from closed syncmers.

A k-mer of bytes is an anchor if its smallest inner s-mer lies at one of its edges, which depends on
the k-mer alone. A fingerprint is all anchors of a text with their places; likeness counts the anchors that
match in the same order. It stays in the task that compares it, the column is its digest.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pramana.llm._spark import need_integer_ids, table
from pramana.llm._text import batch_slices, mix

K, S = 16, 6
#: Bytes of text whose anchors are made together: about 60 bytes of working memory for each.
SLICE = 1 << 19
#: Documents of a range of neighbours, and most such ranges.
RANGE, MOST_RANGES = 4000, 20_000
_RNG = np.random.default_rng(99).integers(0, 2**64, 256, dtype=np.uint64)


def anchors(buf: np.ndarray, off: np.ndarray):
    """Hash and place of every closed syncmer of texts that lie one after another, and its text's number."""
    n, w = len(buf), K - S + 1
    if n < K:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z
    with np.errstate(over="ignore"):
        v, f = _RNG[buf], np.uint64(0x9E3779B97F4A7C15)
        small = v[: n - S + 1].copy()
        for j in range(1, S):
            small *= f
            small += v[j : n - S + 1 + j]
        # 24 bits are enough to find the smallest; ties go to an edge
        rank = (mix(small) >> np.uint64(40)).astype(np.uint32)
        m = n - K + 1
        low = rank[1:m + 1].copy()
        for j in range(2, w - 1):
            np.minimum(low, rank[j : j + m], out=low)
        at = np.flatnonzero((rank[:m] <= low) | (rank[w - 1 : w - 1 + m] <= low))
        row = np.searchsorted(off, at, "right") - 1
        inside = at + K <= off[row + 1]
        at, row = at[inside], row[inside]
        h = small[at] * np.uint64(0xC2B2AE3D27D4EB4F)
        h = mix(h + small[at + S] * f + small[at + K - S] + mix(small[at + (K - S) // 2]))
    return h, at - off[row], row


def fingerprints(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct anchors in the order of their first places: (64-bit hashes, places).

    A text that has no anchor is one anchor as a whole; an empty text has none.
    """
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    h, place, row = anchors(np.frombuffer(b"".join(texts), np.uint8), off)
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    out = []
    for i, t in enumerate(texts):
        x, p = h[bounds[i] : bounds[i + 1]], place[bounds[i] : bounds[i + 1]]
        _, first = np.unique(x, return_index=True)
        first.sort()
        x, p = x[first], p[first]
        if not len(x) and t:
            x, p = np.frombuffer(hashlib.sha256(t).digest()[:8], np.uint64), np.zeros(1, np.int64)
        out.append((x, p))
    return out


def written(found: tuple[np.ndarray, np.ndarray]) -> str:
    """The number of anchors and a digest of their hashes and places."""
    x, p = found
    return f"{len(x)}:{hashlib.sha256(x.astype('<u8').tobytes() + p.astype('<i8').tobytes()).hexdigest()}"


def in_order(places: np.ndarray) -> int:
    """Length of the longest increasing part of distinct numbers; what is in order from the start costs no loop."""
    down = np.flatnonzero(places[1:] < places[:-1])
    if not len(down):
        return len(places)
    tails = places[: down[0] + 1].tolist()
    for p in places[down[0] + 1 :].tolist():
        k = bisect_left(tails, p)
        tails[k : k + 1] = [p]
    return len(tails)


def likeness(a: tuple, b: tuple) -> float:
    """Anchors that two texts have in common in the same order, twice over both texts' number, 0 to 1."""
    (x, _), (y, q) = a, b
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    order = np.argsort(y, kind="stable")
    at = order[np.minimum(np.searchsorted(y, x, sorter=order), len(y) - 1)]
    return 2 * in_order(q[at[y[at] == x]]) / (len(x) + len(y))


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = RANGE) -> DataFrame:
    """Rows (id, text, bucket, guest) dealt into ranges of ids and sorted in each by descending id.

    The last row of each range is a guest: the first row of the next lower range, of the highest for
    the lowest. So every row has its next row after it, without a sort in one task. Equal ids follow the text's
    hash; rows without an id come last, in ranges of that hash. Ids are integers.
    """
    need_integer_ids(docs, id_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    # a row without an id sorts by its hash alone, below all that have one
    key = F.coalesce(F.col("id").cast("long"), F.col("h"))
    base = base.select("id", "text", "h", key.alias("key"), F.col("id").isNotNull().cast("int").alias("known"))
    counts = {r.known: r.n for r in base.groupBy("known").agg(F.count("*").alias("n")).collect()}
    base, bucket, first = base.withColumn("d", F.col("key").cast("double")), F.lit(None), 0
    for known in (1, 0):
        n = min(MOST_RANGES, max(1, -(-counts.get(known, 0) // span)))
        cuts = base.where(F.col("known") == known).agg(F.percentile_approx("key", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else []
        splits = sorted({float(c) for c in cuts or [0]})
        base = Bucketizer(splits=[-float("inf"), *splits, float("inf")], inputCol="d", outputCol=f"b{known}").transform(base)
        # greater keys have smaller numbers, so that buckets follow the order of the rows
        bucket = F.when(F.col("known") == known, first + len(splits) - F.col(f"b{known}")).otherwise(bucket)
        first += len(splits) + 1
    base = base.select("id", "text", "known", "key", "h", bucket.cast("int").alias("bucket"))
    place = F.struct("known", "key", "h")
    heads = sorted(tuple(r) for r in base.groupBy("bucket").agg(F.max(place).alias("m")).select("bucket", "m.known", "m.key", "m.h").collect())
    to = [(known, key, h, heads[i - 1][0]) for i, (_, known, key, h) in enumerate(heads)]
    spark = docs.sparkSession
    guests = base.drop("bucket").join(F.broadcast(spark.createDataFrame(to, "known int, key long, h long, bucket int")), ["known", "key", "h"])
    both = base.withColumn("guest", F.lit(0)).unionByName(guests.dropDuplicates(["bucket"]).withColumn("guest", F.lit(1)))
    dealt = both.repartitionByRange(max(1, len(heads)), "bucket").sortWithinPartitions("bucket", "guest", F.desc("known"), F.desc("key"), F.desc("h"))
    return dealt.select("id", "text", "bucket", "guest")


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text, of its edit and likeness to the edit and the next text.

    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next); the edit
    replaces the last half by the first characters of the next document in descending order of ids.
    A null text counts as empty; a single document is its own next. Repeated rows follow each other and get a row
    each; an empty table gives an empty result. Ids are integers.
    """
    kind = docs.schema[id_col].dataType
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        waiting = None
        for big in batches:
            for b in batch_slices(big, limit=SLICE):
                rows = list(zip(*(c.to_pylist() for c in b.columns)))
                if waiting is not None:
                    rows.insert(0, waiting)
                waiting = rows[-1]
                pairs = [(i, x[1], rows[i + 1][1]) for i, x in enumerate(rows[:-1]) if not x[3] and rows[i + 1][2] == x[2]]
                edits = [t[: len(t) - len(t) // 2] + nxt[: len(t) // 2] for _, t, nxt in pairs]
                own = fingerprints([x[1].encode() for x in rows])
                coded = [e.encode() for e in edits]
                of_edit = fingerprints(coded)
                out = [(rows[i][0], len(t), hashlib.sha256(c).hexdigest(), written(own[i]), written(e), likeness(own[i], e), likeness(own[i], own[i + 1])) for (i, t, _), c, e in zip(pairs, coded, of_edit)]
                if out:
                    types = [big.schema.field("id").type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return neighbours(docs, id_col, text_col).mapInArrow(run, f"id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, its edit and its next; see ``compare`` for nulls and repeats."""
    return compare(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
