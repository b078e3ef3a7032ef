"""Repeated word windows across documents: a count-min prefilter, then exact grouping.

Every window of 13 words stands under its least hash of five words. Each task sketches the documents in which
such hashes are, as sparse cells that go to the slice of the hash; a slice merges the sketches it gets, which
overestimates how many documents hold a window, and names to each document its cells that count two or more.
Only windows under these are grouped exactly, by their own hash, and no repeated one is lost. The number of
slices follows the input, so a sketch is as sparse, and a task as large, at any size; nothing is broadcast.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pramana.llm._spark import need_integer_ids, table
from pramana.llm._text import batch_slices, grams, hash_words, mix, split_words, utf8

WINDOW, ANCHOR = 13, 5
#: Rows of a slice's sketch, cells of a row as a power of two, and anchors that a slice is expected to get: a cell holds an eighth of one.
ROWS, BITS, SLICE = 2, 22, 500_000
#: Anchors that a task sketches, and windows that it combines, before it sends them; windows of a group of the exact pass at most, on average, and groups and slices at least.
COMBINED, GROUPED, LEAST_GROUPS = 1_000_000, 2_000_000, 80
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _windows(buf, off):
    """Row and place of each window, its anchor, the hashes of the words, the word it starts at and all words' bounds."""
    starts, ends, row = split_words(buf, off)
    n = len(starts) - WINDOW + 1
    z = np.zeros(0, np.int64)
    if n <= 0:
        return z, z, np.zeros(0, np.uint64), None, z, None
    h = hash_words(buf, starts, ends)
    g = grams(h, ANCHOR, 0x9FB21C651E98DF25)
    low = g[:n].copy()
    for j in range(1, WINDOW - ANCHOR + 1):
        np.minimum(low, g[j : j + n], out=low)
    at = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
    first = np.searchsorted(row, np.arange(len(off)))
    return row[at], at - first[row[at]], low[at], h, at, (starts, ends)


def _cells(anchor: np.ndarray, r: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(anchor * _ODD[r]) >> np.uint64(64 - bits)).astype(np.int64)


_SKETCH = pa.schema([("slice", pa.int32()), *[(c, pa.binary()) for c in ("once", "doc", "ids", "ths", "more")], ("id", pa.int64()), ("th", pa.int64()), ("marked", pa.binary())])
_SKETCH_SQL = "slice int, once binary, doc binary, ids binary, ths binary, more binary, id long, th long, marked binary"


def _low(anchor: np.ndarray) -> bytes:
    return anchor.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _by_number(number: np.ndarray):
    """(number, from, to) of each run of equal numbers."""
    if len(number):
        cut = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]]))
        yield from zip(number[cut[:-1]].tolist(), cut[:-1].tolist(), cut[1:].tolist())


def marks(docs: DataFrame, slices: int, bits: int) -> DataFrame:
    """(id, th, marked): the anchors of each document whose sketched count is two documents or more. docs: (id, th, text, has_id, copies).

    A partition's sketch is sparse: the low 40 bits of its anchors, of which the cells of every row follow. Anchors
    of one document here go to their slice with it; those of more are marked here, and the slice only learns that they
    are more, so that one which a third of all documents share comes to its slice once from each task.
    """

    def sketch(batches):
        kept: list = []
        ids: list = []
        ths: list = []

        def flush():
            anchor, doc = (np.concatenate(c) for c in zip(*kept))
            own, hashes = np.concatenate(ids), np.concatenate(ths)
            order = np.lexsort((doc, anchor))
            anchor, doc = anchor[order], doc[order]
            again = anchor[1:] == anchor[:-1]
            more = np.concatenate([[False], again]) | np.concatenate([again, [False]])
            slice_of = lambda a: (mix(a ^ _ODD[1]) % np.uint64(slices)).astype(np.int64)
            rows = []
            here = np.argsort(doc[more], kind="stable")
            low = anchor[more][here]
            rows += [((int(own[d]) + int(hashes[d])) % slices, *[None] * 5, int(own[d]), int(hashes[d]), _low(low[x:y])) for d, x, y in _by_number(doc[more][here])]
            first = np.unique(anchor[more])
            first = first[np.argsort(slice_of(first), kind="stable")]
            rows += [(p, *[None] * 4, _low(first[x:y]), None, None, None) for p, x, y in _by_number(slice_of(first))]
            anchor, doc = anchor[~more], doc[~more]
            order = np.lexsort((doc, slice_of(anchor)))
            anchor, doc = anchor[order], doc[order]
            for p, x, y in _by_number(slice_of(anchor)):
                used, local = np.unique(doc[x:y], return_inverse=True)
                rows.append((p, _low(anchor[x:y]), local.astype("<u4").tobytes(), own[used].tobytes(), hashes[used].tobytes(), *[None] * 4))
            for c in (kept, ids, ths):
                c.clear()
            for k in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 2000]), _SKETCH)], schema=_SKETCH)

        base = size = 0
        for big in batches:
            for b in batch_slices(big.filter(big.column("has_id"))):
                row, _, anchor, *_ = _windows(*utf8(b.column("text")))
                if not len(row):
                    continue
                # each anchor of a document once
                order = np.lexsort((anchor, row))
                row, anchor = row[order], anchor[order]
                new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
                kept.append((anchor[new], row[new] + base))
                ids.append(b.column("id").to_numpy(zero_copy_only=False))
                ths.append(b.column("th").to_numpy(zero_copy_only=False))
                base, size = base + b.num_rows, size + len(kept[-1][0])
                if size > COMBINED:
                    yield from flush()
                    base = size = 0
        if kept:
            yield from flush()

    def test(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        done = t.filter(pa.compute.is_valid(t.column("marked"))).select(["id", "th", "marked"])
        many = [_widened(np.frombuffer(x.as_buffer(), np.uint8)) for x in t.column("more") if x.is_valid]
        t = t.filter(pa.compute.is_valid(t.column("once")))
        read = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in t.column(name)]
        low = [_widened(x) for x in read("once", np.uint8)]
        count = [np.zeros(1 << bits, np.uint8) for _ in range(ROWS)]
        for r in range(ROWS):
            # the sketch of a partition is added to the slice's, which stops at two
            for x in low:
                cell, n = np.unique(_cells(x, r, bits), return_counts=True)
                count[r][cell] = np.minimum(count[r][cell] + np.minimum(n, 2), 2)
            for x in many:
                count[r][_cells(x, r, bits)] = 2
        out: list = []
        for x, doc, ids, ths in zip(low, read("doc", "<u4"), read("ids", np.int64), read("ths", np.int64)):
            often = np.logical_and.reduce([count[r][_cells(x, r, bits)] == 2 for r in range(ROWS)])
            x = x[often]
            out += [(int(ids[d]), int(ths[d]), _low(x[p:q])) for d, p, q in _by_number(doc[often].astype(np.int64))]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.concat_tables([done, pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["id", "th", "marked"])])

    sparse = docs.mapInArrow(sketch, _SKETCH_SQL)
    return sparse.groupBy("slice").applyInArrow(test, "id long, th long, marked binary")


def _widened(low: np.ndarray) -> np.ndarray:
    """5-byte numbers as 64-bit ones."""
    out = np.zeros((len(low) // 5, 8), np.uint8)
    out[:, :5] = low.reshape(-1, 5)
    return out.view(np.uint64).ravel()


def _runs(pos: np.ndarray) -> bytes:
    """Sorted places as pairs of first and last."""
    cut = np.flatnonzero(np.diff(pos) > 1)
    return np.column_stack([np.concatenate([pos[:1], pos[cut + 1]]), np.concatenate([pos[cut], pos[-1:]])]).astype("<u4").tobytes()


def _often(row: np.ndarray, anchor: np.ndarray, marked: pa.Array) -> np.ndarray:
    """Which windows stand under a marked anchor of their document."""
    lists = [(r, _widened(np.frombuffer(x.as_buffer(), np.uint8))) for r, parts in enumerate(marked) if parts.is_valid for x in parts.values]
    if not lists:
        return np.zeros(len(row), bool)
    low = np.uint64((1 << 40) - 1)
    with np.errstate(over="ignore"):
        key = lambda a, r: mix((a & low) + np.asarray(r).astype(np.uint64) * _ODD[0])
        return np.isin(key(anchor, row), np.concatenate([key(x, r) for r, x in lists]))


def _later(g, g2, ids):
    """Which windows also stand in a document with a smaller id."""
    order = np.lexsort((ids, g2, g))
    a, b, i = g[order], g2[order], ids[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    least = i[new][np.cumsum(new) - 1]
    out = np.zeros(len(ids), bool)
    out[order] = i > least
    return out


_PART = pa.schema([("shard", pa.int32()), ("id", pa.int64()), ("th", pa.int64()), ("runs", pa.binary()), ("g", pa.binary()), ("g2", pa.binary()), ("pos", pa.binary()), ("doc", pa.binary()), ("ids", pa.binary()), ("ths", pa.binary())])
_PART_SQL = "shard int, id long, th long, runs binary, g binary, g2 binary, pos binary, doc binary, ids binary, ths binary"


def _split_later(docno, pos, ids, ths):
    """(id, th, runs) for each document of some windows to be removed."""
    order = np.lexsort((pos, docno))
    docno, pos = docno[order], pos[order]
    bounds = np.flatnonzero(np.concatenate([[True], docno[1:] != docno[:-1], [True]])) if len(docno) else []
    for x, y in zip(bounds[:-1], bounds[1:]):
        d = docno[x]
        yield int(ids[d]), int(ths[d]), _runs(pos[x:y])


def removals(marked: DataFrame, groups: int) -> DataFrame:
    """(id, th, runs) of windows to be removed; several rows for a document. marked: (id, th, text, marks, copies), no null id."""

    def combine(batches):
        """Windows estimated repeated, resolved among themselves; the rest goes out by its own hash."""

        def flush():
            g, g2, shard, doc, pos = (np.concatenate(c) for c in zip(*kept))
            ids, ths = np.array(own_ids, np.int64), np.array(own_ths, np.int64)
            late = _later(g, g2, ids[doc])
            rows = [((i + t) % groups, i, t, r, *[None] * 6) for i, t, r in _split_later(doc[late], pos[late], ids, ths)]
            g, g2, shard, doc, pos = (c[~late] for c in (g, g2, shard, doc, pos))
            order = np.lexsort((pos, doc, shard))
            g, g2, shard, doc, pos = (c[order] for c in (g, g2, shard, doc, pos))
            part, at = np.unique(shard, return_index=True)
            for p, x, y in zip(part.tolist(), at.tolist(), [*at[1:].tolist(), len(shard)]):
                used, local = np.unique(doc[x:y], return_inverse=True)
                rows.append((p, None, None, None, g[x:y].tobytes(), g2[x:y].tobytes(), pos[x:y].astype("<u4").tobytes(), local.astype("<u4").tobytes(), ids[used].tobytes(), ths[used].tobytes()))
            kept.clear()
            own_ids.clear()
            own_ths.clear()
            for k in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 2000]), _PART)], schema=_PART)

        kept: list = []
        own_ids: list = []
        own_ths: list = []
        for big in batches:
            for b in batch_slices(big):
                buf, off = utf8(b.column("text"))
                row, pos, anchor, h, at, bounds = _windows(buf, off)
                often = _often(row, anchor, b.column("marks"))
                if not often.any():
                    continue
                row, pos, at = row[often], pos[often], at[often]
                g = grams(h, WINDOW, 0xC2B2AE3D27D4EB4F)[at]
                g2 = (grams(hash_words(buf, *bounds, other=True), WINDOW, 0x27D4EB2F165667C5)[at] >> np.uint64(32)).astype("<u4")
                shard = (mix(g ^ _ODD[1]) % np.uint64(groups)).astype(np.int64)
                used, local = np.unique(row, return_inverse=True)
                base = len(own_ids)
                own_ids += b.column("id").take(pa.array(used)).to_pylist()
                own_ths += b.column("th").take(pa.array(used)).to_pylist()
                kept.append((g, g2, shard, local + base, pos))
                if sum(len(k[0]) for k in kept) > COMBINED:
                    yield from flush()
        if kept:
            yield from flush()

    def resolve(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        done = t.filter(pa.compute.is_valid(t.column("runs"))).select(["id", "th", "runs"])
        t = t.filter(pa.compute.is_null(t.column("runs")))
        out = []
        if t.num_rows:
            read = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in t.column(name)]
            ids, ths, doc = read("ids", np.int64), read("ths", np.int64), read("doc", "<u4")
            base = np.cumsum([0, *[len(x) for x in ids]])
            doc = np.concatenate([d + o for d, o in zip(doc, base)])
            ids, ths = np.concatenate(ids), np.concatenate(ths)
            late = _later(np.concatenate(read("g", np.uint64)), np.concatenate(read("g2", "<u4")), ids[doc])
            out = list(_split_later(doc[late], np.concatenate(read("pos", "<u4")).astype(np.int64)[late], ids, ths))
        columns = list(zip(*out)) or [(), (), ()]
        return pa.concat_tables([done, pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["id", "th", "runs"])])

    return marked.mapInArrow(combine, _PART_SQL).groupBy("shard").applyInArrow(resolve, "id long, th long, runs binary")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, slices: int | None = None, bits: int = BITS) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept]) for every row.

    A word goes if it is in a window whose words also start in a document with a smaller id. Rows
    with equal ids never remove from each other, rows without an id neither remove nor lose words; null and empty
    texts have no words; an empty table gives an empty result. Windows are compared by 96 bits of hash. Ids are integers.
    """
    need_integer_ids(docs, id_col)
    # keys are never null, so that no filter for one join's sake parts the uses of the dealt texts
    source = docs.select(F.col(id_col).isNotNull().alias("has_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # without an id the hash is of another kind, so that the text meets none of the document whose id stands there
    source = source.withColumn("th", F.when(F.col("has_id"), F.xxhash64("text")).otherwise(F.xxhash64("text", "has_id")))
    chars = source.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    own = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # about one anchor for 28 characters
    slices = slices or max(own, LEAST_GROUPS, -(-chars // (28 * SLICE)))
    # rows with one id and text are one from here to the end; the texts move once, as all joins are on the keys they are dealt by
    key = ["id", "th"]
    one = source.groupBy(*key).agg(F.first("has_id").alias("has_id"), F.first("text").alias("text"), F.count("*").alias("copies"))
    found = marks(one, slices, bits).groupBy(*key).agg(F.collect_list("marked").alias("marks"))
    # all columns go along, so that each use of the dealt texts is the same
    marked = one.join(found, key).select("id", "th", "text", "marks", "copies", "has_id")
    gone = removals(marked, max(LEAST_GROUPS, -(-chars // (6 * GROUPED)))).groupBy(*key).agg(F.collect_list("runs").alias("runs"))
    kind = docs.schema[id_col].dataType

    def cut(batches):
        for b in batches:
            n, lost, digest, kept = [], [], [], []
            for text, runs in zip(b.column("text"), b.column("runs")):
                words = text.as_py().encode().split()
                n.append(len(words))
                if runs.is_valid and len(words):
                    cover = np.zeros(len(words) + WINDOW + 1, np.int32)
                    for r in runs.as_py():
                        pair = np.frombuffer(r, "<u4").reshape(-1, 2).astype(np.int64)
                        np.add.at(cover, pair[:, 0], 1)
                        np.add.at(cover, pair[:, 1] + WINDOW, -1)
                    keep = np.cumsum(cover)[: len(words)] == 0
                    words = [words[k] for k in np.flatnonzero(keep)]
                lost.append(n[-1] - len(words))
                whole = b" ".join(words)
                digest.append(hashlib.sha256(whole).hexdigest())
                if with_text:
                    kept.append(whole.decode())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("has_id"), b.column("copies"), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(digest, pa.string()), *([pa.array(kept, pa.string())] if with_text else [])], names=["id", "has_id", "copies", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text])

    joined = one.join(gone, key, "left").select("id", "has_id", "copies", "text", "runs")
    cleaned = joined.mapInArrow(cut, "id long, has_id boolean, copies long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
    every = cleaned.withColumn("id", F.when(F.col("has_id"), F.col("id")).cast(kind)).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return every.drop("has_id", "copies", "copy")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated passages; see ``deduplicate`` for nulls and repeats."""
    return deduplicate(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
