"""Hard negatives: threshold joins of anchors with all rows, by an inverted index that leaves out what norms cover."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pramana.llm._spark import need_integer_ids, table

ANCHOR_EVERY, SHIFT_EVERY, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is between these hundredths of the positive's.
LOWEST, HIGHEST = 30, 90
STEPS = 256
#: Components from here on would let scores outgrow a long.
TOO_LARGE = 1 << 28
#: Rows that one task holds against all anchors, at least and at most; they follow the number of cores in between.
FEWEST_ROWS, MOST_ROWS = 1 << 12, 1 << 18
#: Rows of one index, anchors searched at once, dimensions between two prunings.
BLOCK, ANCHORS, CHUNK = 8192, 256, 16
#: Shares of the way from a threshold's least to its highest value at which it is tried in turn.
LEVELS = (0.9, 0.7, 0.5, 0.3, 0.15, 0.0)
_NEVER = np.iinfo(np.int64).min


def quantized(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """(id, label, v) of the rows that take part: v holds floor(STEPS x) of each component as 32-bit integers."""
    need_integer_ids(df, id_col)

    def run(batches):
        for b in batches:
            vec = b.column("vec")
            flat = vec.flatten()
            x = np.floor(STEPS * flat.to_numpy(zero_copy_only=False).astype(np.float64))
            fine = np.isfinite(x) & (np.abs(x) < TOO_LARGE)
            to = np.cumsum(np.diff(vec.offsets.to_numpy()) if len(vec) else np.zeros(0, np.int64))
            bad = np.append(0, np.cumsum(~fine))
            at = np.append(0, to)
            keep = np.flatnonzero(bad[at[1:]] == bad[at[:-1]])
            v = np.where(fine, x, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(keep)), b.column("label").take(pa.array(keep)), pa.array([v[at[k] : at[k + 1]].tobytes() for k in keep.tolist()], pa.binary())], names=["id", "label", "v"])

    named = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    whole = named.where("id is not null and label is not null and vec is not null")
    label = F.when(F.col("id") % SHIFT_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return whole.select("id", label.alias("label"), "vec").mapInArrow(run, "id long, label long, v binary")


def _matrix(vectors: list[bytes], width: int = 0) -> np.ndarray:
    """Vectors as rows; a shorter one ends in zeros."""
    size = np.array([len(v) // 4 for v in vectors], np.int64)
    width = max(width, int(size.max(initial=1)))
    out = np.zeros((len(vectors), width), np.int32)
    flat = np.frombuffer(b"".join(vectors), np.int32)
    if len(flat) == out.size:
        return flat.reshape(out.shape)
    out[np.arange(width) < size[:, None]] = flat
    return out


class Index:
    """Inverted lists of one block of rows: for each stretch of dimensions the rows that have not left it out."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels = ids, labels
        self._index(x)

    def widen(self, width: int) -> None:
        """Room for anchors with more components: the rows have zeros there."""
        if width > self.x.shape[1]:
            x = np.zeros((len(self.ids), width), np.int64)
            x[:, self.dims] = self.x
            self._index(x)

    def _index(self, x: np.ndarray) -> None:
        self.dims = np.argsort(-(x.astype(np.float64) ** 2).sum(axis=0), kind="stable")
        self.x = x[:, self.dims].astype(np.int64)
        self.peak = int(np.abs(self.x).max(initial=0))
        self.chunks = [slice(c, c + CHUNK) for c in range(0, x.shape[1], CHUNK)]
        self.norms = self._norms(self.x)
        self.real = self.x.astype(np.float64)

    def _norms(self, x: np.ndarray) -> np.ndarray:
        """Norms of what follows each stretch: column c is that of the dimensions from stretch c on."""
        squares = np.array([(x[:, c].astype(np.float64) ** 2).sum(axis=1) for c in self.chunks]).reshape(len(self.chunks), len(x))
        return np.sqrt(np.vstack([np.cumsum(squares[::-1], axis=0)[::-1], np.zeros((1, len(x)))])).T

    def above(self, q: np.ndarray, t: np.ndarray):
        """(anchor, row, score) of exactly the pairs whose score is at least the anchor's threshold.

        A row leaves out its last stretches once the norm of what is left, times the largest norm of
        the anchors there, stays below the lowest threshold. Scores are added up list by list; a pair
        goes as soon as its part and the product of both remaining norms stay below its threshold. What
        a row has left out is added to the pairs that are still there.
        """
        q = q[:, self.dims]
        norms = self._norms(q)
        exact = q.shape[1] * self.peak * int(np.abs(q).max(initial=0)) < 1 << 53
        x = self.real if exact else self.x
        q = q.astype(x.dtype)
        slack = 1e-9 * norms[:, :1] * (self.norms[:, 0].max(initial=0) + 1) + 1e-6
        covered = self.norms * norms.max(axis=0) + slack.max() < t.min()
        ends = np.where(covered.any(axis=1), covered.argmax(axis=1), len(self.chunks))
        order = np.argsort(-ends, kind="stable")
        ends = ends[order]
        acc = np.zeros((len(q), int((ends > 0).sum())), x.dtype)
        a = r = None
        for c, dims in enumerate(self.chunks):
            if a is None:
                m = int((ends > c).sum())
                acc[:, :m] += q[:, dims] @ x[order[:m], dims].T
                left = np.minimum(ends[: acc.shape[1]], c + 1)
                alive = acc + norms[:, left] * self.norms[order[: acc.shape[1]], left] + slack >= t[:, None]
                if alive.sum() * 8 <= alive.size or c + 1 == len(self.chunks):
                    a, r = np.nonzero(alive)
                    part = acc[a, r]
            else:
                on = ends[r] > c
                part[on] += np.einsum("ij,ij->i", q[a[on], dims], x[order[r[on]], dims])
                left = np.minimum(ends[r], c + 1)
                live = part + norms[a, left] * self.norms[order[r], left] + slack[a, 0] >= t[a]
                a, r, part = a[live], r[live], part[live]
        if a is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for c, dims in enumerate(self.chunks):
            off = ends[r] <= c
            if off.any():
                part[off] += np.einsum("ij,ij->i", q[a[off], dims], x[order[r[off]], dims])
        part = part.astype(np.int64)
        live = part >= t[a]
        return a[live], order[r[live]], part[live]


class Windows:
    """The first ``k`` of each window by score, then id, as they are found."""

    def __init__(self, n: int, k: int):
        self.k, self.last = k, np.full(n, _NEVER)
        self.window = self.score = self.id = np.zeros(0, np.int64)

    def add(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        w, s, i = (np.concatenate(x) for x in ((self.window, window), (self.score, score), (self.id, ids)))
        order = np.lexsort((i, -s, w))
        w, s, i = w[order], s[order], i[order]
        nth = np.arange(len(w)) - np.searchsorted(w, w, "left")
        first = nth < self.k
        self.window, self.score, self.id = w[first], s[first], i[first]
        full = nth == self.k - 1
        self.last[w[full]] = s[full]


def search(blocks: list[Index], ids: np.ndarray, labels: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> Windows:
    """The first ``k`` rows of each of an anchor's windows [low, high], of its own label or of others.

    Thresholds start high and are lowered until each window has ``k`` rows above them or its end is
    reached; from block to block they start at the k-th score that is known already.
    """
    n, per = low.shape
    found = Windows(n * per, k)
    valid = low <= high
    for block in blocks:
        top = np.ceil(np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)) * block.norms[:, 0].max(initial=0)).astype(np.int64)[:, None] + 1
        from_, to = np.maximum(low, -top), np.minimum(high, top)
        before = np.full(n, np.iinfo(np.int64).max)
        open_ = np.flatnonzero((valid & (from_ <= to)).any(axis=1))
        for level in LEVELS:
            if not len(open_):
                break
            last = found.last.reshape(n, per)[open_]
            lo, hi = from_[open_], to[open_]
            step = np.where(level, lo + np.floor((hi - lo) * level).astype(np.int64), lo)
            wanted = np.where(valid[open_] & (lo <= hi), np.maximum(lo, np.where(last > _NEVER, last, step)), np.iinfo(np.int64).max)
            t = wanted.min(axis=1)
            a, r, s = block.above(q[open_], t)
            new = (s < before[open_[a]]) & ((block.labels[r] == labels[open_[a]]) == same) & (block.ids[r] != ids[open_[a]])
            a, r, s = open_[a[new]], r[new], s[new]
            for j in range(per):
                inside = (low[a, j] <= s) & (s <= high[a, j])
                found.add(a[inside] * per + j, s[inside], block.ids[r[inside]])
            before[open_] = t
            last = found.last.reshape(n, per)[open_]
            ready = ~(valid[open_] & (lo <= hi)) | (last >= t[:, None]) | (t[:, None] <= lo)
            open_ = open_[~ready.all(axis=1)]
    return found


def _deal(rows: DataFrame, anchors: DataFrame, groups: int) -> DataFrame:
    """Rows in ``groups`` tasks by id, all anchors after them in each task."""
    none = F.lit(None).cast("array<struct<id:bigint,score:bigint>>")
    mine = rows.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("kind"), "id", "label", "v", none.alias("positives"))
    theirs = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("kind"), "id", "label", "v", "positives")
    return mine.unionByName(theirs).repartitionById(groups, F.col("g")).sortWithinPartitions("g", "kind", "id", "label", "v")


def _blocks(held: list[pa.RecordBatch]) -> list[Index]:
    """Indexes over the rows of a task, the first row of each id."""
    if not held:
        return []
    t = pa.Table.from_batches(held)
    ids = t["id"].to_numpy()
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    labels, v = t["label"].to_numpy(), t["v"].combine_chunks()
    return [Index(ids[at], labels[at], _matrix([x.as_py() for x in v.take(pa.array(at))])) for at in np.split(first, range(BLOCK, len(first), BLOCK))]


def _search_with(windows):
    """A task over sorted rows and anchors: ``windows`` tells low, high and names of an anchor batch's windows."""

    def run(batches):
        held, blocks, at = [], None, None
        for b in batches:
            g, kind = b.column("g").to_numpy(), b.column("kind").to_numpy()
            key = g.astype(np.int64) * 2 + kind
            for a, z in zip(*(lambda cut: (cut[:-1], cut[1:]))(np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]).tolist())):
                if a == z:
                    continue
                if g[a] != at:
                    held, blocks, at = [], None, g[a]
                part = b.slice(a, z - a)
                if not kind[a]:
                    held.append(part.select(["id", "label", "v"]))
                    continue
                if blocks is None:
                    blocks, held = _blocks(held), []
                width = max([x.x.shape[1] for x in blocks], default=0)
                for few in range(0, part.num_rows, ANCHORS):
                    some = part.slice(few, ANCHORS)
                    q = _matrix([x.as_py() for x in some.column("v")], width)
                    for x in blocks:
                        x.widen(q.shape[1])
                    if blocks:
                        yield from windows(blocks, some, q.astype(np.int64))

    return run


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and positive.

    Rows with a null id, label, vector or component, with a component that is not finite, or one of
    2^20 or more (its scores could outgrow a long) take no part. Of rows with one id the first by
    label, then vector takes part. A shorter vector ends in zeros; an empty one has score 0 with all.
    Ties go to the smaller id. An anchor without a row of its label, or whose positive scores below
    zero, gives no rows, an empty table none at all. Other columns are not read.

    Rows are dealt to tasks by id, so that no label, however frequent, is in one task; each task
    indexes its rows and lets all anchors pass, batch by batch, keeping the first of each window.
    """
    rows = quantized(vectors, id_col, label_col, vec_col)
    n = rows.count()
    groups = max(1, -(-n // min(max(FEWEST_ROWS, n // (4 * vectors.sparkSession.sparkContext.defaultParallelism)), MOST_ROWS)))
    one = rows.where(F.col("id") % ANCHOR_EVERY == 0).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    none = F.lit(None).cast("array<struct<id:bigint,score:bigint>>")

    def positives(blocks, some, q):
        ids, labels = some.column("id").to_numpy(), some.column("label").to_numpy()
        ends = np.iinfo(np.int64)
        w = search(blocks, ids, labels, q, np.full((len(ids), 1), ends.min), np.full((len(ids), 1), ends.max), True, POSITIVES)
        yield pa.RecordBatch.from_arrays([pa.array(ids[w.window]), pa.array(w.id), pa.array(w.score)], names=["anchor", "id", "score"])

    def negatives(blocks, some, q):
        ids, labels = some.column("id").to_numpy(), some.column("label").to_numpy()
        known = some.column("positives")
        size = np.diff(known.offsets.to_numpy())
        name, score = (known.flatten().field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        pid, ps = np.zeros((len(ids), POSITIVES), np.int64), np.full((len(ids), POSITIVES), -1)
        inside = np.arange(POSITIVES) < size[:, None]
        pid[inside], ps[inside] = name, score
        low = np.array([-(-LOWEST * int(s) // 100) for s in ps.ravel()], np.int64).reshape(ps.shape)
        high = np.array([HIGHEST * int(s) // 100 for s in ps.ravel()], np.int64).reshape(ps.shape)
        w = search(blocks, ids, labels, q, low, high, False, NEGATIVES)
        a, j = np.divmod(w.window, POSITIVES)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[a], pid[a, j], w.id, ps[a, j], w.score)], names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    near = _deal(rows, one.withColumn("positives", none), groups).mapInArrow(_search_with(positives), "anchor long, id long, score long")
    by_anchor = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    near = near.withColumn("nth", F.row_number().over(by_anchor)).where(F.col("nth") <= POSITIVES)
    known = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "score"))).alias("p"))
    known = known.select(F.col("anchor").alias("id"), F.transform("p", lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score"))).alias("positives"))
    mined = _deal(rows, one.join(known, "id"), groups).mapInArrow(_search_with(negatives), "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    by_pair = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return mined.withColumn("rank", F.row_number().over(by_pair)).where(F.col("rank") <= NEGATIVES).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor among all ``embeddings``; see ``hard_negatives`` for nulls, ties and repeats."""
    return hard_negatives(table(spark, sf_dir, "embeddings"))
