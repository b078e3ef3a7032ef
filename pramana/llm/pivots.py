"""Near-duplicate vectors: an index of pivot permutations, inverted lists of shared pivots, verified cosines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from pramana.llm._graph import components
from pramana.llm._spark import checkpoint, need_integer_ids, table

COSINE = 0.95
#: A vector is described by so many nearest pivots; pairs that share SHARED of them are verified.
PREFIX, SHARED = 7, 2
#: Pivots: about four times the root of the number of vectors, within these, and no more than so many numbers in all.
FEWEST, MOST, NUMBERS = 128, 4096, 1 << 22
#: Pivots are drawn from so many times their number of vectors; one this close to an earlier pivot is left out.
DRAWN, SPREAD = 4, 0.85
#: A list of more vectors than this is cut into tiles of so many, and its core is not compared with itself.
CROWD = 1024
#: Pairs whose owners are looked up at once.
PAIRS = 1 << 17
_CORE = np.arccos(COSINE) / 2 - 1e-7


def _matrix(column: pa.Array, kind: type, width: int = 0) -> np.ndarray:
    """Binary vectors as rows of doubles; a shorter one ends in zeros."""
    vectors = [x.as_py() for x in column]
    size = np.array([len(v) // np.dtype(kind).itemsize for v in vectors], np.int64)
    width = max(width, int(size.max(initial=1)))
    out = np.zeros((len(vectors), width))
    out[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(vectors), kind)
    return out


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length one, without overflow on the way."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(float).tiny)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _valid(df: DataFrame, id_col: str, vec_col: str, kind: type) -> DataFrame:
    """(id, v) of every row; v is null where the vector links with nothing, zeros at a vector's end are cut."""

    def run(batches):
        for b in batches:
            vec = b.column("vec")
            out = []
            for x in vec:
                v = None if x.values is None else x.values.to_numpy(zero_copy_only=False).astype(kind)
                held = np.flatnonzero(v) if v is not None and not x.values.null_count and np.isfinite(v).all() else []
                out.append((v[: held[-1] + 1] + kind(0)).tobytes() if len(held) else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], names=["id", "v"])

    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("vec")).mapInArrow(run, "id long, v binary")


def _key(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.int64) * MOST + high


def spread(drawn: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` that are not close to one before them; where fewer than PREFIX are left, others follow.

    So a group of near copies, however large, gives one pivot, not a crowd of pivots whose order is noise.
    """
    chosen = np.zeros(len(drawn), bool)
    nearest = np.full(len(drawn), -1.0)
    for k in range(len(drawn)):
        if nearest[k] < SPREAD:
            chosen[k] = True
            if chosen.sum() == most:
                break
            nearest = np.maximum(nearest, drawn @ drawn[k])
    rest = np.flatnonzero(~chosen)[: max(0, PREFIX - chosen.sum())]
    chosen[rest] = True
    return drawn[chosen]


def _described(nodes: DataFrame, pivots: np.ndarray, kind: type) -> DataFrame:
    """``nodes`` with the numbers of their nearest pivots, sorted, and a key for each two of them."""
    sent = nodes.sparkSession.sparkContext.broadcast(pivots)
    k = min(PREFIX, len(pivots))
    first, second = np.triu_indices(k, 1)

    def run(batches):
        for b in batches:
            pivots = sent.value
            x = _units(_matrix(b.column("v"), kind, pivots.shape[1]))
            near = x[:, : pivots.shape[1]] @ pivots.T
            ordered = np.argpartition(-near, k - 1, axis=1)[:, :k] if k else np.zeros((len(x), 0), np.int64)
            prefix = np.sort(ordered, axis=1).astype(np.int16)
            keys = _key(prefix[:, first], prefix[:, second])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([p.tobytes() for p in prefix], pa.binary()), lists], names=[*b.schema.names, "prefix", "keys"])

    return nodes.mapInArrow(run, "node long, least long, copies long, v binary, prefix binary, keys array<long>")


def _owners(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The key at which each pair of prefixes is counted: of its two smallest shared pivots."""
    shared = (a[:, :, None] == b[:, None, :]).any(axis=2)
    at = np.arange(len(a))
    first = shared.argmax(axis=1)
    shared[at, first] = False
    return _key(a[at, first], a[at, shared.argmax(axis=1)])


def _linked(key: int, node, copies, core, prefix, x, side):
    """Links between the vectors of one list or of two of its tiles: (node, links, smallest node around it here)."""
    left, right = (np.flatnonzero(side == s) for s in (0, 1))
    within = not len(right)
    if within:
        right = left
    a, b = [], []
    for at in range(0, len(left), CROWD):
        rows = left[at : at + CROWD]
        close = x[rows] @ x[right].T >= COSINE
        close &= (core[rows][:, None] != core[right]) | (core[right] < 0)
        i, j = np.nonzero(close)
        i, j = rows[i], right[j]
        if within:
            i, j = i[i < j], j[i < j]
        for few in range(0, len(i), PAIRS):
            p, q = i[few : few + PAIRS], j[few : few + PAIRS]
            own = _owners(prefix[p], prefix[q]) == key
            a.append(p[own])
            b.append(q[own])
    a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b))
    links = np.bincount(a, copies[b], len(node)).astype(np.int64) + np.bincount(b, copies[a], len(node)).astype(np.int64)
    order = np.argsort(node, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    a, b, label = place[a], place[b], np.arange(len(order))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    some = np.flatnonzero(links)
    return node[some], links[some], node[order[label[place[some]]]]


def _links(tiles: DataFrame, kind: type) -> DataFrame:
    """(node, links, root) from vectors dealt by (key, i, j); a group is one list of at most CROWD vectors or two tiles."""

    def close(group):
        t = pa.Table.from_batches(group)
        key, i, j = (t[c][0].as_py() for c in ("key", "i", "j"))
        width = len(t["prefix"][0].as_py()) // 2
        prefix = np.frombuffer(b"".join(x.as_py() for x in t["prefix"]), np.int16).reshape(-1, width)
        numbers = [t[c].to_numpy() for c in ("node", "copies", "core")]
        found = _linked(key, *numbers, prefix, _units(_matrix(t["v"], kind)), t["side"].to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "links", "root"])

    def run(batches):
        held, at = [], None
        for b in batches:
            cols = [b.column(c).to_numpy() for c in ("key", "i", "j")]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for a, z in zip([0, *new.tolist()], [*new.tolist(), b.num_rows]):
                if a == z:
                    continue
                here = tuple(int(c[a]) for c in cols)
                if here != at and held:
                    yield close(held)
                    held = []
                at = here
                held.append(b.slice(a, z - a))
        if held:
            yield close(held)

    dealt = tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "node long, links long, root long")


def _cores(listed: DataFrame, crowded: DataFrame, kind: type) -> DataFrame:
    """(node, core) of vectors within half the link's angle of the mean of a crowded list: any two of a core are linked."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            keys, x = b.column("key").to_numpy(), _units(_matrix(b.column("v"), kind))
            for k in np.unique(keys).tolist():
                s = x[keys == k].sum(axis=0)
                if k in sums and len(sums[k]) != len(s):
                    width = max(len(s), len(sums[k]))
                    s, sums[k] = (np.pad(v, (0, width - len(v))) for v in (s, sums[k]))
                sums[k] = sums[k] + s if k in sums else s
            if len(sums) > CROWD:
                yield from given(sums)
                sums = {}
        yield from given(sums)

    def given(sums):
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["key", "part"])

    def total(key, parts):
        s = _matrix(parts["part"], np.float64).sum(axis=0)
        return pa.table({"key": [key[0].as_py()], "centre": [s.tobytes()]})

    def inside(batches):
        for b in batches:
            c = _matrix(b.column("centre"), np.float64)
            x = _matrix(b.column("v"), kind, c.shape[1])
            c = np.pad(c, ((0, 0), (0, x.shape[1] - c.shape[1])))
            length = np.sqrt((c * c).sum(axis=1))
            cosine = (_units(x) * c).sum(axis=1) / np.where(length, length, 1)
            near = pa.array(np.flatnonzero(np.arccos(np.clip(cosine, -1, 1)) <= _CORE))
            yield b.select(["node", "key", "n"]).take(near)

    hot = listed.select("key", "node", "v").join(crowded, "key")
    parts = hot.select("key", "v").mapInArrow(add, "key long, part binary")
    centres = checkpoint(parts.groupBy("key").applyInArrow(total, "key long, centre binary"))
    members = hot.join(centres, "key").select("node", "key", "n", "v", "centre").mapInArrow(inside, "node long, key long, n long")
    return checkpoint(members.groupBy("node").agg(F.max(F.struct("n", "key")).alias("m")).select("node", F.col("m.key").alias("core")))


def _tiled(listed: DataFrame, crowded: DataFrame) -> DataFrame:
    """Vectors of crowded lists in tiles, every two of which meet once; tiles of one core do not meet."""
    met = listed.join(crowded.select("key"), "key")
    sizes = met.groupBy("key", "core").agg(F.count("*").alias("n")).select("key", F.struct("core", F.ceil(F.col("n") / CROWD).cast("int").alias("tiles")).alias("s"))
    plan = sizes.groupBy("key").agg(F.sort_array(F.collect_list("s")).alias("plan"))
    before = F.aggregate("plan", F.lit(0), lambda n, s: n + F.when(s["core"] < F.col("core"), s["tiles"]).otherwise(0))
    own = F.aggregate("plan", F.lit(0), lambda n, s: n + F.when(s["core"] == F.col("core"), s["tiles"]).otherwise(0))
    every = F.aggregate("plan", F.lit(0), lambda n, s: n + s["tiles"])
    placed = met.join(plan, "key").withColumns({"first": before, "own": own, "every": every}).withColumn("tile", F.col("first") + F.pmod(F.xxhash64("node"), F.col("own")).cast("int"))
    apart = lambda t: (F.col("core") < 0) | (t < F.col("first")) | (t >= F.col("first") + F.col("own"))
    other = F.filter(F.sequence(F.lit(0), F.col("every") - 1), apart)
    dealt = placed.withColumn("other", F.explode(other))
    return dealt.select("key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), (F.col("tile") > F.col("other")).cast("int").alias("side"), "node", "copies", "core", "prefix", "v")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component) for every row of ``vectors``.

    Links are pairs with a cosine of COSINE or more that the index finds: those that share SHARED of
    their PREFIX nearest pivots; none below it. Rows with equal vectors are linked with each other. Null and
    zero vectors and those with null or non-finite components link with nothing. A shorter vector ends in
    zeros. The component is the smallest id reachable, null for rows without ids that reach none; repeated
    ids count as rows of their own. An empty table gives an empty result. Other columns are not read.

    Pivots are the vectors with the smallest hashes that are no near copies of each other. Equal vectors are one node. Lists are keyed by two
    shared pivots; a pair is counted at its smallest key. A list of more than CROWD is cut into tiles;
    its core, any two of which are linked for sure, is counted by its size and compared with others only.
    """
    need_integer_ids(vectors, id_col)
    kind = np.float32 if vectors.schema[vec_col].dataType == ArrayType(FloatType(), vectors.schema[vec_col].dataType.containsNull) else np.float64
    named = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast(f"array<{'float' if kind is np.float32 else 'double'}>").alias("vec"))
    rows = _valid(named, "id", "vec", kind)
    distinct = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    # numbers stand once they are written
    nodes = checkpoint(distinct.select(F.monotonically_increasing_id().alias("node"), "least", "copies", "v"))
    n, longest = nodes.agg(F.count("*"), F.coalesce(F.max(F.length("v")), F.lit(0))).first()
    width = max(1, longest // np.dtype(kind).itemsize)
    wanted = max(2, min(MOST, max(FEWEST, 1 << int(np.ceil(np.log2(4 * np.sqrt(n) + 1)))), NUMBERS // (DRAWN * width)))
    sample = nodes.select("v").orderBy(F.xxhash64("v"), "v").limit(DRAWN * wanted).toArrow()["v"]
    index = checkpoint(_described(nodes, spread(_units(_matrix(sample, kind)), wanted), kind))

    listed = index.select(F.explode("keys").alias("key"), "node", "copies", "prefix", "v")
    sizes = checkpoint(listed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    crowded, few = sizes.where(F.col("n") > CROWD), sizes.where(F.col("n") <= CROWD)
    alone = F.lit(-1).cast("long")
    core = _cores(listed, crowded, kind) if not crowded.isEmpty() else None
    whole = listed.withColumn("core", alone) if core is None else listed.join(core, "node", "left").withColumn("core", F.coalesce("core", alone))
    zero = F.lit(0)
    tiles = whole.join(few.select("key"), "key").select("key", zero.alias("i"), zero.alias("j"), zero.alias("side"), "node", "copies", "core", "prefix", "v")
    if core is not None:
        tiles = tiles.unionByName(_tiled(whole, crowded))
    links = checkpoint(_links(tiles, kind))
    edges, counted = links.select(F.col("node").alias("a"), F.col("root").alias("b")), links.select("node", "links")
    if core is not None:
        inside = index.select("node", "copies").join(core, "node")
        sums = inside.groupBy("core").agg(F.sum("copies").alias("size"), F.min("node").alias("root"))
        joined = checkpoint(inside.join(sums, "core"))
        edges = edges.union(joined.select(F.col("node").alias("a"), F.col("root").alias("b")))
        counted = counted.union(joined.select("node", (F.col("size") - F.col("copies")).alias("links")))

    found = components(edges)
    total = counted.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = nodes.join(total, "node", "left").join(found, "node", "left").select("v", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_vector = rooted.join(lowest, "root").select("v", "n_links", "component")
    linked = rows.where("v is not null").join(by_vector, "v").select("id", "n_links", "component")
    return linked.unionByName(rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))


def op13_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all ``embeddings``; see ``near_vectors`` for nulls, repeats and empty tables."""
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
