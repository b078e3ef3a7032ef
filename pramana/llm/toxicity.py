"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Each word has a word input (its hash) and a character input (the mean over every byte of the word of that byte
with its two neighbours, hashed). The network reads overlapping windows of words; a document scores as its
worst window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pramana.llm._spark import table
from pramana.llm._text import LOWER, batch_slices, hash_words, mix, split_words, utf8
from pramana.llm.decontaminate import SEPARATOR

WINDOW, STRIDE = 32, 16
BUCKETS, DIM, HIDDEN = 8192, 8, 8
#: Bound of the training sample: rows of each label, whole texts of any length.
ROWS = 1200
#: Passes over the sample, more if it is small: at least so many steps are taken.
EPOCHS, BATCH, RATE, STEPS = 4, 16, 0.01, 500
THRESHOLD = 0.7
#: Windows, and words, that are scored together; a longer text is read in parts that share the windows' overlap.
TOGETHER, SEGMENT = 2048, 65_536


def inputs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket number of each word, of each byte between its neighbours in the word, and bytes of each word. Bucket 0 is padding."""
    span = np.uint64(BUCKETS - 1)
    word = (hash_words(buf, starts, ends) % span).astype(np.int32) + 1
    size = ends - starts
    to = np.cumsum(size)
    if not len(to):
        return word, np.zeros(0, np.int32), size
    first, last = to - size, to - 1
    here = buf[np.arange(to[-1]) - np.repeat(first, size) + np.repeat(starts, size)].astype(np.uint64) + np.uint64(1)
    before, after = np.roll(here, 1), np.roll(here, -1)
    before[first] = after[last] = 0
    tri = (before * np.uint64(257) + here) * np.uint64(257) + after
    return word, (mix(tri) % span).astype(np.int32) + 1, size


def windows(row: np.ndarray, rows: int):
    """Layout of padded documents: place of each word, number of places, and start and row of each window."""
    n = np.bincount(row, minlength=rows)
    count = np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE))
    room = count * STRIDE + WINDOW - STRIDE
    base = np.cumsum(room) - room
    place = base[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
    owner = np.repeat(np.arange(rows), count)
    start = base[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return place, int(room.sum()), start, owner


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_weights(seed: int = 7) -> dict:
    r = np.random.default_rng(seed)
    g = lambda *s: (r.standard_normal(s) * 0.3).astype(np.float32)
    w = {"word": g(BUCKETS, DIM), "char": g(BUCKETS, DIM), "a_w": g(2 * HIDDEN, HIDDEN), "a_v": g(HIDDEN), "out": g(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
    for d in "fb":
        w |= {f"x_{d}": g(2 * DIM, 3 * HIDDEN), f"c_{d}": np.zeros(3 * HIDDEN, np.float32), f"h_{d}": g(HIDDEN, 3 * HIDDEN)}
    w["word"][0] = w["char"][0] = 0
    return w


def _embed(w, ids):
    word, char, size = ids
    if not len(word):
        return np.zeros((0, 2 * DIM), w["word"].dtype)
    spelled = np.add.reduceat(w["char"][char], np.cumsum(size) - size) / size[:, None].astype(np.float32)
    return np.concatenate([w["word"][word], spelled], axis=1)


def _forward(w, gates, start, keep=False):
    """Logits of windows. gates: what the input adds to the gates at each place, for either direction."""
    n, h2 = len(start), 2 * HIDDEN
    states = np.empty((WINDOW, n, h2), np.float32)
    trace = {}
    for d, order, off in (("f", range(WINDOW), 0), ("b", range(WINDOW - 1, -1, -1), HIDDEN)):
        h, u = np.zeros((n, HIDDEN), np.float32), w[f"h_{d}"]
        for t in order:
            x, a = gates[d][start + t], h @ u
            rz = _sigmoid(x[:, :h2] + a[:, :h2])
            m = np.tanh(x[:, h2:] + rz[:, :HIDDEN] * a[:, h2:])
            before, h = h, m + rz[:, HIDDEN:] * (h - m)
            states[t, :, off : off + HIDDEN] = h
            if keep:
                trace[d, t] = (before, rz, m, a[:, h2:])
    k = np.tanh(states.reshape(-1, h2) @ w["a_w"])
    e = (k @ w["a_v"]).reshape(WINDOW, n)
    e = np.exp(e - e.max(0))
    e /= e.sum(0)
    pooled = np.einsum("tn,tnh->nh", e, states)
    logit = pooled @ w["out"] + w["bias"][0]
    return (logit, states, trace, k, e, pooled) if keep else logit


def _gates(w, ids, places, place):
    x = np.zeros((places, 2 * DIM), np.float32)
    x[place] = _embed(w, ids)
    return x, {d: x @ w[f"x_{d}"] + w[f"c_{d}"] for d in "fb"}


def _backward(w, ids, place, x, gates, start, kept, dlogit):
    """Gradients of everything for given gradients of the logits."""
    _, states, trace, k, e, pooled = kept
    n, h2 = len(start), 2 * HIDDEN
    grad = {"out": pooled.T @ dlogit, "bias": np.array([dlogit.sum()], np.float32)}
    dpool = dlogit[:, None] * w["out"]
    dstates = e[:, :, None] * dpool
    de = np.einsum("nh,tnh->tn", dpool, states)
    de = e * (de - (e * de).sum(0))
    grad["a_v"] = k.T @ de.ravel()
    dk = de.reshape(-1, 1) * w["a_v"] * (1 - k * k)
    flat = states.reshape(-1, h2)
    grad["a_w"] = flat.T @ dk
    dstates += (dk @ w["a_w"].T).reshape(WINDOW, n, h2)
    dx = np.zeros_like(x)
    for d, order, off in (("f", range(WINDOW - 1, -1, -1), 0), ("b", range(WINDOW), HIDDEN)):
        u, dh = w[f"h_{d}"], np.zeros((n, HIDDEN), np.float32)
        du, dg = np.zeros_like(u), np.zeros((len(x), 3 * HIDDEN), np.float32)
        for t in order:
            before, rz, m, am = trace[d, t]
            r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
            dh = dh + dstates[t, :, off : off + HIDDEN]
            dm = dh * (1 - z) * (1 - m * m)
            dz = dh * (before - m) * z * (1 - z)
            dr = dm * am * r * (1 - r)
            da = np.concatenate([dr, dz, dm * r], axis=1)
            du += before.T @ da
            dh = dh * z + da @ u.T
            # starts of windows are distinct, so that plain addition is right
            dg[start + t] += np.concatenate([dr, dz, dm], axis=1)
        grad[f"h_{d}"], grad[f"c_{d}"], grad[f"x_{d}"] = du, dg.sum(0), x.T @ dg
        dx += dg @ w[f"x_{d}"].T
    dx = dx[place]
    word, char, size = ids
    for name, at, part in (("word", word, dx[:, :DIM]), ("char", char, np.repeat(dx[:, DIM:] / np.maximum(size, 1)[:, None], size, axis=0))):
        grad[name] = np.column_stack([np.bincount(at, part[:, j], BUCKETS) for j in range(DIM)])
    return grad


def prepare(texts: list) -> tuple:
    buf, off = utf8(pa.array(texts, pa.string()))
    starts, ends, row = split_words(LOWER[buf], off, SEPARATOR)
    return inputs(LOWER[buf], starts, ends), row


def _gradient(w, ids, place, places, start, owner, y):
    """Gradients of the mean loss of some texts, through all their windows.

    The share of each window in its text's softly largest logit is known after a pass forward; more than TOGETHER
    windows then go forward and back in parts, whose gradients add up, so that a long text takes no more memory than its words.
    """
    x, gates = _gates(w, ids, places, place)
    parts = range(0, len(start), TOGETHER)
    kept = [_forward(w, gates, start[k : k + TOGETHER], keep=True) for k in parts[:1]]
    logit = np.concatenate([kept[0][0], *[_forward(w, gates, start[k : k + TOGETHER]) for k in parts[1:]]]).astype(np.float64)
    top = np.full(len(y), -np.inf)
    np.maximum.at(top, owner, logit)
    share = np.exp(logit - top[owner])
    total = np.bincount(owner, share)
    doc = top + np.log(total)
    share /= total[owner]
    dlogit = (share * (_sigmoid(doc) - y)[owner] / len(y)).astype(np.float32)
    grad = None
    for k in parts:
        some = start[k : k + TOGETHER]
        held = kept[0] if k == 0 else _forward(w, gates, some, keep=True)
        part = _backward(w, ids, place, x, gates, some, held, dlogit[k : k + TOGETHER])
        grad = part if grad is None else {name: g + part[name] for name, g in grad.items()}
    return grad


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 3) -> dict:
    """Weights fitted so that a document's softly largest window logit tells its label (Adam)."""
    w = new_weights()
    if not texts or min(labels) == max(labels):
        w["out"][:] = 0
        w["bias"][:] = 4.0 if labels and labels[0] else -4.0
        return w
    rng = np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    epochs = max(epochs, STEPS * BATCH // len(texts))
    step, y_all = 0, np.array(labels, np.float32)
    ready = [prepare([t])[0] for t in texts]
    steps = epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            ids = tuple(np.concatenate(c) for c in zip(*[ready[i] for i in chosen]))
            row = np.repeat(np.arange(len(chosen)), [len(ready[i][0]) for i in chosen])
            place, places, start, owner = windows(row, len(chosen))
            grad = _gradient(w, ids, place, places, start, owner, y_all[chosen])
            step += 1
            rate = RATE * (1 - 0.9 * step / steps)
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                w[k] = (w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
            w["word"][0] = w["char"][0] = 0
    return w


def score_texts(w: dict, buf, off, segment: int = SEGMENT) -> np.ndarray:
    """The largest window probability of each text. A text of more than ``segment`` words is read in parts, with the same windows."""
    rows = len(off) - 1
    buf = LOWER[buf]
    starts, ends, row = split_words(buf, off, SEPARATOR)
    n = np.bincount(row, minlength=rows)
    parts = np.maximum(1, -(-(n - STRIDE) // segment))
    owner = np.repeat(np.arange(rows), parts)
    skip = (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * segment
    size = np.minimum(n[owner] - skip, segment + STRIDE)
    first = (np.cumsum(n) - n)[owner] + skip
    total = np.cumsum(size)
    best, at = np.full(rows, -np.inf), 0
    while at < len(owner):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + segment, "right")))
        many = size[at:to]
        local = np.repeat(np.arange(to - at), many)
        words = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[at:to], many)
        place, places, start, own = windows(local, to - at)
        _, gates = _gates(w, inputs(buf, starts[words], ends[words]), places, place)
        for k in range(0, len(start), TOGETHER):
            np.maximum.at(best, owner[at:to][own[k : k + TOGETHER]], _forward(w, gates, start[k : k + TOGETHER]))
        at = to
    return _sigmoid(best)


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, label: str = "toxic", kept_apart=None) -> dict:
    """Weights from at most ``rows`` labelled texts of each label, whole.

    The sample follows a hash of doc_id. Null labels, ids and texts are left out; of an id that
    has several labels the largest counts. ``kept_apart`` is a condition on doc_id of rows never learned from.
    Without texts of both labels, as from an empty table, all texts get one score.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if kept_apart is not None:
        known = known.where(~kept_apart)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    chosen = None
    for y in (0, 1):
        # twice as many ids as texts asked for, as labels of missing texts drop out
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * rows)
        chosen = part if chosen is None else chosen.union(part)
    found = texts.join(F.broadcast(chosen), "doc_id").withColumn("h", F.xxhash64("doc_id", "text"))
    sample = []
    for y in (0, 1):
        sample += [(r.text, r.y) for r in found.where(F.col("y") == y).orderBy("h", "doc_id").limit(rows).collect()]
    return train([t for t, _ in sample], [y for _, y in sample])


def score(docs: DataFrame, w: dict, name: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text in a column ``name``, which replaces one of that name.

    Null and empty texts score as a window of padding; repeated rows and rows without an id each keep their row.
    """
    docs = docs.drop(name)
    handle = docs.sparkSession.sparkContext.broadcast(w)
    columns = docs.columns

    def run(batches):
        for big in batches:
            for b in batch_slices(big, "text"):
                s = score_texts(handle.value, *utf8(b.column("text")))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s.astype(np.float64))], names=[*columns, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{name}` double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of held-out rows are not learned from. A row without an id is not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    apart = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    w = fit(docs, labels, kept_apart=apart)
    found = score(docs.select("doc_id", "text"), w)
    return found.select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
