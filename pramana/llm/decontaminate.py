"""Benchmark decontamination by an FM-index of each training shard.

A shard is a slice of a partition. Its words become symbols, benchmark test phrases are searched
backwards through wavelet ranks, occurrences are located by walking to sampled suffix positions,
and the hit words merge into removal spans.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pramana.llm._spark import checkpoint, table
from pramana.llm._text import LOWER, batch_slices, hash_words, split_words, utf8

WINDOW = 10
#: Characters of benchmark text that are broadcast at a time; more come in further blocks.
BLOCK_CHARS = 4_000_000
SAMPLE = 8
#: Words of a shard: a longer run of texts is indexed in parts that overlap by a window.
SHARD_WORDS = 1_000_000
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[:128] = True
SEPARATOR[48:58] = SEPARATOR[97:123] = False


class WaveletMatrix:
    """Ranks and access over a symbol sequence, one bit vector for each bit of a symbol."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for k in range(bits - 1, -1, -1):
            bit = (seq >> k) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(seq) - bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.start: dict = {}

    def rank(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """How often c occurs before lo and before hi."""
        base = np.zeros_like(lo)
        for level, k in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros, one = self.ones[level], self.zeros[level], ((c >> k) & 1).astype(bool)
            base, lo, hi = (np.where(one, zeros + ones[x], x - ones[x]) for x in (base, lo, hi))
        return lo - base, hi - base

    def step(self, at: np.ndarray):
        """The symbol at each place and how often it occurs before it."""
        c, base = np.zeros_like(at), np.zeros_like(at)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            one = ones[at + 1] > ones[at]
            base, at = (np.where(one, zeros + ones[x], x - ones[x]) for x in (base, at))
            c = 2 * c + one
        return c, at - base


class FMIndex:
    """Index of runs of symbols >= 1, each run closed by a 0; matches never cross a 0."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = SAMPLE):
        n = len(seq)
        # the closing zeros differ from each other for the order, so that no common prefix is longer than a run
        zero = seq == 0
        rank = np.where(zero, np.cumsum(zero) - 1, seq + zero.sum()).astype(np.int64)
        width = 1
        while True:
            nxt = np.full(n, -1, np.int64)
            nxt[: n - width] = rank[width:]
            key = rank * (n + sigma + 2) + nxt + 1
            sa = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(np.diff(key[sa]) != 0)])
            rank = np.empty(n, np.int64)
            rank[sa] = new
            if n == 0 or new[-1] == n - 1:
                break
            width *= 2
        self.count = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma + 1))])
        before = np.where(sa > 0, seq[sa - 1], 0)
        self.tree = WaveletMatrix(before, max(1, int(sigma).bit_length()))
        # starts of runs are sampled too: a walk never crosses one
        kept = (sa % sample == 0) | (before == 0)
        self.kept, self.kept_rank, self.position = kept, np.cumsum(kept) - 1, sa[kept]
        self.n = n

    def search(self, patterns: np.ndarray):
        """Ranges [lo, hi) of the rows of ``patterns`` (q, m); hi <= lo: none."""
        q = len(patterns)
        lo, hi, live = np.zeros(q, np.int64), np.full(q, self.n, np.int64), np.arange(q)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j]
            a, b = self.tree.rank(c, lo[live], hi[live])
            lo[live], hi[live] = self.count[c] + a, self.count[c] + b
            live = live[b > a]
            if not len(live):
                break
        return lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Positions in the sequence of suffixes of these ranks."""
        at, steps, out = at.copy(), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        while len(live):
            done = self.kept[at[live]]
            here = live[done]
            out[here] = self.position[self.kept_rank[at[here]]] + steps[here]
            live = live[~done]
            c, r = self.tree.step(at[live])
            at[live] = self.count[c] + r
            steps[live] += 1
        return out


def _block(items: list, window: int) -> dict:
    """Symbols and test phrases of one block of the benchmark. Items: (id text, text)."""
    buf, off = utf8(pa.array([t for _, t in items], pa.string()))
    buf = LOWER[buf]
    starts, ends, row = split_words(buf, off, SEPARATOR)
    h = hash_words(buf, starts, ends)
    vocab, symbol = np.unique(h, return_inverse=True)
    phrases: dict[int, dict[bytes, set[int]]] = {}
    first = np.searchsorted(row, np.arange(len(items) + 1))
    symbol = (symbol + 1).astype(np.int64)
    for i in range(len(items)):
        s = symbol[first[i] : first[i + 1]]
        m = min(window, len(s))
        for k in range(len(s) - m + 1 if m else 0):
            phrases.setdefault(m, {}).setdefault(s[k : k + m].tobytes(), set()).add(i)
    table_ = np.zeros(1 << 20, bool)
    table_[(vocab & np.uint64(0xFFFFF)).astype(np.int64)] = True
    by_length = {m: (np.array([np.frombuffer(p, np.int64) for p in d]), list(d.values())) for m, d in phrases.items()}
    return {"vocab": vocab, "maybe": table_, "phrases": by_length, "ids": [i for i, _ in items], "least": min(by_length, default=0)}


def _find(buf, starts, ends, row, block):
    """(first word, last word + 1, phrase length, phrase number) of all occurrences of a block's phrases."""
    h = hash_words(buf, starts, ends)
    symbol = np.zeros(len(h), np.int64)
    at = np.flatnonzero(block["maybe"][(h & np.uint64(0xFFFFF)).astype(np.int64)])
    place = np.minimum(np.searchsorted(block["vocab"], h[at]), len(block["vocab"]) - 1)
    known = block["vocab"][place] == h[at]
    symbol[at[known]] = place[known] + 1
    # a phrase holds benchmark words only: runs of them that are too short for any phrase need no index
    cut = np.flatnonzero((symbol == 0) | np.concatenate([[True], row[1:] != row[:-1]]))
    bounds = np.concatenate([cut, [len(symbol)]])
    a, b = bounds[:-1] + (symbol[bounds[:-1]] == 0), bounds[1:]
    long = b - a >= block["least"]
    a, b = a[long], b[long]
    if not len(a):
        return
    size = b - a + 1
    to = np.cumsum(size)
    word = np.arange(to[-1]) - np.repeat(to - size, size) + np.repeat(a, size)
    close = to - 1
    seq = symbol[np.minimum(word, len(symbol) - 1)]
    seq[close] = 0
    index = FMIndex(seq, len(block["vocab"]))
    for m, (patterns, _) in block["phrases"].items():
        lo, hi = index.search(patterns)
        n = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(n)), n)
        ranks = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        yield m, which, word[index.locate(ranks)]


def _find_all(block: dict, buf, starts, ends, row, rows: int, window: int, shard: int = SHARD_WORDS):
    """Coverage counts of every word and the items met in each row, from one block."""
    hit = np.zeros(len(starts) + 1, np.int64)
    met: list[set] = [set() for _ in range(rows)]
    for x in range(0, len(starts) if block["phrases"] else 0, shard):
        part = slice(x, x + shard + window - 1)
        for m, which, first in _find(buf, starts[part], ends[part], row[part], block):
            first = first + x
            np.add.at(hit, first, 1)
            np.add.at(hit, first + m, -1)
            items = block["phrases"][m][1]
            pairs = np.unique(which * (rows + 1) + row[first])
            for w, r in zip((pairs // (rows + 1)).tolist(), (pairs % (rows + 1)).tolist()):
                met[r].update(block["ids"][i] for i in items[w])
    return np.cumsum(hit)[:-1] > 0, met


def _words(array: pa.Array):
    buf, off = utf8(array)
    low = LOWER[buf]
    return (buf, off, low, *split_words(low, off, SEPARATOR))


def _runs(at: np.ndarray):
    """Sorted numbers as runs: first of each, and last."""
    cut = np.flatnonzero(np.diff(at) > 1)
    return np.concatenate([at[:1], at[cut + 1]]), np.concatenate([at[cut], at[-1:]])


def _without(raw: bytes, starts, ends, base: int, gone: np.ndarray) -> str:
    """A text without its removal spans: from the first to the last byte of each run of the words ``gone``."""
    at, parts = 0, []
    for x, y in zip(*_runs(gone)):
        parts.append(raw[at : starts[x] - base])
        at = ends[y] - base
    return b"".join([*parts, raw[at:]]).decode()


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_chars: int):
    """One block of the benchmark after another, each of about ``block_chars`` characters: none is held beside the next."""
    b = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null")
    chars = b.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = max(1, -(-chars // block_chars))
    for k in range(n):
        part = b.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else b
        yield n, _block([tuple(r) for r in part.collect()], window)


_HITS = "id {kind}, th long, first array<int>, last array<int>, met array<string>"


def _hits(source: DataFrame, block: dict, window: int) -> DataFrame:
    """(id, th, first, last, met) for the texts with a hit of a block. source: (id, th, text)."""
    handle = source.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        for big in batches:
            for b in batch_slices(big):
                _, _, low, starts, ends, row = _words(b.column("text"))
                covered, met = _find_all(handle.value, low, starts, ends, row, b.num_rows, window)
                base = np.searchsorted(row, np.arange(b.num_rows + 1))
                rows = np.unique(row[covered])
                runs = [_runs(np.flatnonzero(covered[base[r] : base[r + 1]])) for r in rows]
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("th").take(at), *(pa.array([x[k] for x in runs], pa.list_(pa.int32())) for k in (0, 1)), pa.array([sorted(met[r]) for r in rows], pa.list_(pa.string()))], names=["id", "th", "first", "last", "met"])

    # written at once, so that the block can go before the next one comes
    found = checkpoint(source.mapInArrow(run, _HITS.format(kind=source.schema["id"].dataType.simpleString())))
    handle.destroy()
    return found


def _marked(docs: DataFrame, id_col: str | None, text_col: str, benchmark: DataFrame, item_col: str, item_text: str, window: int, block_chars: int):
    """``docs`` as (own struct, text, first, last, met): places of the words hit by any block, or the only block to look for."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    identity = F.lit(0).alias("id") if id_col is None else F.col(id_col).alias("id")
    text = F.col(text_col).cast("string").alias("text")
    found = None
    for n, block in _blocks(benchmark, item_col, item_text, window, block_chars):
        if n == 1:
            return docs.select(own, text), block
        one = _hits(docs.select(identity, F.xxhash64(text_col).alias("th"), text), block, window)
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy("id", "th").agg(*[F.flatten(F.collect_set(c)).alias(c) for c in ("met",)], F.collect_set(F.struct("first", "last")).alias("runs"))
    source = docs.select(own, text, identity, F.xxhash64(text_col).alias("th"))
    joined = source.join(merged.select(F.col("id").alias("id_"), F.col("th").alias("th_"), "met", "runs"), F.col("id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_")), "left")
    return joined.select("own", "text", F.flatten(F.col("runs.first")).alias("first"), F.flatten(F.col("runs.last")).alias("last"), "met"), None


def _apply(marked: DataFrame, block: dict | None, window: int, cut: bool) -> DataFrame:
    """(own, n_words, n_hit, items[, text]) of every row."""
    handle = marked.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        for big in batches:
            for b in batch_slices(big):
                raw, off, low, starts, ends, row = _words(b.column("text"))
                rows = b.num_rows
                base = np.searchsorted(row, np.arange(rows + 1))
                if handle.value is not None:
                    covered, met = _find_all(handle.value, low, starts, ends, row, rows, window)
                else:
                    steps = np.zeros(len(starts) + 1, np.int64)
                    lists = [b.column(c).to_pylist() for c in ("first", "last", "met")]
                    for r, (x, y) in enumerate(zip(lists[0], lists[1])):
                        if x:
                            np.add.at(steps, base[r] + np.array(x), 1)
                            np.add.at(steps, base[r] + np.array(y) + 1, -1)
                    covered, met = np.cumsum(steps)[:-1] > 0, [set(m or ()) for m in lists[2]]
                n_hit = np.bincount(row[covered], minlength=rows)
                out = [b.column("own"), pa.array(np.bincount(row, minlength=rows), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(m) for m in met], pa.list_(pa.string()))]
                if cut:
                    texts = b.column("text").to_pylist()
                    for r in np.flatnonzero(n_hit):
                        texts[r] = _without(raw[off[r] : off[r + 1]].tobytes(), starts, ends, off[r], base[r] + np.flatnonzero(covered[base[r] : base[r + 1]]))
                    out.append(pa.array(texts, pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=["own", "n_words", "n_hit", "items", "text"][: len(out)])

    schema = f"own {marked.schema['own'].dataType.simpleString()}, n_words long, n_hit long, items array<string>" + ", text string" * cut
    return marked.mapInArrow(run, schema)


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, n_words, n_hit, items array of item ids as sorted strings) for every row; ids may be of any type.

    Null and empty texts have no words; null items and items without words are skipped; repeated items count
    once each; repeated rows and rows without an id each get a row. A benchmark of more than ``block_chars`` is
    searched for a block at a time: one block is on the driver and broadcast at once, hits are written and merged by join.
    """
    marked, block = _marked(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "id", "text", benchmark, item_col, item_text, window, block_chars)
    return _apply(marked, block, window, False).select(F.col("own.id").alias("id"), "n_words", "n_hit", "items")


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS, hits: str = "n_hit") -> DataFrame:
    """``docs`` with the merged removal spans cut out of the text and a column ``hits`` (one of that name is replaced).

    A text without a hit stays as it is, null ones too; repeated rows and rows without an id each keep their row; an
    empty table stays empty.
    """
    marked, block = _marked(docs, None, text_col, benchmark, item_col, item_text, window, block_chars)
    found = _apply(marked, block, window, True)
    return found.select(*[F.col("text").alias(n) if n == text_col else F.col(f"own.`{n}`").alias(n) for n in docs.columns if n.lower() != hits.lower()], F.col("n_hit").alias(hits))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document; see ``scan`` for nulls and repeats."""
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
