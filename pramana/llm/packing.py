"""Best-fit packing improved by swap-based local search."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pramana.llm._spark import checkpoint, table, unused

CAPACITY, END = 1024, 2
SPECIAL = "<|endoftext|>"
#: Pieces that one local search packs together.
GROUP = 20_000
_loaded: dict = {}


def encoder(name: str = "byte_bpe_50k"):
    """Text -> ids of the byte-level BPE. The rank file holds the same vocabulary as the JSON file and
    is several times faster; texts with the special token's string go through the JSON file, which
    reads that string as one token."""
    if name not in _loaded:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        slow = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        _loaded[name] = lambda text: slow.encode(text, add_special_tokens=False).ids if SPECIAL in text else fast.encode_ordinary(text)
    return _loaded[name]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(id, piece, start, length, ids_crc32), pieces of at most ``capacity`` tokens.

    A text longer than that is cut so that all pieces but the first are full. Null is empty, which is
    the end token alone. Repeated rows and rows without an id give their pieces each; ids may be of any type.
    """

    def run(batches):
        encode = encoder()
        for b in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, x in enumerate(b.column(1)):
                ids = encode(x.as_py() or "")
                ids.append(end)
                data = np.array(ids, "<u4").tobytes()
                at, k, n = 0, 0, len(ids)
                to = n % capacity or min(n, capacity)
                while at < n:
                    rows.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(data[4 * at : 4 * to]))
                    at, to, k = to, to + capacity, k + 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))], names=["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def _best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit, longest first; bins by free room are kept in stacks, one for each room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fit = mask >> s
        if fit:
            r = s + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            r, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if r > s:
            room[r - s].append(b)
            mask |= 1 << (r - s)
    return bins


def _numbers(bits: int) -> list[int]:
    """Places of the set bits."""
    out = []
    while bits:
        low = bits & -bits
        out.append(low.bit_length() - 1)
        bits ^= low
    return out


class _Bins:
    """Underfull bins by their free room, with what single pieces and pairs of pieces each can give.

    Sets of sizes are bit masks, so that whether some bin with a given room can take part in an exchange is
    one shift and one conjunction.
    """

    def __init__(self, size: list[int], bins: list[list[int]], capacity: int):
        self.size, self.bins, self.capacity = size, bins, capacity
        self.fill = [sum(size[i] for i in b) for b in bins]
        self.of_gap: list[set] = [set() for _ in range(capacity + 1)]
        self.masks: list = [None] * len(bins)
        self.union: list = [None] * (capacity + 1)
        self.gaps = 0
        for b in range(len(bins)):
            self._put(b)

    def _put(self, b: int) -> None:
        gap = self.capacity - self.fill[b]
        if 0 < gap < self.capacity:
            self.of_gap[gap].add(b)
            self.gaps |= 1 << gap
            self.union[gap] = None

    def take(self, b: int) -> None:
        """``b`` is no longer among the bins that others look at."""
        gap = self.capacity - self.fill[b]
        if b in self.of_gap[gap]:
            self.of_gap[gap].discard(b)
            self.union[gap] = None
            if not self.of_gap[gap]:
                self.gaps &= ~(1 << gap)

    def give(self, b: int) -> None:
        self.masks[b] = None
        self._put(b)

    def mask(self, b: int) -> tuple[int, int]:
        """Sizes of single pieces, and of pairs, as bits."""
        if self.masks[b] is None:
            one = two = 0
            for i in self.bins[b]:
                s = self.size[i]
                two |= one << s
                one |= 1 << s
            self.masks[b] = one, two
        return self.masks[b]

    def at_gap(self, gap: int) -> tuple[int, int]:
        if self.union[gap] is None:
            one = two = 0
            for b in self.of_gap[gap]:
                x, y = self.mask(b)
                one |= x
                two |= y
            self.union[gap] = one, two
        return self.union[gap]

    def pick(self, b: int, total: int, pair: bool) -> list[int]:
        """Pieces of bin ``b`` of that size together: one, or two."""
        mine = self.bins[b]
        if not pair:
            return [next(i for i in mine if self.size[i] == total)]
        seen: dict[int, int] = {}
        for i in mine:
            j = seen.get(total - self.size[i])
            if j is not None:
                return [j, i]
            seen[self.size[i]] = i
        raise LookupError(total)

    def exchange(self, src: int) -> bool:
        """The exchange that moves the most out of ``src`` into one bin at least as full; whether there was any.

        Tried are: moving one document or two, one for one, two for one and one for two. Each raises the squared fill.
        """
        one, two = (_numbers(x) for x in self.mask(src))
        # larger rooms first: what fills one whole moves most
        left = self.gaps & ((1 << (self.capacity - self.fill[src] + 1)) - 1)
        best, choice = 0, None
        while left:
            gap = left.bit_length() - 1
            left &= ~(1 << gap)
            if gap <= best:
                break
            theirs, pairs = self.at_gap(gap)
            for mine, others in ((one, ((0, 1), (2, theirs), (4, pairs))), (two, ((1, 1), (3, theirs)))):
                for total in mine:
                    if total <= best:
                        continue
                    least = max(0, total - gap)
                    for kind, other in others:
                        # the smallest return that leaves no more than the room moves most
                        met = other >> least
                        if met:
                            back = least + (met & -met).bit_length() - 1
                            if total - back > best:
                                best, choice = total - back, (gap, kind, back)
        if choice is None:
            return False
        gap, kind, back = choice
        want = 1 if kind == 2 or kind == 3 else 2 if kind == 4 else 0
        dst = next(b for b in sorted(self.of_gap[gap]) if not want or self.mask(b)[want - 1] >> back & 1)
        out = self.pick(src, back + best, kind in (1, 3))
        into = self.pick(dst, back, want == 2) if want else []
        self.take(dst)
        for x, y, move in ((src, dst, out), (dst, src, into)):
            for i in move:
                self.bins[x].remove(i)
                self.bins[y].append(i)
        self.fill[src] -= best
        self.fill[dst] += best
        self.masks[src] = None
        self.give(dst)
        return True


def _local_search(sizes: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Exchange documents between underfull bins while squared fill grows.

    The emptiest bin gives its documents away, to bins at least as full, until it is empty or no exchange of it is left;
    then the next one does. Passes over all underfull bins follow each other until one finds no exchange or the
    number of bins is the least that there can be. Squared fill is a bounded integer that every exchange
    raises, so the search ends by itself.
    """
    size = sizes.tolist()
    held = _Bins(size, bins, capacity)
    least = -(-sum(size) // capacity)
    count = sum(bool(b) for b in bins)
    moved = True
    while moved and count > least:
        moved = False
        for src in sorted((b for b in range(len(bins)) if 0 < held.fill[b] < capacity), key=lambda b: (held.fill[b], b)):
            if not 0 < held.fill[src] < capacity:
                continue
            held.take(src)
            while held.fill[src] and held.exchange(src):
                moved = True
            if held.fill[src]:
                held.give(src)
            else:
                count -= 1
                if count <= least:
                    break
    return [b for b in bins if b]


def pack_group(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece; offsets of a bin are gapless from 0."""
    bins = _local_search(sizes, _best_fit(sizes, capacity), capacity)
    which, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for k, b in enumerate(bins):
        at = 0
        for i in b:
            which[i], offset[i] = k, at
            at += int(sizes[i])
    return which, offset


def pack(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces (at least a ``length``).

    Pieces are dealt at random, by a hash of the row's place in the checkpoint, into groups of about
    ``group``, so that repeated rows part; each group is packed by itself, so a group has as many pieces at any size of the corpus. Best fit with the longest first
    starts, the local search empties bins. Losing at most about one bin for each group is the
    price of not packing everything in one task. Repeated rows are packed each for itself; a column of ``cut`` named
    sequence_id or offset is replaced; an empty table gives an empty result.
    """
    cut = checkpoint(cut.drop("sequence_id", "offset"))
    own = unused(cut, "group")
    groups = max(1, -(-cut.count() // group))
    dealt = cut.withColumn(own, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    width = 1 << 32

    def run(t: pa.Table) -> pa.Table:
        g = t.column(own)[0].as_py()
        t = t.sort_by([(c, "ascending") for c in t.column_names])
        which, offset = pack_group(t.column("length").to_numpy(), capacity)
        return t.drop_columns([own]).append_column("sequence_id", pa.array(g * width + which)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return dealt.groupBy(own).applyInArrow(run, schema)


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed; see ``pieces`` and ``pack`` for nulls, empty texts and repeats."""
    return pack(pieces(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id"))
