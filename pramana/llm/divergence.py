"""How far the term frequencies of each source of a language are from the other sources' and from the language's."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pramana.llm._spark import checkpoint, table
from pramana.llm._text import LOWER, batch_slices, split_words, utf8

#: A term is kept by a language in at least so many of whose documents it occurs.
LEAST_DOCS = 3
#: Ranks of the part ``term``.
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Rows of terms in one task of the part ``pair``, and sources that one task compares with all others.
PAIR_ROWS, TILE = 1 << 18, 512
#: Cells of the table of terms and sources that a task holds at once.
CELLS = 1 << 20
#: Everything but A-Z, a-z and the bytes of characters beyond ASCII ends a term.
_SEP = np.ones(256, bool)
_SEP[65:91] = _SEP[97:123] = _SEP[128:] = False
_SIGN = np.uint64(1 << 63)
_KEY = ["w0", "w1", "rest"]


def _word(buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each place as one number, padded on the right: numbers sort like the bytes."""
    w = np.zeros(len(at), np.uint64)
    last = max(len(buf) - 1, 0)
    for j in range(8):
        byte = np.where(j < size, buf[np.minimum(at + j, last)], 0)
        w = (w << np.uint64(8)) | byte.astype(np.uint64)
    return w


def _radix(order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """``order`` sorted by ``key``, stable: one counting pass of numpy's radix sort for each 16 bits that differ."""
    for shift in (0, 16, 32, 48):
        digit = (key[order] >> np.uint64(shift)).astype(np.uint16)
        if len(digit) and digit.min() != digit.max():
            order = order[np.argsort(digit, kind="stable")]
    return order


def _runs(differs: np.ndarray, group: np.ndarray, row: np.ndarray):
    """First place, occurrences and documents of each run of one term in one group."""
    first = np.ones(len(row), bool)
    first[1:] = differs | (group[1:] != group[:-1])
    new_row = first.copy()
    new_row[1:] |= row[1:] != row[:-1]
    at = np.flatnonzero(first)
    return at, np.diff(np.append(at, len(row))), np.add.reduceat(new_row.astype(np.int64), at) if len(at) else at


def count_terms(text: pa.Array, group: np.ndarray):
    """(group, w0, w1, rest, n, docs) for each term of each group; every row of ``text`` is a document.

    Terms of up to 8 and of up to 16 bytes are one and two words and are sorted by radix; longer
    ones are sorted as bytes, in buckets of equal powers of two, and keep what follows their two words in ``rest``.
    """
    buf, off = utf8(text)
    buf = LOWER[buf]
    start, end, row = split_words(buf, off, _SEP)
    by_group = np.argsort(group[row], kind="stable")
    start, row, size = start[by_group], row[by_group], (end - start)[by_group]
    group = group[row]
    w0 = _word(buf, start, size)
    out = []
    one, two = size <= 8, (size > 8) & (size <= 16)
    for which in (one, two):
        at = np.flatnonzero(which)
        a = w0[at]
        b = np.zeros(len(at), np.uint64) if which is one else _word(buf, start[at] + 8, size[at] - 8)
        order = np.arange(len(at))
        for key in (a,) if which is one else (b, a):
            order = _radix(order, key)
        a, b, at = a[order], b[order], at[order]
        first, n, docs = _runs((a[1:] != a[:-1]) | (b[1:] != b[:-1]), group[at], row[at])
        out.append((group[at][first], a[first], b[first], [b""] * len(first), n, docs))
    width = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
    for w in np.unique(width[size > 16]).tolist():
        at = np.flatnonzero((size > 16) & (width == w))
        texts = np.array([buf[s : s + k].tobytes() for s, k in zip(start[at].tolist(), size[at].tolist())], dtype=f"S{1 << w}")
        order = np.argsort(texts, kind="stable")
        texts, at = texts[order], at[order]
        first, n, docs = _runs(texts[1:] != texts[:-1], group[at], row[at])
        long = at[first]
        out.append((group[long], w0[long], _word(buf, start[long] + 8, size[long] - 8), [t[16:] for t in texts[first].tolist()], n, docs))
    return out


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, w0, w1, rest, n, docs): occurrences and documents of each term in each group; nulls are ''."""

    def run(batches):
        for whole in batches:
            for b in batch_slices(whole, "text", 8 << 20):
                lang, source = (b.column(c).dictionary_encode() for c in ("lang", "source"))
                codes = [x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (lang, source)]
                base = max(len(source.dictionary), 1)
                for g, w0, w1, rest, n, d in count_terms(b.column("text"), codes[0] * base + codes[1]):
                    if len(g):
                        columns = [lang.dictionary.take(pa.array(g // base)), source.dictionary.take(pa.array(g % base)), *((w ^ _SIGN).view(np.int64) for w in (w0, w1)), pa.array(rest, pa.binary()), n, d]
                        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=["lang", "source", *_KEY, "n", "docs"])

    named = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for a, c in (("text", text_col), ("lang", lang_col), ("source", source_col))))
    found = named.mapInArrow(run, "lang string, source string, w0 long, w1 long, rest binary, n long, docs long")
    return found.groupBy("lang", "source", *_KEY).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _spelled() -> Column:
    """The term of a key."""
    words = [F.hex(F.col(w).bitwiseXOR(F.lit(-(1 << 63)))) for w in ("w0", "w1")]
    second = F.when(F.col("w1") == F.lit(-(1 << 63)), F.lit("")).otherwise(words[1])
    return F.rtrim(F.decode(F.unhex(F.concat(words[0], second, F.hex("rest"))), "UTF-8"), F.lit("\0"))


def _share(n: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE (n + 1) / (total + kept)) in exact decimals."""
    return F.expr(f"1 + CAST({SCALE} * CAST({n} + 1 AS DECIMAL(20, 0)) AS DECIMAL(38, 0)) div CAST({total} + {kept} AS DECIMAL(20, 0))")


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE (n + 1) / total), exact for totals below 9e15: long division by thousands."""
    q, r = np.divmod(n + 1, total)
    for _ in range(3):
        more, r = np.divmod(r * 1000, total)
        q = q * 1000 + more
    return q + 1


def _compare(key, terms: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums over a slice of a language's terms of floor((p - q)^2 / q) for some of its sources against all others."""
    lang, _, tile = (k.as_py() for k in key)
    places = groups["place"].to_numpy()
    total = np.zeros(places.max() + 1, np.int64)
    total[places] = groups["total"].to_numpy() + groups["kept"].to_numpy()
    mine = range(tile * TILE, min((tile + 1) * TILE, len(total)))
    sums = np.zeros((len(mine), len(total)), np.int64)
    words = [terms[c].to_numpy() for c in ("w0", "w1")]
    rest = np.array(terms["rest"].to_pylist() + [b""], object)[:-1]
    order = np.lexsort((*([rest] if any(rest) else []), *words[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for w in (*words, rest):
        new[1:] |= w[order][1:] != w[order][:-1]
    at = np.cumsum(new) - 1
    place, n = terms["place"].to_numpy()[order], terms["n"].to_numpy()[order]
    step = max(1, CELLS // len(total))
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, step):
        a, b = np.searchsorted(at, [first, first + step])
        counts = np.zeros((int(at[b - 1]) - first + 1, len(total)), np.int64)
        counts[at[a:b] - first, place[a:b]] = n[a:b]
        q = shares(counts, total)
        for k, s in enumerate(mine):
            d = q[:, s : s + 1] - q
            sums[k] += (d * d // q).sum(axis=0)
    s, t = np.divmod(np.arange(sums.size), len(total))
    return pa.table({"lang": pa.array([lang] * sums.size, pa.string()), "place": s + mine.start, "other": t, "value": sums.ravel()})


def divergences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) as the audit ranks other sources and own terms.

    A row is a document: repeated rows and rows without an id count like others. Null text, lang
    and source are ''; '' is a language and a source like others. Groups and languages without kept
    terms have value 0 for each other source and no terms. Ties are ranked by the item's bytes. An
    empty table gives an empty result; other columns are not read.

    Terms are counted in each task, summed by group and dealt by hash, so that no source, language
    or term is in one task whole; a task compares some hundred sources over one slice of the terms.
    """
    by_term = Window.partitionBy("lang", *_KEY)
    counted = checkpoint(term_counts(docs, text_col, lang_col, source_col))
    known = counted.select("lang", "source", *_KEY, "n", F.sum("docs").over(by_term).alias("in_docs"), F.sum("n").over(by_term).alias("of_lang"), F.row_number().over(by_term.orderBy("source")).alias("nth"))
    kept = checkpoint(known.where(F.col("in_docs") >= LEAST_DOCS).drop("in_docs"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum((F.col("nth") == 1).cast("long")).alias("kept"))
    every = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source")).distinct()
    none = F.lit(0).cast("long")
    sums = every.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = checkpoint(sums.select("lang", "source", *(F.coalesce(c, none).alias(c) for c in ("total", "lang_total", "kept")), (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("place")))

    met = kept.join(groups, ["lang", "source"])
    p = met.select("lang", "source", *_KEY, _share("n", "total", "kept").alias("p"), _share("of_lang", "lang_total", "kept").alias("q")).where("p > q")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), *_KEY)
    terms = p.select("lang", "source", *_KEY, F.expr("(p - q) * (p - q) div q").alias("value")).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= TOP_TERMS)
    terms = terms.select("lang", "source", F.lit("term").alias("part"), _spelled().alias("item"), "value", "rank")

    slices = 1 + kept.count() // PAIR_ROWS
    tiles = 1 + (groups.agg(F.coalesce(F.max("place"), none)).first()[0]) // TILE
    each = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile")
    dealt = met.select(*(F.col(c).alias(c) for c in ("lang", *_KEY, "place", "n")), F.pmod(F.xxhash64(*_KEY), F.lit(slices)).cast("int").alias("slice"), each).groupBy("lang", "slice", "tile")
    again = groups.select(*(F.col(c).alias(c) for c in ("lang", "place", "total", "kept")), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    sent = again.select("lang", "slice", each, "place", "total", "kept").groupBy("lang", "slice", "tile")
    parts = dealt.cogroup(sent).applyInArrow(_compare, "lang string, place long, other long, value long").groupBy("lang", "place", "other").agg(F.sum("value").alias("value"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("other"))
    both = groups.select("lang", "source", "place").join(other, "lang").where("place <> other").join(parts, ["lang", "place", "other"], "left")
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", none).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return pairs.unionByName(terms)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all ``documents``; see ``divergences`` for nulls, ties, repeats and empty tables."""
    return divergences(table(spark, sf_dir, "documents"))
