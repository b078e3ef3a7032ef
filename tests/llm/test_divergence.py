import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pramana.llm import divergence

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    """All parts of the audit of (text, lang, source) rows, with Python's integers."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for _, _, w in mine for t in set(w))
        kept = sorted(t for t, n in held.items() if n >= 3)
        count = defaultdict(Counter)
        for _, source, w in mine:
            count[source].update(t for t in w if t in set(kept))
        v = len(kept)
        share = lambda c, t, total: 1 + 1_000_000_000 * (c[t] + 1) // (total + v)
        whole = sum((count[s] for s in count), Counter())
        for s in count:
            p = {t: share(count[s], t, count[s].total()) for t in kept}
            parts = {"pair": [], "term": []}
            for o in count:
                if o != s:
                    q = {t: share(count[o], t, count[o].total()) for t in kept}
                    parts["pair"].append((-sum((p[t] - q[t]) ** 2 // q[t] for t in kept), o.encode()))
            for t in kept:
                q = share(whole, t, whole.total())
                if count[s][t] and p[t] > q:
                    parts["term"].append((-((p[t] - q) ** 2 // q), t.encode()))
            for part, found in parts.items():
                for k, (value, item) in enumerate(sorted(found)[: 200 if part == "term" else None], 1):
                    out.add((lang, s, part, item.decode(), -value, k))
    return out


def rows_of(df):
    return [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]


def check(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    got = rows_of(divergence.divergences(df))
    assert len(got) == len(set(got)) and set(got) == plain(rows)
    return got


def test_equals_plain(spark):
    rng = np.random.default_rng(1)
    long = ["x" * 9, "Abcdefgh", "abcdefghi", "y" * 16, "y" * 17, "z" * 40, "z" * 39 + "w", "é" * 8, "é" * 9, "ß", "日本語テキスト長い語"]
    words = long + [f"{a}{b}" for a in "abcdeABC" for b in "xyz"]
    rows = [(" 7_-".join(rng.choice(words, rng.integers(0, 40))), ["en", "de", None, ""][rng.integers(4)], [None, "", "a", "b", "ä", "B"][rng.integers(6)]) for _ in range(150)]
    got = check(spark, rows + rows[:20])
    assert {r[2] for r in got} == {"pair", "term"} and any(len(r[3].encode()) > 16 for r in got)


def test_ranks_beyond_the_top_go_and_ties_follow_bytes(spark):
    words = [f"w{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnop"]
    got = check(spark, [(" ".join(words), "en", "a")] * 3 + [("other", "en", "b")] * 3)
    assert sum(r[2] == "term" and r[1] == "a" for r in got) == 200


def test_sources_in_tiles_and_terms_in_slices(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PAIR_ROWS", 20)
    monkeypatch.setattr(divergence, "TILE", 3)
    monkeypatch.setattr(divergence, "CELLS", 16)
    rng = np.random.default_rng(2)
    words = [f"t{c}" for c in "abcdefghijklmn"]
    check(spark, [(" ".join(rng.choice(words, 12)), "en", f"s{rng.integers(8)}") for _ in range(60)])


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [("a b", "en", "s"), ("a", "en", "t")], [("", "en", "s"), ("a a a", "de", "s")]])
def test_no_kept_terms(spark, rows):
    check(spark, rows)


def test_odd_rows_and_clashing_names(spark, odd, empty):
    both = odd.withColumns({c: odd.n_chars for c in ("n", "docs", "w0", "place", "value", "part")})
    assert set(rows_of(divergence.divergences(both))) == plain([tuple(r) for r in odd.select("text", "lang", "source").collect()])
    assert divergence.divergences(empty).count() == 0


def test_shares_of_large_counts():
    n, total = [5, 8 * 10**15, 0], [7, 8 * 10**15 + 3, 9 * 10**15 - 1]
    assert divergence.shares(np.array(n), np.array(total)).tolist() == [1 + 10**9 * (a + 1) // b for a, b in zip(n, total)]


def test_a_text_of_one_long_term(spark):
    rows = [("q" * 300_000 + " a", "en", s) for s in "aab"]
    check(spark, rows)


def test_counts_of_one_batch():
    found = divergence.count_terms(pa.array(["b a A", "a", None, "c a"]), np.array([1, 0, 0, 1]))
    spelled = {(int(g), int(w).to_bytes(8, "big").rstrip(b"\0"), int(n), int(d)) for part in found for g, w, n, d in zip(part[0], part[1], part[4], part[5])}
    assert spelled == {(1, b"b", 1, 1), (1, b"a", 3, 2), (0, b"a", 1, 1), (1, b"c", 1, 1)}
