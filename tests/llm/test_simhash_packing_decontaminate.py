import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from pramana.llm import decontaminate, packing, queries, simhash
from pramana.llm._graph import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, near):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {n: top(n) for n in nodes}


def test_simhash_matches_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in queries.queries()["op3_simhash"](spark, sf_dir).collect()}
    fp = {i: plain_fingerprint(t) for i, t in texts}
    want = plain_components(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    assert got == {i: (fp[i], want[i]) for i in fp}


@pytest.mark.parametrize("crowd", [1, 32])
def test_links_are_all_pairs_within_two_bits(spark, crowd):
    rng = random.Random(3)
    seed = [rng.getrandbits(64) for _ in range(6)]
    fps = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for s in seed for _ in range(40)}
    node = {f: n for n, f in enumerate(sorted(fps))}
    rows = [(int(np.uint64(f).view(np.int64)), n) for f, n in node.items()]
    links = simhash.link_fingerprints(spark.createDataFrame(rows, "fp long, node long"), crowd=crowd)
    got = {r.node: r.component for r in components(links).collect()}
    want = plain_components(range(len(fps)), [(node[a], node[b]) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2])
    assert {n: got.get(n, n) for n in want} == want


def test_components_of_a_path_a_star_and_nothing(spark):
    path = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)] + [(9, 9), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 5 for i in range(6, 40)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_on_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r.id: r for r in rows if r.id is not None}
    assert by[2].component == 1 and by[11].component == 1 and by[5].fp == by[6].fp == 0 and by[6].component == 4
    assert sorted(r.component for r in rows if r.id is None) == [1, 4]
    assert simhash.near_duplicates(empty).count() == 0


def check_packing(rows):
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in at.values():
        end = 0
        for o, n in sorted(spans):
            assert o == end
            end += n
        assert end <= 1024
    return len(at)


def test_packing_holds_every_token_once(spark, sf_dir, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = queries.queries()["op5_pack"](spark, sf_dir).collect()
    by = {(r.doc_id, r.piece): r for r in rows}
    assert len(by) == len(rows)
    total = 0
    for i, t in texts:
        ids = slow.encode(t, add_special_tokens=False).ids + [2]
        total += len(ids)
        k = at = 0
        while at < len(ids):
            r = by.pop((i, k))
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
            assert r.length == 1024 or k == 0
            at, k = at + r.length, k + 1
    assert not by
    assert check_packing(rows) <= -(-total // 1024) + 1


def test_packing_reads_the_special_string_as_the_tokenizer_does(odd, empty, spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t = "a <|endoftext|> b"
    assert packing.encoder()(t) == slow.encode(t, add_special_tokens=False).ids
    rows = packing.pack(packing.pieces(odd)).collect()
    check_packing(rows)
    assert sum(r.piece == 0 for r in rows) == odd.count()
    assert packing.pack(packing.pieces(empty)).count() == 0


def test_local_search_empties_a_bin():
    sizes = np.array([6, 4, 4, 5, 5, 3, 3])  # best fit, longest first, needs 4 bins of 10
    which, _ = packing.pack_group(sizes, 10)
    assert len(set(which)) == 3


def test_local_search_beats_best_fit_and_raises_squared_fill():
    """Half-sized pieces, of which best fit wastes the most; small ones; each within its capacity and whole."""
    rng = np.random.default_rng(0)
    for sizes, gain in ((rng.integers(300, 600, 4000), 10), (rng.integers(5, 300, 3000), 0), (rng.integers(1, 1025, 3000), 0)):
        first = packing._best_fit(sizes, 1024)
        before, square = len(first), sum(int(sizes[b].sum()) ** 2 for b in map(np.array, first))
        after = packing._local_search(sizes, [list(b) for b in first], 1024)
        assert sorted(i for b in after for i in b) == list(range(len(sizes))) and all(sizes[b].sum() <= 1024 for b in map(np.array, after))
        assert before - len(after) >= gain and sum(int(sizes[b].sum()) ** 2 for b in map(np.array, after)) >= square


def test_no_exchange_is_left():
    """Small groups against a search of all moves and exchanges that raise squared fill, from the emptier bin to the fuller."""
    from itertools import combinations

    rng = np.random.default_rng(2)
    for _ in range(30):
        sizes, cap = rng.integers(3, 40, 30), 60
        bins = packing._local_search(sizes, packing._best_fit(sizes, cap), cap)
        if len(bins) == -(-int(sizes.sum()) // cap):
            continue
        fill = [int(sizes[b].sum()) for b in map(np.array, bins)]
        for a in range(len(bins)):
            for b in range(len(bins)):
                if a == b or fill[b] < fill[a] or fill[b] == cap:
                    continue
                for n, m in ((1, 0), (2, 0), (1, 1), (2, 1), (1, 2)):
                    for x in combinations(bins[a], n):
                        for y in combinations(bins[b], m):
                            more = int(sizes[list(x)].sum()) - (int(sizes[list(y)].sum()) if y else 0)
                            assert not 0 < more <= cap - fill[b]


def test_encoder_on_hard_bytes():
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(9)
    marks = ["<|endoftext|>", "<|endoftext", "\u0000", "\u200d", "\ud7ff", "\U0001f469\u200d\U0001f680", "e\u0301", "\r\n", "\t\t", "   ", "'ll", "''S", "\u3000", "\u0130", "1234567", "a1b2", "\ufeff", "\x85"]
    for _ in range(300):
        t = "".join(rng.choice([rng.choice(marks), chr(rng.randrange(32, 0x3000)), rng.choice("etaoin ")]) for _ in range(rng.randrange(60)))
        assert packing.encoder()(t) == slow.encode(t, add_special_tokens=False).ids, t


def test_a_hot_fingerprint_and_a_tail_keep_their_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOTTEST", 20)
    rows = [(i, "" if i % 3 == 0 else f"text number {i % 50} of some words") for i in range(300)]
    got = {r.id: (r.fp, r.component) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    monkeypatch.setattr(simhash, "HOTTEST", 2000)
    want = {r.id: (r.fp, r.component) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(got) == 300


def plain_scan(text, items, n=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    hit, met = set(), set()
    for i, t in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        m = min(n, len(v))
        wins = {tuple(v[k : k + m]) for k in range(len(v) - m + 1)} if m else set()
        for k in range(len(w) - m + 1) if m else ():
            if tuple(w[k : k + m]) in wins:
                hit.update(range(k, k + m))
                met.add(str(i))
    return len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)


def test_decontaminate_matches_brute_force(spark, sf_dir, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in queries.queries()["op7_decontaminate"](spark, sf_dir).collect()}
    assert got == {i: plain_scan(t, items) for i, t in texts}
    assert any(v[4] for v in got.values())


@pytest.mark.parametrize("block_chars", [40, 10**6])
def test_decontaminate_short_items_and_blocks(spark, odd, empty, block_chars):
    bench = [(1, "one"), (2, "a b"), (3, None), (4, "..."), (5, "A B, a b a b c d e f g h i"), (None, "one two"), (2, "a b")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    rows = [(1, "a b a b c d e f g h i one"), (2, "b a b"), (3, "one"), (4, None), (5, "x a"), (6, "a b a b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (r.n_words, r.n_hit, len(r["items"])) for r in decontaminate.scan(docs, items, block_chars=block_chars).collect()}
    keep = [x for x in bench if x[0] is not None]
    assert got == {i: plain_scan(t, keep)[:3] for i, t in rows}
    left = {r.doc_id: r.text for r in decontaminate.remove(docs, items, block_chars=block_chars).collect()}
    assert left[1] == "" and left[2] == "b " and left[5] == "x a" and left[4] is None
    assert decontaminate.scan(odd, items, block_chars=block_chars).count() == odd.count()
    clash = docs.selectExpr("doc_id", "text", "1 as n_hit", "2 as own", "3 as _text", "4 as items")
    assert decontaminate.remove(clash, items, block_chars=block_chars).where("own = 2 and _text = 3 and items = 4").count() == len(rows)
    texts = docs.selectExpr("cast(doc_id as string) as doc_id", "text")
    assert {int(r.id): r.n_hit for r in decontaminate.scan(texts, items, block_chars=block_chars).collect()} == {i: v[1] for i, v in got.items()}
    assert decontaminate.remove(empty, items).count() == 0
    assert decontaminate.scan(docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_index_finds_what_a_plain_search_finds():
    rng = np.random.default_rng(1)
    seq = np.concatenate([np.append(rng.integers(1, 4, rng.integers(1, 30)), 0) for _ in range(60)])
    index = decontaminate.FMIndex(seq, 3)
    for m in (1, 2, 4):
        patterns = np.array(np.meshgrid(*[[1, 2, 3]] * m)).reshape(m, -1).T
        lo, hi = index.search(patterns)
        for p, a, b in zip(patterns, lo, hi):
            want = [i for i in range(len(seq) - m + 1) if (seq[i : i + m] == p).all()]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want
