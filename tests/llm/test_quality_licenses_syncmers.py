import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pramana.llm import licenses, quality, queries, syncmers

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    got = {r.doc_id: r for r in queries.queries()["op2_quality"](spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(r.predicted, labels[i]) for i, r in got.items() if i in labels and r.held_out]
    assert np.mean([p == y for p, y in held]) > 0.93


def test_compiled_rules_equal_the_rules(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, len(quality.FEATURES)))
    y = ((x[:, 1] > 0.5) & (x[:, 3] < 0.4) | (x[:, 7] > 0.9)).astype(float)
    model = quality.learn(x, y)
    assert 0 < len(model["rules"]) <= quality.MOST_RULES
    margin = model["bias"] + sum(w * quality._holds(x, r) for w, r in model["rules"])
    assert (((margin > 0) == y).mean()) > 0.95
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], ["i", *[f"f_{k}" for k in quality.FEATURES]])
    got = [r.p for r in rows.select("i", quality.compiled(model).alias("p")).orderBy("i").collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-margin)))


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(1)
    r = (rng.random((300, 12)) < 0.4).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(1 - 2 * r[:, 0] + 2 * r[:, 1]))).astype(float)
    w, b = quality._lasso(r, y, 0.02, 4000)
    g = r.T @ (1 / (1 + np.exp(-(r @ w + b))) - y) / 300
    assert np.all(np.abs(g[w == 0]) <= 0.0201) and np.allclose(g[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-4)
    assert 0 < (w != 0).sum() < 12


def test_statistics_of_one_text(spark):
    row = spark.createDataFrame([("Aa bb bb $$ !!\nAa bb bb $$ !!",)], "text string").select(*[v.alias(k) for k, v in quality.statistics(__import__("pyspark").sql.functions.col("text")).items()]).first()
    assert (row.words, row.kinds, row.lines, row.line_kinds, row.upper, row.symbols, row.runs, row.repeats) == (10, 4, 2, 1, 2, 8, 4, 2)


def test_quality_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (2, 1), (8, 0)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    rows = quality.score(odd, model, ["doc_id"]).collect()
    assert len(rows) == odd.count() and all(r.score is not None for r in rows)
    clash = odd.selectExpr("doc_id", "text", "score", "id as f_words", "lang as kept", "1 as s_words", "2 as _s")
    assert quality.score(clash, model, clash.columns).where("_s = 2 and s_words = 1 and score < 1.0").count() == odd.count()
    assert quality.score(empty, quality.fit(empty, labels), ["doc_id"]).count() == 0
    assert quality.score(clash, model, clash.columns).columns == [c for c in clash.columns if c != "score"] + ["score"]


def plain_statistics(t):
    """Every statistic by hand."""
    w, lines = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x], t.split("\n")
    n = lambda p: len(re.findall(p, t, re.ASCII))
    return (len(t), len(w), len(set(w)), len(lines), len(set(lines)), n("[A-Z]"), n("[0-9]"), n(r"[#$%&*|!<>{}=_~^@/\\]"), n(r"([^\w\s])\1"), n(r"[.?!](?=\s|$)"), sum(a == b for a, b in zip(w, w[1:])))


def test_statistics_and_scores_against_plain_ones(spark, texts):
    rows = [*texts[:60], (900, ""), (901, "a a  b.\n\nA?! "), (902, "é É..\x0b1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["chars", "words", "kinds", "lines", "line_kinds", "upper", "digits", "symbols", "runs", "stops", "repeats"]
    stats = quality.statistics(quality.F.col("text"))
    got = {r.doc_id: tuple(r)[1:] for r in docs.select("doc_id", *[stats[k].alias(k) for k in names]).collect()}
    want = {i: plain_statistics(t) for i, t in rows}
    assert got == want
    ratio = lambda s: [s[1], s[0] / max(1, s[1]), s[2] / max(1, s[1]), s[4] / max(1, s[3]), s[1] / max(1, s[3]), s[5] / max(1, s[0]), s[6] / max(1, s[0]), s[7] / max(1, s[1]), s[8] / max(1, s[1]), s[9] / max(1, s[1]), s[10] / max(1, s[1])]
    x = np.array([ratio(want[i]) for i, _ in rows], float)
    model = quality.learn(x, (x[:, 0] > np.median(x[:, 0])).astype(float))
    margin = model["bias"] + sum(w * quality._holds(x, r) for w, r in model["rules"])
    scores = {r.doc_id: r.score for r in quality.score(docs, model, ["doc_id"]).collect()}
    assert model["rules"] and [scores[i] for i, _ in rows] == pytest.approx((1 / (1 + np.exp(-margin))).tolist())


def test_the_row_bound_is_the_only_one(spark):
    """Repeated ids: the sample is drawn by hash and holds both labels."""
    docs = spark.createDataFrame([(i % 40, f"word {i} " * (1 + i % 7)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = {}
    keep = quality.learn
    try:
        quality.learn = lambda x, y: seen.update(y=y) or {"bias": 0.0, "rules": []}
        quality.fit(docs, labels, rows=30)
    finally:
        quality.learn = keep
    assert len(seen["y"]) == 30 and 0 < seen["y"].sum() < 30


def plain_licenses(text, templates):
    """Every window of the grid against every template of its length, without bands."""
    w, out = re.findall("[a-z0-9]+", (text or "").lower()), {}
    sh = lambda v: {" ".join(v[i : i + 5]) for i in range(max(1, len(v) - 4))} if v else set()
    for name, t in templates.items():
        v = re.findall("[a-z0-9]+", t.lower())
        stride, want = max(1, len(v) // 8), sh(v)
        best = None
        for at in range(0, len(w), stride):
            part = w[at : at + len(v) + stride - 1]
            if len(part) >= 5 or at == 0:
                c = len(sh(part) & want) / len(want)
                if c >= 0.8 and (best is None or c > best[0]):
                    best = (c, at)
        if best:
            out[name] = best
    return out


def test_licenses_match_brute_force(spark, texts):
    rng = random.Random(4)
    filler = [w for _, t in texts[:20] for w in t.split()]
    rows = []
    for i in range(150):
        name = rng.choice(sorted(licenses.TEMPLATES))
        v = licenses.TEMPLATES[name].split()
        for _ in range(rng.randint(0, 3)):
            v[rng.randrange(len(v))] = rng.choice(filler)
        k = rng.randint(0, 90)
        rows.append((i, " ".join([*rng.choices(filler, k=k), *v, *rng.choices(filler, k=rng.randint(0, 60))])))
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.id, {})[r.template] = (r.containment, r.first_word)
    want = {i: x for i, t in rows if (x := plain_licenses(t, licenses.TEMPLATES))}
    assert len(want) > 60
    assert {i: set(x) for i, x in got.items()} == {i: set(x) for i, x in want.items()}
    assert all(got[i][n] == pytest.approx(v) for i, x in want.items() for n, v in x.items())


def test_licenses_use_no_python_and_take_odd_rows(spark, odd, empty):
    plan = licenses.scan(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan.split("== Physical Plan ==")[1].replace("Scan ExistingRDD[doc_id", ""))
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0
    one = spark.createDataFrame([(None, "Released under the MIT License."), (1, None), (2, "MIT"), (3, "released UNDER the mit-license"), (3, "released UNDER the mit-license")], "doc_id long, text string")
    assert sorted((r.id, r.template) for r in licenses.scan(one).collect() if r.id) == [(3, "mit-line")]
    assert licenses.scan(one).count() == 2


def plain_anchors(t: bytes):
    out = []
    for i in range(len(t) - syncmers.K + 1):
        h = [int(syncmers.mix(plain_hash(t[j : j + syncmers.S])) >> np.uint64(40)) for j in range(i, i + syncmers.K - syncmers.S + 1)]
        if min(h) in (h[0], h[-1]):
            out.append(i)
    return out


def plain_hash(b):
    h = 0
    for x in b:
        h = (h * 0x9E3779B97F4A7C15 + int(syncmers._RNG[x])) % 2**64
    return np.array([h], np.uint64)[0]


def test_anchors_are_the_closed_syncmers():
    t = [b"", b"short", b"the quick brown fox jumps over the lazy dog " * 3, b"another text of some length, quite plain"]
    off = np.concatenate([[0], np.cumsum([len(x) for x in t])])
    _, place, row = syncmers.anchors(np.frombuffer(b"".join(t), np.uint8), off)
    for i, x in enumerate(t):
        assert place[row == i].tolist() == plain_anchors(x)


def test_syncmers_match_a_plain_run(spark, sf_dir, texts):
    got = {r.doc_id: r for r in queries.queries()["op9_syncmers"](spark, sf_dir).collect()}
    order = sorted(texts, reverse=True)
    fp = dict(zip([i for i, _ in order], syncmers.fingerprints([t.encode() for _, t in order])))
    for k, (i, t) in enumerate(order):
        j, nxt = order[(k + 1) % len(order)]
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        r = got.pop(i)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == syncmers.written(fp[i]) and r.near_next == syncmers.likeness(fp[i], fp[j])
        e = syncmers.fingerprints([edited.encode()])[0]
        assert r.edited_fingerprint == syncmers.written(e) and r.near_edited == syncmers.likeness(fp[i], e)
    assert not got


def test_likeness_follows_the_shared_share():
    rng = random.Random(2)
    say = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n)).encode()
    a, b = say(800), say(800)
    for share in (0, 0.3, 0.6, 1):
        cut = int(len(a) * share)
        x, y = syncmers.fingerprints([a, a[:cut] + b[cut:]])
        assert syncmers.likeness(x, y) == pytest.approx(share, abs=0.02)
    x, y = syncmers.fingerprints([a, b"x" * 50 + a])
    assert syncmers.likeness(x, y) > 0.98 and syncmers.likeness(x, x) == 1


@pytest.mark.parametrize("span", [1, 3, 4000])
def test_neighbours_follow_each_other(spark, span):
    ids = [5, 900, 7, 8, 8, None, 31, 2**62, -4]
    docs = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    rows = syncmers.neighbours(docs, span=span).collect()
    own = [r for r in rows if not r.guest]
    assert len(own) == len(ids)
    follow = {r.text: rows[k + 1].text for k, r in enumerate(rows) if not r.guest}
    order, at = ["t7"], "t7"
    while (at := follow[at]) != "t7":
        order.append(at)
    keys = [ids[int(t[1:])] for t in order]
    assert keys == sorted((i for i in ids if i is not None), reverse=True) + [None]


def test_a_short_passage_in_long_texts_is_seen():
    """55 common words in texts of 12,000: a share that a sample of the anchors would miss."""
    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    passage = say(55)
    x, y = syncmers.fingerprints([f"{say(6000)} {passage} {say(6000)}".encode(), f"{say(9000)} {passage} {say(3000)}".encode()])
    assert 30 < syncmers.likeness(x, y) * (len(x[0]) + len(y[0])) / 2 < 100


def test_likeness_is_the_longest_common_order():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 9):
        for _ in range(40):
            p = rng.permutation(n)
            best = max(len(s) for m in range(2**n) if (s := [p[k] for k in range(n) if m >> k & 1]) and s == sorted(s))
            assert syncmers.in_order(p) == best


def test_syncmers_take_any_integer_ids_and_name_others(spark, odd):
    small = odd.selectExpr("cast(doc_id as smallint) as doc_id", "text")
    assert syncmers.compare(small).count() == odd.count() and syncmers.compare(small).schema["id"].dataType.simpleString() == "smallint"
    with pytest.raises(ValueError, match="integer"):
        syncmers.compare(odd.selectExpr("cast(doc_id as string) as doc_id", "text"))


def test_syncmers_on_odd_rows(spark, odd, empty):
    rows = syncmers.compare(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert syncmers.compare(empty).count() == 0
    one = syncmers.compare(odd.where("doc_id = 8")).first()
    assert one.near_next == 1 and one.n_chars == 3
