import hashlib
import random
import re

import pytest

from pramana.llm import queries, substrings


def plain(rows):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - 12):
                x = tuple(w[k : k + 13])
                least[x] = min(least.get(x, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - 12) if i is not None else ():
            if least[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_substrings_match_brute_force(spark, sf_dir, texts):
    got = sorted((tuple(r) for r in queries.queries()["op8_substrings"](spark, sf_dir).collect()), key=str)
    want = plain(texts)
    assert got == want and sum(r[2] for r in want) > 0


@pytest.mark.parametrize("bits", [3, 10, 22])
def test_passages_copies_and_repeats(spark, bits, monkeypatch):
    monkeypatch.setattr(substrings, "COMBINED", 500)
    rng = random.Random(bits)
    say = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(n)]
    shared, rows = [say(rng.randint(10, 60)) for _ in range(4)], []
    for i in range(120):
        w = say(rng.randint(0, 60))
        if i % 3 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(shared)
        if i % 10 == 1:
            w = ["x"] * rng.randint(5, 40)
        rows.append((i if i % 17 else None, " ".join(w)))
    rows += [rows[5], rows[6], (rows[7][0], rows[8][1])]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in substrings.deduplicate(docs, bits=bits, slices=1 + bits).collect()), key=str)
    assert got == plain(rows)


def test_substrings_on_odd_rows(spark, odd, empty):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in substrings.deduplicate(odd).collect()), key=str) == plain(rows)
    assert substrings.deduplicate(empty).count() == 0
    assert {r.kept for r in substrings.deduplicate(odd.where("doc_id in (1, 2)"), with_text=True).collect()} >= {""}


def test_unique_windows_are_left_out_at_any_size(spark):
    """The share of unique windows that pass the filter is small and does not follow the number of documents."""
    rng = random.Random(1)
    for n in (100, 800):
        rows = [(i, " ".join(str(rng.randrange(10**6)) for _ in range(60))) for i in range(n)] + [(10**6 + k, "one two three four five six seven " * 4) for k in range(2)]
        docs = spark.createDataFrame(rows, "id long, text string").selectExpr("id", "xxhash64(text) as th", "text", "true as has_id", "1L as copies")
        slices = -(-n * 12 // 256)
        marked = {r.id for r in substrings.marks(docs, slices, 11).collect()}
        assert {10**6, 10**6 + 1} <= marked and len(marked) < 0.4 * n


def test_text_ids_are_told(spark, odd):
    with pytest.raises(ValueError, match="integer"):
        substrings.deduplicate(odd.selectExpr("cast(doc_id as string) as doc_id", "text"))


def test_repeated_rows_cost_no_more_than_their_texts(spark):
    """Ten thousand equal rows beside others of their passages: what is joined and shuffled does not follow their square."""
    rng = random.Random(4)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(300))
    rows = [(2, text)] * 10_000 + [(1, text[:900]), (3, "tail " + text), (2, "other " + text), (None, text), (-(2**63), text[:400]), (None, text[:400])]
    got = substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)
    one = next(c for c in _nodes(got._jdf.queryExecution().executedPlan()) if "MapInArrow" in c[0] and "kept_sha256" in c[1])
    assert one[2] < 20  # rows that the last step reads: one of each id and text


def _nodes(plan):
    """(name, text, rows of the child) of the nodes of an executed plan, through its stages."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        yield from _nodes(plan.executedPlan())
        return
    if "QueryStage" in name:
        yield from _nodes(plan.plan())
        return
    kids = plan.children()
    rows = -1
    if "MapInArrow" in name:
        metric = plan.metrics().get("pythonNumRowsSent")
        rows = metric.get().value() if metric.isDefined() else 0
    yield name, plan.toString(), rows
    for k in range(kids.size()):
        yield from _nodes(kids.apply(k))
