"""Queries that do their whole job where the one with SQL beside them does a part of it."""

from collections import Counter

from pramana.plans import catalogue


def plain_letters(text, n=5):
    """A scan by characters: capitals that stand alone, else a text of letters, commas and blanks only."""
    wordy = lambda c: c.isalnum() or c == "_"
    words = "".join(c if wordy(c) else " " for c in text).split()
    if any(w.lower() == "none" for w in words) and not any(len(w) == 1 and w in "ABCDEFGH" for w in words):
        return ""
    big = f" {text.upper()} "
    latin = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    alone = {b for a, b, c in zip(big, big[1:], big[2:]) if b in "ABCDE"[:n] and not {a, c} & latin}
    if alone:
        return "".join(sorted(alone))
    rest = set(big.strip()) - set(", ")
    return "".join(sorted(rest & set("ABCDE"[:n]))) if rest and rest <= set("ABCDEFGH") else ""


def test_letters_of_whole_texts(spark, sf_dir, tmp_path):
    """Letters after character 60, rows with none, and compact strings."""
    rows = ["AC", "E, A", "none of them", "none but B", "nonesuch d", "x" * 80 + " B", "none " + "x" * 80 + " C", "F", ""]
    spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for d in (str(tmp_path), sf_dir):
        texts = [r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("text").collect()]
        got = {r.letters: r.n for r in catalogue.QUERIES["parse_option_letters_whole"](spark, d).collect()}
        assert got == Counter(map(plain_letters, texts))


def test_every_box_has_a_control(spark, sf_dir):
    boxes = catalogue.D.boxes(spark, sf_dir)
    got = catalogue.QUERIES["avoiding_control"](spark, sf_dir)
    assert got.count() == boxes.count() and got.where("item % 10 <> 0").count() > 0


def test_intervals_over_all_replicates(spark, sf_dir):
    for name in ("bootstrap_gap_ci_whole", "bootstrap_gap_poisson"):
        assert catalogue.QUERIES[name](spark, sf_dir).first().n_reps == 2000


def test_pool_has_every_id(spark, sf_dir):
    """Ids of one tag count once in the pool, those of two tags twice."""
    a, b = catalogue.A.PAIRS["es"]
    w = catalogue.A.wide(catalogue.D.runs(spark, sf_dir), ["plain", a, b])
    ids = [r.id for r in w.where(f"plain = 1 and {a} is not null and {b} is not null").collect()]
    got = {r.stratum: r.n_correct for r in catalogue.QUERIES["pooled_gap_whole"](spark, sf_dir).collect()}
    assert got["pool"] == sum(1 + (i % 6 == 0) for i in ids) and got["c"] == sum(i % 6 in (1, 5) for i in ids)
