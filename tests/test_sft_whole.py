"""Every chain with a question becomes a record."""

from pramana.plans import registry


def test_records_of_odd_keys(spark, sf_dir):
    got = {int(r.problem_id.split("_")[1]): r.gold for r in registry.QUERIES["sft_records"](spark, sf_dir).collect()}
    parts, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "orders"))
    keys = {r[0] for r in parts.select("p_partkey").collect()} & {r[0] for r in orders.select("o_orderkey").collect()}
    assert got == {k: "Yes" if k % 2 == 0 else "no" for k in keys if k % 10 not in (8, 9)} and any(k % 2 for k in got)
