"""Chains with steps taken out, scored through a backend, and the credit of steps that follows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pramana.functions import codec as C
from pramana.functions.joins import dealt
from pramana.operators.calls import memoized
from pramana.operators.rewards import necessity_by


def lines_of(chain) -> Column:
    """The step lines of a chain, without tags; empty for a chain without steps."""
    return F.array_join(F.transform(chain, C.render_step), "\n")


def variants(chains: DataFrame, keys: list[str], chain: str = "chain") -> DataFrame:
    """(keys, step, text): each chain whole, as step -1, and without each step and all that rests on it."""
    c = F.col(chain)
    deps = F.transform(c, lambda s: s["deps"])
    each = chains.where(c.isNotNull() & (F.size(c) > 0)).select(*keys, c.alias("_c"), deps.alias("_d"), F.explode(F.sequence(F.lit(-1), F.size(c) - 1)).alias("step"))
    text = F.when(F.col("step") < 0, lines_of(F.col("_c"))).otherwise(lines_of(C.without_step(F.col("_c"), F.col("_d"), F.col("step"))))
    return each.select(*keys, "step", text.alias("text"))


def deltas(chains: DataFrame, key: str, prompt: str, gold: str, backend, path: str, chain: str = "chain") -> DataFrame:
    """(key, step, delta): how much likelier the right answer is with a step than without it and what rests on it.

    ``backend`` (see ``calls.memoized``) gives the logarithm of the right answer's probability for dicts of prompt, gold and text.
    Steps of one chain may be asked in different tasks and equal texts under one prompt are asked once; what comes back is
    regrouped by the chain's key, a row for each step. Chains without steps have no rows.
    """
    v = variants(chains, [key, prompt, gold], chain)
    asked = {"prompt": F.col(prompt), "gold": F.col(gold), "text": F.col("text")}
    said = memoized(v, asked, "prompt", backend, "double", path).select(key, "step", F.exp("result").alias("p"))
    whole = said.where("step = -1").select(key, F.col("p").alias("full"))
    return said.where("step >= 0").join(dealt(whole), key).select(key, "step", (F.col("full") - F.col("p")).alias("delta"))


def necessity_scores(found: DataFrame, key: str, delta: float, eps: float, gamma: float) -> DataFrame:
    """(key, necessity) from ``deltas``: the share of steps that matter less a multiple of the share that change nothing."""
    return necessity_by(found, [key], "delta", delta, eps, gamma)


def step_credits(found: DataFrame, delta: float, eps: float, gamma: float) -> DataFrame:
    """``deltas`` with ``credit``: 1 for a step that matters, -gamma for one that changes nothing, else 0."""
    d = F.col("delta")
    return found.withColumn("credit", F.when(d > delta, 1.0).when(d <= eps, -gamma).otherwise(0.0))


def step_advantages(credits: DataFrame, group: str, credit: str = "credit", least: float = 1e-6) -> DataFrame:
    """Adds ``advantage``: a step's credit less its group's mean, in standard deviations of all steps of the group's chains.

    Null in a group of one step or without spread. A join with the groups' statistics: a large group is not in one task.
    """
    g = credits.groupBy(group).agg(F.avg(credit).alias("_m"), F.stddev_pop(credit).alias("_s"), (F.max(credit) - F.min(credit)).alias("_range"), F.count(credit).alias("_n"))
    value = F.when((F.col("_n") > 1) & (F.col("_range") > least), (F.col(credit) - F.col("_m")) / (F.col("_s") + 1e-4))
    return credits.join(g, group).withColumn("advantage", value).drop("_m", "_s", "_range", "_n")


def _token_ranges(texts: pa.Array, pieces: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, parts, wanted in zip(texts, pieces, spans):
        raw = None if text.as_py() is None else text.as_py().encode()
        said = [p.as_py() or b"" for p in parts.values] if parts.is_valid else None
        if raw is None or said is None or not wanted.is_valid or b"".join(said).strip() != raw.strip():
            out.append([])
            continue
        ends = np.cumsum([len(p) for p in said])
        # bytes of each character, so that a span's bounds are bytes too; white space before may differ
        shift = len(b"".join(said)) - len(b"".join(said).lstrip()) - (len(raw) - len(raw.lstrip()))
        heads = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        at = np.append(heads, len(raw)) + shift
        bounds = np.array([[s["start"], s["end"]] for s in wanted.as_py()], np.int64).reshape(-1, 2)
        first, last = at[bounds[:, 0]], at[bounds[:, 1]]
        # both lists are sorted: the first token that ends after a span begins, the last that begins before it ends
        a = np.searchsorted(ends, first, "right")
        z = np.searchsorted(np.append(0, ends[:-1]) if len(ends) else ends, last, "left")
        out.append([{"start": int(x), "end": int(y)} if x < y else None for x, y in zip(a, z)])
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))


def token_ranges(text, pieces, spans) -> Column:
    """The range of tokens of each character span of a text, null for a span without any; empty if the tokens do not give the text.

    pieces: the bytes of each token, special ones left out; a token that is part of a character counts to its span.
    """
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.arrow_udf(_token_ranges, "array<struct<start:int,end:int>>")(c(text), c(pieces), c(spans))
