"""Streams with state of their own: flips of paired runs, and a training log in windows of rows.

Both need a state store that keeps timers and lists, see ``use_rocksdb``. What a stream gives equals what the same
function gives over a table of all its rows, however the rows were cut into batches and also after a restart
from the checkpoint.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from pramana.operators.curate import log_windows

_STORE = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that the processors here need; call it before the first query with state starts."""
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_MICRO = timedelta(microseconds=1)


class _Pairs(StatefulProcessor):
    """Holds what is known of an item until all its conditions are there, or until the watermark passes its time.

    For each condition the earliest row counts. An item whose rows are no more than ``within`` apart is given out
    once; it then stays known, as one flag, until its timer, so that repeated rows change nothing.
    """

    def __init__(self, conditions: list[str], within: timedelta):
        self.conditions, self.within = conditions, within // _MICRO

    def init(self, handle) -> None:
        self.handle = handle
        fields = ", ".join(f"t{k} bigint, c{k} int" for k in range(len(self.conditions)))
        self.known = handle.getValueState("known", f"done boolean, kind string, {fields}")

    def handleInputRows(self, key, rows, timerValues):
        n = len(self.conditions)
        held = list(self.known.get()) if self.known.exists() else None
        state = held or [False, None, *[None, None] * n]
        for r in rows:
            if r["condition"] not in self.conditions or state[0]:
                continue
            k = 2 + 2 * self.conditions.index(r["condition"])
            new = (r["micros"], r["correct"])
            if state[k] is None or new < (state[k], state[k + 1]):
                state[k], state[k + 1] = new
            if r["condition"] == self.conditions[0]:
                state[1] = r["kind"]
        times = [t for t in state[2::2] if t is not None]
        if not times:
            return
        if not state[0] and len(times) == n and max(times) - min(times) <= self.within:
            right, a, b = state[3], state[5], state[7]
            state[0] = True
            yield Row(id=key[0], kind=state[1], ts=_EPOCH + min(times) * _MICRO, right=right, flip_a=int(right == 1 and a == 0), flip_b=int(right == 1 and b == 0))
        self.known.update(tuple(state))
        if held is None:
            self.handle.registerTimer((min(times) + self.within) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.known.clear()
        return iter([])

    def close(self) -> None:
        pass


def paired_items(rows: DataFrame, a: str, b: str, within: timedelta, late: str = "1 hour", plain: str = "plain") -> DataFrame:
    """(id, kind, ts, right, flip_a, flip_b) of each item that has rows of all three conditions within ``within``.

    rows: (id, condition, kind, correct, ts), a stream or a table. The earliest row of an item and condition counts, of
    two at one time the wrong one; ts is the item's first. Rows without id, condition, correct or ts take no part.
    A stream drops rows that are more than ``late`` behind the newest, and forgets an item once ``within`` has passed
    since its first row, complete or not: its state follows the number of items in that time, not those ever seen.
    """
    conditions = [plain, a, b]
    named = rows.select("id", "condition", "kind", F.col("correct").cast("int").alias("correct"), F.col("ts").cast("timestamp").alias("ts"))
    named = named.where("id is not null and correct is not null and ts is not null").where(F.col("condition").isin(conditions))
    kinds = f"id {dict(named.dtypes)['id']}, kind {dict(named.dtypes)['kind']}, ts timestamp, right int, flip_a int, flip_b int"
    if rows.isStreaming:
        marked = named.withColumn("micros", F.unix_micros("ts")).withWatermark("ts", late)
        return marked.groupBy("id").transformWithState(_Pairs(conditions, within), kinds, "Append", "EventTime", eventTimeColumnName="ts")
    first = lambda c, what: F.min(F.when(F.col("condition") == c, F.struct("ts", "correct", "kind")))[what]
    items = named.groupBy("id").agg(first(plain, "kind").alias("kind"), *[first(c, w).alias(f"{w[0]}{k}") for k, c in enumerate(conditions) for w in ("ts", "correct")])
    whole = items.where("t0 is not null and t1 is not null and t2 is not null")
    near = whole.where(F.unix_micros(F.greatest("t0", "t1", "t2")) - F.unix_micros(F.least("t0", "t1", "t2")) <= F.lit(within // _MICRO))
    flip = lambda k: ((F.col("c0") == 1) & (F.col(k) == 0)).cast("int")
    return near.select("id", "kind", F.least("t0", "t1", "t2").alias("ts"), F.col("c0").alias("right"), flip("c1").alias("flip_a"), flip("c2").alias("flip_b"))


def flip_sums(items: DataFrame, window: str = "1 day") -> DataFrame:
    """(start, kind, n, right, flips_a, flips_b): what flip rates and their gap need, by window of the items' first times."""
    g = items.groupBy(F.window("ts", window).alias("w"), "kind").agg(F.count("*").alias("n"), F.sum("right").alias("right"), F.sum("flip_a").alias("flips_a"), F.sum("flip_b").alias("flips_b"))
    return g.select(F.col("w.start").alias("start"), "kind", "n", "right", "flips_a", "flips_b")


def gaps(sums: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, n_correct, flip, flip_control, gap) from sums of any windows; strata without right items are left out."""
    s = sums.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "right", "flips_a", "flips_b")]).where("right > 0")
    x, y = F.col("flips_a") / F.col("right"), F.col("flips_b") / F.col("right")
    return s.select(*by, "n", F.col("right").alias("n_correct"), x.alias("flip"), y.alias("flip_control"), (x - y).alias("gap"))


class _Windows(StatefulProcessor):
    """Of each log the window that is not full yet: rows, first and last row, and a sum and a count for each mean."""

    def __init__(self, size: int, order: str, whole: list[str], ran: list[str], kind: str):
        self.size, self.order, self.whole, self.ran, self.kind = size, order, whole, ran, kind

    def init(self, handle) -> None:
        sums = ", ".join(f"s{k} double, n{k} bigint" for k in range(len(self.whole) + len(self.ran)))
        self.open = handle.getValueState("open", f"place bigint, n bigint, run bigint, low {self.kind}, low_sec double, high {self.kind}, high_sec double" + (f", {sums}" if sums else ""))

    def _row(self, key, s):
        means = [s[7 + 2 * k] / s[8 + 2 * k] if s[8 + 2 * k] else None for k in range(len(self.whole) + len(self.ran))]
        means = means[: len(self.whole)] + [m if m is not None else 0.0 for m in means[len(self.whole) :]]
        pace = (s[6] - s[4]) / max(s[1] - 1, 1)
        return Row(part=key[0], window=s[0], n=s[1], first_step=s[3], last_step=s[5], skip_rate=1 - s[2] / s[1], **dict(zip(self.whole + self.ran, means)), sec_per_step=pace)

    def handleInputRows(self, key, rows, timerValues):
        new = lambda place: [place, 0, 0, None, None, None, None, *[0.0, 0] * (len(self.whole) + len(self.ran))]
        s = list(self.open.get()) if self.open.exists() else new(0)
        touched = False
        for r in sorted(rows, key=lambda r: r[self.order]):
            run = not r["skipped"]
            s[1] += 1
            s[2] += run
            if s[3] is None:
                s[3], s[4] = r[self.order], r["sec"]
            s[5], s[6] = r[self.order], r["sec"]
            for k, c in enumerate(self.whole + self.ran):
                if r[c] is not None and (run or k < len(self.whole)):
                    s[7 + 2 * k] += r[c]
                    s[8 + 2 * k] += 1
            touched = True
            if s[1] == self.size:
                yield self._row(key, s)
                s, touched = new(s[0] + 1), False
        if touched:
            yield self._row(key, s)
        self.open.update(tuple(s))

    def close(self) -> None:
        pass


def tail_windows(log: DataFrame, size: int, order: str = "step", part: str = "run") -> DataFrame:
    """``log_windows`` of each log ``part``, over a stream that appends to it: a row for each window as it grows.

    In update mode a window's last row is the one that counts: full windows come once, the one still open again with every
    batch that adds to it. Batches follow ``order``; within a batch the rows of a log are sorted, so a batch should hold
    what a task can sort (``maxFilesPerTrigger``). The state is one open window a log. Rows without ``order`` are left out.
    """
    log = log.where(F.col(order).isNotNull())
    if not log.isStreaming:
        return log_windows(log, size, order, part).withColumnRenamed(part, "part")
    has = log.columns
    whole = [c for c in has if c in ("reward", "comp_len", "steps_credited") or c.startswith("r_")]
    ran = [c for c in ("kl", "grad_norm", "kl_clip_frac") if c in has]
    kind = dict(log.dtypes)[order]
    typed = log.select(part, order, F.col("sec").cast("double").alias("sec"), F.coalesce("skipped", F.lit(False)).alias("skipped"), *[F.col(c).cast("double").alias(c) for c in whole + ran])
    means = "".join(f", {c} double" for c in whole + ran)
    out = f"part {dict(log.dtypes)[part]}, window bigint, n bigint, first_step {kind}, last_step {kind}, skip_rate double{means}, sec_per_step double"
    return typed.groupBy(part).transformWithState(_Windows(size, order, whole, ran, kind), out, "Update", "None")
