"""Running statistics over streams of result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_accuracy(rows: DataFrame, time: str = "ts", delay: str = "1 hour", window: str = "1 day", key: str = "id", kind: str = "question_type") -> DataFrame:
    """Accuracy by type and window of event time, each id once; rows later than ``delay`` are left out.

    Works on streams and on tables. A file source with a checkpoint resumes where it stopped.
    """
    once = rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key]) if rows.isStreaming else rows.dropDuplicates([key])
    return once.groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("correct").alias("right")).select(F.col("w.start").alias("start"), kind, "n", (F.col("right") / F.col("n")).alias("accuracy"))


def score_with(df: DataFrame, backend, schema: str, prompt: str = "prompt") -> DataFrame:
    """Runs a model over prompts, one backend object for each task. ``backend()`` returns an object with ``generate_batch(list of str)``."""
    columns = df.columns

    def run(batches):
        model = backend()
        for pdf in batches:
            yield pdf.assign(raw=model.generate_batch(pdf[prompt].tolist()))[[*columns, "raw"]]

    return df.mapInPandas(run, schema)


def append_runs(rows: DataFrame, path: str, checkpoint: str, **trigger):
    """Starts to append a stream of result rows as JSON lines, a folder for each tag and condition; gives the running query.

    A batch stands whole or not at all, also after a restart from ``checkpoint``: what is read while it runs has no half rows. ``readers.run_rows``
    takes the last of repeated ids. ``trigger`` is of ``DataStreamWriter.trigger``, as in ``availableNow=True``.
    """
    w = rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).partitionBy("tag", "condition").outputMode("append")
    return (w.trigger(**trigger) if trigger else w).start()
