"""Structured Streaming: decode files as they arrive, number lists and sequences with state kept for each document."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BINARY_FILES = "path string, modificationTime timestamp, length long, content binary"


def files(spark: SparkSession, path: str, pattern: str = "*.docx", most_bytes: int | None = None, per_batch: int = 1000) -> DataFrame:
    """A stream of (path, content); files over most_bytes are filtered by their length, before their content is read."""
    stream = spark.readStream.format("binaryFile").schema(BINARY_FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(path)
    return (stream.where(F.col("length") <= most_bytes) if most_bytes else stream).select("path", "content")


def docx_blocks(spark: SparkSession, path: str, **options) -> DataFrame:
    from pagemill.sources import docx

    return docx.read(files(spark, path, "*.docx", **options))


def number_series(events: DataFrame, doc: str = "doc_id", series: str = "series", order: str = "ord", reset: str = "reset_to", repeat: str = "repeats") -> DataFrame:
    """(doc, series, ord, seq): running numbers of a stream. State is one number for each (doc, series); a batch is sorted by order."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (0,)
        pdf = pd.concat(list(frames)).sort_values(order)
        out = []
        for r, same in zip(pdf[reset], pdf[repeat], strict=True):
            last = int(r) if pd.notna(r) else last if same else last + 1
            out.append(last)
        state.update((last,))
        yield pd.DataFrame({doc: key[0], series: key[1], order: pdf[order], "seq": out})

    return events.groupBy(doc, series).applyInPandasWithState(step, f"{doc} {kinds[doc]}, {series} {kinds[series]}, {order} {kinds[order]}, seq long", "last long", "append", GroupStateTimeout.NoTimeout)


def list_labels(items: DataFrame, levels: dict[int, dict], by: str = "doc_id") -> DataFrame:
    """Labels of list items (by, num_id, ord, level) in a stream; state is the nine counters of each (by, num_id)."""
    from pagemill.operators.numbering import Counters

    kind = items.schema[by].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counters = Counters(levels.get(int(key[1]), {}))
        if state.exists:
            value, started = state.get
            counters.value, counters.started = list(value), list(started)
        pdf = pd.concat(list(frames)).sort_values("ord")
        labels = []
        for level in pdf["level"].astype(int):
            counters.advance(level)
            labels.append(counters.label(level))
        state.update((counters.value, counters.started))
        yield pd.DataFrame({by: key[0], "num_id": key[1], "ord": pdf["ord"], "label": labels})

    return items.groupBy(by, "num_id").applyInPandasWithState(step, f"{by} {kind}, num_id int, ord int, label string", "value array<int>, started array<boolean>", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums of events (ts, event_type, value) for each window, late rows dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide or size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def write_files(blocks: DataFrame, path: str, checkpoint: str, id_col: str = "doc_id", most_rows: int | None = None):
    """A running query that writes each batch's documents (block rows id, ord, kind, style, text) as packages: a table (id, content,
    batch) at path. A document's rows must arrive in one batch; a batch that is run again replaces what it wrote before."""
    from pagemill.sources import docx

    def save(batch: DataFrame, number: int) -> None:
        made = docx.write(batch, id_col)
        made.write.mode("overwrite").option("maxRecordsPerFile", most_rows or 0).parquet(f"{path.rstrip('/')}/batch={number}")

    return blocks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save).start()


class Cancelled(RuntimeError):
    """What a cancelled action raises."""


class Cancellation:
    """Actions run under a tag; cancel, from any thread, ends those that run and refuses those to come."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag, self.gone = spark, f"cancel-{uuid.uuid4().hex}", False

    def run(self, action: Callable):
        """The result of action(), whose Spark jobs carry the tag."""
        if self.gone:
            raise Cancelled(self.tag)
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            return action()
        except Exception as e:
            raise Cancelled(self.tag) if self.gone else e
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)

    def cancel(self) -> None:
        self.gone = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)
