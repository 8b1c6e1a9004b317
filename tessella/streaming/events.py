"""NDJSON tool events: parsing, the trigger decision in batch and as a stateful stream, and incremental ingestion (STM, SRC18, JSN02)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FIELDS = "type string, event struct<type:string,content_block:struct<type:string,name:string>,delta:struct<type:string,partial_json:string>>"


def parse(lines: DataFrame) -> DataFrame:
    """SRC18: trial_id, seq, kind, tool, piece of each line; lines that aren't JSON are skipped."""
    e = F.from_json("line", FIELDS, {"mode": "PERMISSIVE"})
    rows = lines.withColumn("e", e).where(F.col("e.type").isNotNull())
    return rows.select("trial_id", "seq", F.coalesce("e.event.type", "e.type").alias("kind"), F.when(F.col("e.event.content_block.type") == "tool_use", F.col("e.event.content_block.name")).alias("tool"), F.col("e.event.delta.partial_json").alias("piece"))


def decide(events: DataFrame, name: str, tools: tuple[str, ...]) -> DataFrame:
    """STM02, JSN02 in batch: trial_id, triggered.

    A trial's first tool decides: if it is one of `tools`, its input, put together from the pieces up to the next tool, must
    name `name`; any other tool, and a trial without tools, isn't triggered. A trial's events are few and bounded by its time limit.
    """
    by = Window.partitionBy("trial_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("nth", F.sum(F.col("tool").isNotNull().cast("int")).over(by))
    first = rows.where("nth <= 1").groupBy("trial_id").agg(
        F.max(F.when(F.col("nth") == 1, F.col("tool"))).alias("tool"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("nth") == 1) & F.col("piece").isNotNull(), F.struct("seq", "piece")))), lambda x: x["piece"]), "").alias("input"),
    )
    return first.select("trial_id", F.coalesce(F.col("tool").isin(*tools) & F.contains("input", F.lit(name)), F.lit(False)).alias("triggered"))


class _Decision(StatefulProcessor):
    """State of a trial: its first tool and that tool's input so far."""

    def __init__(self, name: str, tools: tuple[str, ...], timeout_ms: int):
        self.name, self.tools, self.timeout_ms = name, tools, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("trial", "tool string, input string, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        tool, text, done = self.state.get() if self.state.exists() else (None, "", False)
        if not self.state.exists():
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.timeout_ms)
        verdict = None
        for pdf in rows:
            for kind, t, piece in pdf.sort_values("seq")[["kind", "tool", "piece"]].itertuples(index=False):
                if done:
                    break
                if isinstance(t, str):
                    verdict = False if tool is not None or t not in self.tools else verdict
                    tool = tool or t
                elif isinstance(piece, str) and tool is not None:
                    text += piece
                    verdict = True if self.name in text else verdict
                elif kind in ("message_stop", "result"):
                    verdict = bool(verdict)
                done = verdict is not None
        self.state.update((tool, text, done))
        if done and verdict is not None:
            yield pd.DataFrame({"trial_id": [key[0]], "triggered": [verdict]})

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        done = self.state.get()[2] if self.state.exists() else True
        self.state.clear()
        if not done:
            yield pd.DataFrame({"trial_id": [key[0]], "triggered": [False]})

    def close(self) -> None:
        pass


def decide_stream(events: DataFrame, name: str, tools: tuple[str, ...], timeout_ms: int = 30_000) -> DataFrame:
    """STM02, STM03: the same over a stream; a trial that is undecided after `timeout_ms` isn't triggered."""
    return events.groupBy("trial_id").transformWithStateInPandas(_Decision(name, tools, timeout_ms), "trial_id string, triggered boolean", "append", "processingTime")


def ingest_batches(files: DataFrame, process, checkpoint: str):
    """STM01, STM06: a file stream whose batches go through `process(batch, epoch)`; hashes decide there what is new."""
    return files.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_report(results: DataFrame, write, checkpoint: str):
    """STM04: rewrites a report of complete aggregates after each batch."""
    return results.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_counts(events: DataFrame, ts: str = "ts", length: str = "1 hour", value: Column | None = None) -> DataFrame:
    """An extension: counts per event-time window; with a watermark on `events` it also runs as a stream."""
    return events.groupBy(F.window(ts, length).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")
