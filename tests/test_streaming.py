"""The tool-event decision in batch and as a stream, and incremental ingestion."""

import json
import time

from pyspark.sql import functions as F

from tessella.streaming import events as S


def line(kind, **event):
    return json.dumps({"type": "stream_event", "event": {"type": kind, **event}})


TRIALS = {
    "hit": [line("content_block_start", content_block={"type": "tool_use", "name": "Skill"}), line("content_block_delta", delta={"type": "input_json_delta", "partial_json": '{"skill": "my'}), line("content_block_delta", delta={"type": "input_json_delta", "partial_json": '-tool"}'}), line("message_stop")],
    "other_name": [line("content_block_start", content_block={"type": "tool_use", "name": "Skill"}), line("content_block_delta", delta={"partial_json": '{"skill": "x"}'}), line("message_stop")],
    "other_tool": [line("content_block_start", content_block={"type": "tool_use", "name": "Bash"}), line("content_block_delta", delta={"partial_json": "my-tool"}), line("message_stop")],
    "second_tool": [line("content_block_start", content_block={"type": "tool_use", "name": "Skill"}), line("content_block_start", content_block={"type": "tool_use", "name": "Skill"}), line("content_block_delta", delta={"partial_json": "my-tool"})],
    "no_tool": ["not json {", line("message_stop")],
}
WANT = {"hit": True, "other_name": False, "other_tool": False, "second_tool": False, "no_tool": False}


def table(spark):
    return spark.createDataFrame([(t, i, x) for t, lines in TRIALS.items() for i, x in enumerate(lines)], "trial_id string, seq long, line string")


def test_batch(spark):
    got = {r.trial_id: r.triggered for r in S.decide(S.parse(table(spark)), "my-tool", ("Skill", "Read")).collect()}
    assert got == WANT


def test_stream(spark, tmp_path):
    table(spark).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("trial_id string, seq long, line string").json(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = S.decide_stream(S.parse(stream), "my-tool", ("Skill", "Read"), 500).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        for _ in range(120):
            got = {r.trial_id: r.triggered for r in spark.sql("SELECT * FROM decided").collect()}
            if len(got) == len(WANT):
                break
            time.sleep(0.5)
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert got == WANT


def test_ingest_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []
    files = lambda: spark.readStream.schema("value string").text(str(tmp_path / "in"))
    for n in ("a", "b"):
        (tmp_path / "in" / n).write_text(n)
        S.ingest_batches(files(), lambda df, _: seen.extend(r.value for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert seen == ["a", "b"]


def test_live_report(spark, tmp_path):
    spark.createDataFrame([("a",), ("a",), ("b",)], "k string").write.json(str(tmp_path / "in"))
    out = []
    counts = spark.readStream.schema("k string").json(str(tmp_path / "in")).groupBy("k").agg(F.count("*").alias("n"))
    S.live_report(counts, lambda df, _: out.append(sorted(map(tuple, df.collect()))), str(tmp_path / "cp")).awaitTermination()
    assert out[-1] == [("a", 2), ("b", 1)]
