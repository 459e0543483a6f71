import datetime as dt
import json

from pyspark.sql import functions as F

from memloom.operators import graph
from memloom.sources import schema
from memloom.streaming import streams

T = dt.datetime(2024, 1, 1)


def _write(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_ingest_stores_each_exchange_once(spark, tmp_path):
    inbox, root, check = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/check"
    kind = "id long, exchange_id string, created_at timestamp"
    row = lambda i, x: {"id": i, "exchange_id": x, "created_at": "2024-01-01T00:00:00Z"}
    _write(inbox, "a.json", [row(1, "a"), row(2, "a"), row(3, "b")])
    run = lambda: streams.write_new(streams.once_each(streams.posts(spark, str(inbox), kind)), root, check).awaitTermination()
    run()
    _write(inbox, "b.json", [row(4, "b"), row(5, "c")])
    run()
    got = spark.read.parquet(root).select("exchange_id").collect()
    assert sorted(r[0] for r in got) == ["a", "b", "c"]


def test_streamed_compaction_equals_batch(spark, tmp_path):
    log = spark.createDataFrame([(i, i % 3, 5, "semantic", 1.0, T) for i in range(12)], schema.LOG)
    log.repartition(1).write.parquet(f"{tmp_path}/log")
    out = []
    source = spark.readStream.schema(schema.LOG).parquet(f"{tmp_path}/log")
    streams.compaction(source, lambda df, n: out.extend(df.collect()), f"{tmp_path}/check").awaitTermination()
    want = {(r["from_id"], round(r["strength"], 9)) for r in graph.compact(log).collect()}
    assert {(r["from_id"], round(r["strength"], 9)) for r in out} == want


def test_hourly_counts(spark, sf, tmp_path):
    source = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events.parquet*")
    q = streams.hourly(source).writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("hours").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_settled_turns_come_once(spark, tmp_path):
    folder = tmp_path / "turns"
    rows = [{"conv_id": 1, "turn": 1, "role": "user", "text": t, "ts": f"2024-01-01T00:00:0{i}Z"} for i, t in enumerate(["h", "he", "hello"])]
    _write(folder, "a.json", rows)
    kind = "conv_id long, turn long, role string, text string, ts timestamp"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = streams.settled_turns(spark.readStream.schema(kind).json(str(folder)), seconds=5, late="1 second").writeStream.format("memory").queryName("settled").outputMode("append").start()
    try:
        q.processAllAvailable()
        _write(folder, "b.json", [{"conv_id": 2, "turn": 1, "role": "user", "text": "later", "ts": "2024-01-01T01:00:00Z"}])
        q.processAllAvailable()
        _write(folder, "c.json", [{"conv_id": 3, "turn": 1, "role": "user", "text": "last", "ts": "2024-01-01T02:00:00Z"}])
        q.processAllAvailable()
        got = {(r["conv_id"], r["text"]) for r in spark.table("settled").collect()}
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert (1, "hello") in got and not {(1, "h"), (1, "he")} & got
