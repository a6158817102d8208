import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quarry.operators import elements, enrich, incremental
from quarry.schema import EVENT
from quarry.streaming import events as s

T0 = datetime(2024, 1, 1)


def rows(spark, *items):
    return spark.createDataFrame([(T0 + timedelta(seconds=t), k, p, d) for t, k, p, d in items], EVENT)


def test_debounce_stream_equals_batch(spark, tmp_path):
    gaps = [(0, "a"), (1.9, "a"), (2.0, "a"), (3.9, "a"), (4.0, "a"), (0.5, "b"), (3.0, "b")]
    first = rows(spark, *[(t, "modify", p, None) for t, p in gaps[:3]])
    second = rows(spark, *[(t, "modify", p, None) for t, p in gaps[3:]])
    seen = []

    def turn(rows):
        stream = s.debounced_stream(s.event_files(spark, f"{tmp_path}/in"))
        sink = stream.writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/cp")
        q = sink.outputMode("append").start()  # runs on, as states can time out without new data
        end = time.time() + 60
        while len(seen) < rows and time.time() < end:
            time.sleep(0.2)
        q.stop()

    first.coalesce(1).write.parquet(f"{tmp_path}/in")
    turn(2)
    second.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    turn(5)  # goes on with the state of the first
    got = {(r["path"], r["ts"]) for r in seen}
    batch = {(r["path"], r["ts"]) for r in incremental.debounced(first.union(second), 2.0, ["kind", "path"]).collect()}
    assert got == batch and sorted((p, (t - T0).total_seconds()) for p, t in got) == [("a", 0), ("a", 2), ("a", 4), ("b", 0.5), ("b", 3)]


def test_moves(spark):
    e = rows(spark, (0, "move", "a.txt", "b.txt"), (1, "move", "c.txt", "d.bin"), (2, "create", "x.bin", None), (3, "delete", "y.bin", None), (4, "modify", "z.txt", None))
    got = [(r["kind"], r["path"]) for r in s.split_moves(e, (".txt",)).orderBy("ts", "step").collect()]
    assert got == [("delete", "a.txt"), ("create", "b.txt"), ("delete", "y.bin"), ("modify", "z.txt")]


def test_batches_are_routed(spark, tmp_path):
    rows(spark, (0, "create", "a", None), (1, "modify", "a", None), (0, "create", "b", None), (2, "delete", "b", None), (0, "create", "c", None)).write.parquet(f"{tmp_path}/in")
    gone, done = [], []
    run = s.apply_batch(lambda df: gone.extend(r["file_path"] for r in df.collect()), lambda df: done.extend((r["priority"], r["file_path"]) for r in df.collect()))
    q = s.event_files(spark, f"{tmp_path}/in").writeStream.foreachBatch(run).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert gone == ["b"] and done == [(3, "c"), (5, "a")]


def test_snapshot_events(spark):
    found = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "file_path string, modified_time string")
    registry = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "3")], "file_path string, modified_time string")
    assert sorted((r["kind"], r["path"]) for r in s.snapshot_events(found, registry, True).collect()) == [("create", "d"), ("delete", "c"), ("modify", "b")]
    assert s.snapshot_events(found, registry).count() == 2


def test_queue(spark):
    r = spark.createDataFrame([("a", 8), ("a", 3), ("b", 5), ("c", 5), ("d", 3)], "file_path string, priority int")
    done = spark.createDataFrame([("d",)], "file_path string")
    assert [tuple(x) for x in incremental.queued(r, done=done).collect()] == [("a", 3), ("b", 5), ("c", 5)]
    assert s.failures(spark, [("a", "broken")]).first()["error"] == "broken"


def test_streams_merge_by_page(spark):
    a = spark.createDataFrame([("2", 0), ("10", 1), (None, 2)], "page_or_sheet string, seq int")
    b = spark.createDataFrame([("2", 0), ("x", 1)], "page_or_sheet string, seq int").withColumn("extra", F.lit(1))
    assert [(x["page_or_sheet"], x["source_rank"]) for x in elements.merged(a, b).collect()] == [(None, 0), ("x", 1), ("2", 0), ("2", 1), ("10", 0)]


class Broken:
    def available(self):
        return True

    def summarise(self, text, most):
        raise RuntimeError

    def keywords(self, text, most):
        return "one, two words, x, " + "y" * 60 + ", three"


def test_language_model(spark):
    df = spark.createDataFrame([(1, "Some words here. More words."), (2, ""), (3, None)], "i int, text string")
    got = {r["i"]: r for r in enrich.describe(df, Broken()).collect()}
    assert got[1]["summary"] == "Some words here. More words.." and got[1]["keywords"] == ["one", "two words", "three"]
    assert got[2]["summary"] == got[3]["summary"] == "Empty document" and got[2]["embedding_text"] == ""
    none = {r["i"]: r for r in enrich.describe(df, enrich.FunctionModel()).collect()}
    assert none[1]["keywords"] == ["words", "some", "here", "more"]
    m = enrich.FunctionModel(lambda p: "long answer " * 99, "m:1", lambda: ["m:latest"])
    made = enrich.describe(df, m, most=50).where("i = 1").first()["summary"]
    assert m.available() and len(made) <= 53 and made.endswith("...")
    assert not enrich.FunctionModel(lambda p: p, "q", lambda: ["m"]).available()
