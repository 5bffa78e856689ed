"""Streams (availableNow) give the same rows as their batch forms."""

from litsearch.catalog import queries as Q
from tests.conftest import SF_SMALL


def rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_stream_search_equals_batch(spark):
    cols = ["query_id", "rk", "pmc_id", "search_score", "paper_count"]
    assert rows(Q.q_stream_search(spark, SF_SMALL), cols) == \
        rows(Q.q_search_iterative(spark, SF_SMALL), cols)


def test_stream_conversation_equals_batch(spark):
    cols = ["event_id", "addr", "conversation_id"]
    assert rows(Q.q_stream_conversation(spark, SF_SMALL), cols) == \
        rows(Q.q_conversation_assign(spark, SF_SMALL), cols)


def test_stream_index_upsert_equals_batch(spark):
    cols = ["object_id", "data", "version"]
    assert rows(Q.q_stream_index_upsert(spark, SF_SMALL), cols) == \
        rows(Q.q_index_upsert(spark, SF_SMALL), cols)


def test_conversations_with_text_ids_over_batches(spark):
    """Text ids, a null address, an address in every batch, and a batch that is run again."""
    from litsearch.session import scratch_path
    from litsearch.streaming.conversation import start_conversation_stream
    src, sink, state, ckpt = (scratch_path(spark, n) for n in ("src", "sink", "state", "ckpt"))
    schema = "request_id string, addr string, ts long"
    batches = [[("r2", "10.0.0.1:1", 5), ("r1", "10.0.0.1:1", 4), ("r3", None, 1)],
               [("r0", "10.0.0.1:1", 1), ("r4", "h", 9), ("r5", "h", 9), ("r6", None, 2)], [("r7", "h", 0)]]
    for rows_ in batches:
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    want = {"r1": "r1", "r2": "r1", "r0": "r1", "r3": "r3", "r6": "r3", "r4": "r4", "r5": "r4", "r7": "r4"}
    for checkpoint in (ckpt, ckpt + "-again"):  # without its checkpoint the stream runs all batches again
        start_conversation_stream(stream, sink, state, checkpoint).awaitTermination()
        got = spark.read.parquet(sink).collect()
        assert len(got) == 8 and {r.request_id: r.conversation_id for r in got} == want


def test_conversations_of_many_addresses_send_none_to_the_driver(spark, monkeypatch):
    """Beyond NAMES_SENT the joins of a micro-batch are shuffled, whatever Spark takes for small; same result."""
    import litsearch.streaming.conversation as C
    from litsearch.session import scratch_path
    from tests.test_plans import plan
    names = spark.createDataFrame([("a", "r")], "addr string, id string")
    assert "SortMergeJoin" in plan(names.join(C.unsent(names, False), "addr"))
    schema = "request_id string, addr string, ts long"
    for most in (2, 100):
        monkeypatch.setattr(C, "NAMES_SENT", most)
        src, sink, state, ckpt = (scratch_path(spark, n) for n in ("src", "sink", "state", "ckpt"))
        for part in (range(30), range(30, 50)):
            rows_ = [(f"r{i}", None if i % 7 == 6 else f"a{i % 7}", i) for i in part]
            spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        C.start_conversation_stream(stream, sink, state, ckpt).awaitTermination()
        assert {r.request_id: r.conversation_id for r in spark.read.parquet(sink).collect()} == {
            f"r{i}": f"r{i % 7}" for i in range(50)}
