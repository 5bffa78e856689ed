"""The dump source's byte ranges, its stream, and repeats of records that do not decode."""

import io
import os
import random

import pytest
from pyspark.sql import functions as F

from litsearch.sources.dumps import END, records_in, register
from litsearch.streaming.ingest import outcomes, read_papers, start_ingest_stream


def article(pmc, title="T", end="</front>"):
    return (f'<article><front><article-meta><article-id pub-id-type="pmc">{pmc}</article-id><title-group>'
            f"<article-title>{title}</article-title></title-group></article-meta>{end}"
            "<sub-article><p>x</p></sub-article></article>")


@pytest.mark.parametrize("seed", range(4))
def test_ranges_hold_every_record_once(seed, monkeypatch):
    monkeypatch.setattr("litsearch.sources.dumps.READ_BYTES", 50)
    rng = random.Random(seed)
    parts = [article(i, "ü" * rng.randrange(60)) + rng.choice(["", "\n", "<!-- between -->"]) for i in range(30)]
    data = ("<set>" + "".join(parts) + "</set>").encode()
    want = [p[:p.rindex("</article>") + len(END)].encode() for p in parts]
    for size in [1, 7, 10, 11, 100, 333, len(data)][seed % 2::2]:
        got = [r for at in range(0, len(data), size)
               for r in records_in(io.BytesIO(data), at, min(at + size, len(data)))]
        assert [b for _, b in got] == want
        assert all(data[o:o + len(b)] == b for o, b in got)


def test_source_in_batch(spark, tmp_path):
    register(spark)
    (tmp_path / "b").mkdir()
    (tmp_path / "a.xml").write_text("<set>" + "".join(article(i) for i in range(20)) + "<article><front>")
    (tmp_path / "b" / "c.xml").write_text(article("x"))
    (tmp_path / "_left_out").write_text(article("y"))
    (tmp_path / "empty.xml").write_text("")
    read = lambda p: spark.read.format("article_dumps").option("splitBytes", "64").load(os.fspath(p))
    rows = read(tmp_path).collect()
    assert len(rows) == 22 and len({(r.file, r.offset) for r in rows}) == 22
    one = read(tmp_path).where(F.col("file") == os.fspath(tmp_path / "b" / "c.xml"))
    assert [r.article_xml for r in one.collect()] == [article("x")]
    assert one.rdd.getNumPartitions() == -(-len(article("x")) // 64)  # no other file is planned
    assert [r.article_xml for r in read(tmp_path / "a.xml").collect()][-1] == "<article><front>"
    assert read(tmp_path / "none").count() == 0


def test_one_repeat_then_rejected(spark, tmp_path):
    dumps, log, checkpoint = (os.fspath(tmp_path / n) for n in ("dumps", "log", "checkpoint"))
    os.mkdir(dumps)
    broken = "\n</frnt>"
    deliveries = [
        [article("good", "first"), article("late", end=broken), article("never", end=broken), article("waits", "&no;")],
        [article("good", "second"), article("late", "repaired"), article("never", end="</fron>")],
        [article("late", "third"), article("never", "too late"), article("late", end=broken), "<article>no id"]]

    def deliver(number):
        with open(f"{dumps}/{9 - number}.xml", "w") as f:
            f.write("".join(deliveries[number]))
        os.utime(f"{dumps}/{9 - number}.xml", (10 + number, 10 + number))

    def state():
        return {r.record: r for r in outcomes(spark, log).collect()}

    for number in range(3):
        deliver(number)
        start_ingest_stream(spark, dumps, log, checkpoint).awaitTermination()
        if not number:
            assert {k: v.outcome for k, v in state().items()} == {
                "good": "accepted", "late": "waiting", "never": "waiting", "waits": "waiting"}
    got = state()
    assert [got[k].outcome for k in ("good", "late", "never", "waits")] == ["accepted", "recovered", "rejected", "waiting"]
    assert [got[k].attempts for k in ("good", "late", "never", "waits")] == [1, 2, 2, 1]
    assert got["late"].error == "mismatched_tag" and (got["late"].line, got["late"].column) == (2, 2)
    assert got["waits"].error == "undefined_entity" and got["never"].line == 1 and got["good"].error is None
    assert len(got) == 5
    titles = {r.pmc_id: r.article_title for r in read_papers(spark, log).collect()}
    assert titles == {"good": "first", "late": "repaired"}
    # without its checkpoint the stream takes all files again, as one batch: the same deliveries decide
    start_ingest_stream(spark, dumps, log, checkpoint + "-again").awaitTermination()
    again = state()
    assert {k: again[k].outcome for k in got} == {k: got[k].outcome for k in got}
    assert {r.pmc_id: r.article_title for r in read_papers(spark, log).collect()} == titles
