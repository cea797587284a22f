"""Ingest as a stream of file changes, and passes over files that go wrong."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_lake import LATER, actions, talk, turns

from sessionlake.sources.lake import TABLES, Lake
from sessionlake.sources.scan import lines, numbered
from sessionlake.streaming import ingest
from sessionlake.streaming.changes import Log, differences, look
from sessionlake.streaming.ingest import one_pass, stream


def content(lake):
    """All rows of the session tables and the state, but for the times of the passes."""
    out = {t: sorted(str(r) for r in lake.read(t).drop("ingested_at_ns").collect()) for t in TABLES if lake.exists(t) and lake.read(t)}
    return out | {"state": sorted(str(r) for r in lake.state().drop("seen_ns").collect())}


def test_the_stream_leaves_what_passes_leave(spark, tmp_path):
    src, batch, live = tmp_path / "in", Lake(spark, str(tmp_path / "batch"), buckets=2), Lake(spark, str(tmp_path / "live"), buckets=2)
    reports = []

    def both(**options):
        """A pass over each lake; what the stream reported."""
        one_pass(spark, batch, "claude-code", [str(src)], now_ns=LATER)
        reports.clear()
        q = stream(spark, live, "claude-code", [str(src)], str(tmp_path / "checkpoint"), quiet_s=0, on_pass=lambda r: reports.append(actions(r)), fold_after=1, **options)
        q.awaitTermination()
        assert q.exception() is None
        assert content(live) == content(batch)
        assert len(reports) <= 1
        return reports[0] if reports else {}

    for k, n in enumerate(("still", "grown", "rewritten", "gone"), 1):
        talk(src / "sub" / f"{n}.jsonl", k)
    assert both() == {f"{n}.jsonl": ("ingest", "ingested") for n in ("still", "grown", "rewritten", "gone")}
    assert both() == {}  # the checkpoint knows all of it
    talk(src / "sub" / "grown.jsonl", 6)
    talk(src / "sub" / "rewritten.jsonl", 2, said="quite another text")
    (src / "sub" / "gone.jsonl").unlink()
    talk(src / "sub" / "late [1].jsonl", 1)
    (src / "sub" / "empty.jsonl").write_text("[]\n")
    assert both() == {"empty.jsonl": ("ingest", "empty"), "grown.jsonl": ("ingest", "ingested"), "rewritten.jsonl": ("ingest", "ingested"), "gone.jsonl": ("vanished", None), "late [1].jsonl": ("ingest", "ingested")}
    assert turns(live) == {"still": 1, "grown": 6, "rewritten": 2, "gone": 4, "late [1]": 1}
    assert len(Log(str(tmp_path / "checkpoint" / "inventory")).numbers("files")) == 1
    # a new query over a folded log takes every file once; where a file is back, it is new
    talk(src / "sub" / "gone.jsonl", 4)
    again = Lake(spark, str(tmp_path / "again"), buckets=2)
    os.rename(tmp_path / "checkpoint" / "inventory", tmp_path / "kept")
    (tmp_path / "second").mkdir()
    os.rename(tmp_path / "kept", tmp_path / "second" / "inventory")
    stream(spark, again, "claude-code", [str(src)], str(tmp_path / "second"), quiet_s=0).awaitTermination()
    assert turns(again) == turns(live)


def test_log_and_listing(tmp_path):
    log = Log(str(tmp_path / "log"))
    passes = [[("a", "new", 1, 1), ("b", "new", 1, 1)], [("a", "changed", 2, 2)], [("b", "vanished", None, None), ("c", "new", 3, 3)]]
    for n, rows in enumerate(passes, 1):
        log.write("changes", n, rows)
    assert log.since(0, 3) == [("a", "changed", 2, 2), ("b", "vanished", None, None), ("c", "new", 3, 3)]
    assert log.since(1, 2) == passes[1] and log.since(3, 3) == []
    assert log.files(2) == {"a": (2, 2), "b": (1, 1)} and log.files(3) == {"a": (2, 2), "c": (3, 3)}
    log.fold(2, log.files(2))
    assert log.numbers("changes") == [3] and log.last() == 3
    assert log.files(3) == {"a": (2, 2), "c": (3, 3)}
    assert log.since(0, 3) == [("a", "new", 2, 2), ("b", "vanished", None, None), ("c", "new", 3, 3)] and log.since(2, 3) == passes[2]
    f = tmp_path / "in" / "x.jsonl"
    f.parent.mkdir()
    f.write_text("{}\n")
    for other in (".hidden.jsonl", "_made.jsonl", "note.txt"):
        (tmp_path / "in" / other).write_text("{}\n")
    (tmp_path / "in" / "empty.jsonl").touch()
    now = f.stat().st_mtime_ns
    assert look([str(tmp_path / "in")], now) == ({f"file:{f}": (3, now)}, set())
    assert look([f"file://{tmp_path}/in"], now - 1) == ({}, {f"file:{f}"})
    assert differences({"p": (1, 1), "q": (1, 1)}, {}, {"q"}) == [("p", "vanished", None, None)]


def test_one_bad_file_fails_alone_and_is_tried_again(spark, tmp_path, monkeypatch):
    src, lake = tmp_path / "in", Lake(spark, str(tmp_path / "lake"), buckets=2)
    for k, n in enumerate(("good", "broken", "leaves", "fine"), 1):
        talk(src / f"{n}.jsonl", k)
    crc = src / ".broken.jsonl.crc"
    crc.write_bytes(b"crc\0\0\0\2\0" + bytes(40))  # reading this file fails, listing it does not

    def leave(*args):
        (src / "leaves.jsonl").rename(tmp_path / "leaves")
        return lines(*args)

    monkeypatch.setattr(ingest, "lines", leave)
    got = actions(one_pass(spark, lake, "claude-code", [str(src)], now_ns=LATER))
    assert got == {"good.jsonl": ("ingest", "ingested"), "broken.jsonl": ("ingest", "failed"), "leaves.jsonl": ("ingest", "failed"), "fine.jsonl": ("ingest", "ingested")}
    assert turns(lake) == {"good": 1, "fine": 4}
    monkeypatch.setattr(ingest, "lines", lines)
    got = actions(one_pass(spark, lake, "claude-code", [str(src)], now_ns=LATER + 1))
    assert got == {"good.jsonl": ("unchanged", None), "broken.jsonl": ("ingest", "failed"), "leaves.jsonl": ("vanished", None), "fine.jsonl": ("unchanged", None)}
    crc.unlink()
    (tmp_path / "leaves").rename(src / "leaves.jsonl")
    done = one_pass(spark, lake, "claude-code", [str(src)], now_ns=LATER + 2)
    assert {r.path.rsplit("/", 1)[1]: (r.outcome, r.attempts) for r in done.where("outcome is not null").collect()} == {"broken.jsonl": ("ingested", 1), "leaves.jsonl": ("ingested", 2)}
    assert turns(lake) == {"good": 1, "broken": 2, "leaves": 3, "fine": 4}


def test_the_report_counts_what_a_scan_drops(spark, tmp_path, monkeypatch):
    src, lake = tmp_path / "in", Lake(spark, str(tmp_path / "lake"), buckets=2)
    talk(src / "a.jsonl", 2)
    with (src / "a.jsonl").open("a") as f:
        f.write('\n   \nnot json\n{"cut": \n[1, 2]\n"text"\n3\n')
    talk(src / "b.jsonl", 1)
    with (src / "b.jsonl").open("ab") as f:
        f.write(b'{"wide": "\xff"}\r\nlast without an end')
    done = {r.path.rsplit("/", 1)[1]: r for r in one_pass(spark, lake, "claude-code", [str(src)], now_ns=LATER).collect()}
    a, b = done["a.jsonl"], done["b.jsonl"]
    assert (a.lines, a.blank, a.malformed, a.not_object, a.long_bytes) == (11, 2, 2, 3, 0)
    assert (b.lines, b.malformed, b.outcome) == (4, 1, "ingested")
    assert a.bytes == (src / "a.jsonl").stat().st_size
    # over-long lines
    monkeypatch.setattr(ingest, "MAX_LINE", 2000)
    monkeypatch.setattr(ingest, "lines", lambda s, p: lines(s, p, max_line=2000))
    monkeypatch.setattr(ingest, "completeness", lambda: ingest_completeness(2000))
    from sessionlake.sources.scan import completeness as ingest_completeness

    talk(src / "c.jsonl", 1)
    with (src / "c.jsonl").open("a") as f:
        f.write('{"long": "' + "x" * 5000 + '"}\n')
    done = {r.path.rsplit("/", 1)[1]: r for r in one_pass(spark, lake, "claude-code", [str(src)], now_ns=LATER + 1).collect()}
    assert (done["c.jsonl"].lines, done["c.jsonl"].long_bytes, done["c.jsonl"].outcome) == (2, 5013, "ingested")


@pytest.mark.parametrize("block", [64, 1000, 1 << 20])
def test_line_numbers_by_block(spark, tmp_path, block):
    src = tmp_path / "in"
    src.mkdir()
    want = {}
    for name, n in (("long", 700), ("short", 3), ("one", 1)):
        text = [f"{name} {i} " + "x" * (i * 7 % 90) for i in range(n)]
        (src / f"{name}.jsonl").write_text("\n".join(text) + "\n")
        want[name] = text
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        got = lines(spark, [str(src)])
        for name, text in want.items():
            assert [r.value for r in got.where(F.col("session_id") == name).orderBy("line_no").collect()] == text
            assert [r.line_no for r in got.where(F.col("session_id") == name).orderBy("line_no").collect()] == list(range(len(text)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_task_numbers_more_than_a_block(spark):
    raw = spark.range(0, 40_000, 1, 40).select(F.concat(F.lit("f"), (F.col("id") % 1).cast("string")).alias("file"), (F.col("id").cast("int") / 1000).cast("int").alias("at"), "id", F.col("id").cast("string").alias("value"))
    got = numbered(raw)
    assert got.where("line_no <> cast(value as long)").count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "row_number" in x]
    assert windows and all("file" in w and "at#" in w for w in windows)


def test_paths_are_written_as_spark_writes_them(spark, tmp_path):
    talk(tmp_path / "in" / "a.jsonl", 1)
    known, _ = look([str(tmp_path / "in")], 1 << 62)
    assert [*known] == [r.path for r in ingest.inventory(spark, [str(tmp_path / "in")]).collect()]
    assert Path([*known][0].removeprefix("file:")).exists()
