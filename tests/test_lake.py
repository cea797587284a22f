"""What ingest reads, raw versions, retention and rebuilds."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sessionlake.operators import maintain
from sessionlake.sources.lake import Lake
from sessionlake.sources.scan import lines
from sessionlake.streaming.ingest import one_pass, passes, rebuild

LATER = 4_000_000_000 * 10**9
DAY = 86_400 * 10**9


def talk(path, minutes, said="hello"):
    """A CLI transcript of one question and one answer a minute."""
    rows = []
    for m in range(minutes):
        rows.append({"type": "user", "uuid": f"q{m}", "timestamp": f"2031-05-04T10:{m:02d}:00Z", "cwd": "/w", "message": {"content": f"{said} {m}"}})
        rows.append({"type": "assistant", "uuid": f"r{m}", "timestamp": f"2031-05-04T10:{m:02d}:20Z", "message": {"model": "alpha-mid", "usage": {"input_tokens": 3, "output_tokens": m}, "content": [{"type": "text", "text": "yes"}]}})
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def actions(df):
    return {r.path.rsplit("/", 1)[1]: (r.action, r.outcome) for r in df.collect()}


def turns(lake):
    return {r.session_id: r.turn_count for r in lake.read("sessions").collect()}


def test_names_with_any_signs(spark, tmp_path):
    src, lake = tmp_path / "in", Lake(spark, str(tmp_path / "lake"), buckets=2)
    names = ["a b", "c[1]", "d+e", "f%20g", "{h,i}", "plain"]
    for k, n in enumerate(names, 1):
        talk(src / "sub dir" / f"{n}.jsonl", k)
    got = actions(one_pass(spark, lake, "claude-code", [str(src)], now_ns=LATER))
    assert got == {f"{n}.jsonl": ("ingest", "ingested") for n in names}
    assert turns(lake) == {n: k for k, n in enumerate(names, 1)}


def test_only_changed_files_are_read(spark, tmp_path):
    src, lake = tmp_path / "in", Lake(spark, str(tmp_path / "lake"), buckets=2)
    for k, n in enumerate(("kept", "touched", "grown"), 1):
        talk(src / f"{n}.jsonl", k)
    one_pass(spark, lake, "claude-code", [str(src)], now_ns=LATER)
    kept, stat = src / "kept.jsonl", (src / "kept.jsonl").stat()
    kept.write_text("x" * stat.st_size)  # nobody looks, as length and time are as before
    os.utime(kept, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    os.utime(src / "touched.jsonl", (1e9, 1e9))
    talk(src / "grown.jsonl", 5)
    talk(src / "new.jsonl", 1)
    got = actions(one_pass(spark, lake, "claude-code", [str(src)], now_ns=LATER + 1))
    assert got == {"kept.jsonl": ("unchanged", None), "touched.jsonl": ("unchanged", None), "grown.jsonl": ("ingest", "ingested"), "new.jsonl": ("ingest", "ingested")}
    assert turns(lake) == {"kept": 1, "touched": 2, "grown": 5, "new": 1}
    assert not [p for p in (tmp_path / "lake" / "work").iterdir() if p.is_dir()]
    (src / "new.jsonl").unlink()
    os.utime(src / "grown.jsonl", (LATER / 1e9, LATER / 1e9))
    got = actions(one_pass(spark, lake, "claude-code", [str(src)], now_ns=LATER + 2, dry_run=True))
    assert got == {"kept.jsonl": ("unchanged", None), "touched.jsonl": ("unchanged", None), "grown.jsonl": ("active", None), "new.jsonl": ("vanished", None)}


def test_line_limit_stays_with_its_read(spark, tmp_path):
    f = tmp_path / "s.jsonl"
    f.write_text("short\n" + "long" * 100 + "\nlast\n")
    assert [r.value for r in lines(spark, [str(f)], max_line=100).orderBy("line_no").collect()] == ["short", "last"]
    assert spark.read.text(str(f)).count() == 3


def test_versions_by_number_and_damage(spark, tmp_path):
    f, lake = tmp_path / "in" / "s.jsonl", Lake(spark, str(tmp_path / "lake"))
    texts = []
    for k in range(3):
        talk(f, k + 1, said=f"v{k}")
        texts.append(f.read_text().splitlines())
        lake.capture(lines(spark, [str(f)]), "claude-code", LATER + k * DAY)
    assert lake.capture(lines(spark, [str(f)]), "claude-code", LATER + 9 * DAY).count() == 0
    for index in (0, 1, 2, -1, -3):
        assert [r.value for r in lake.restore("claude-code", "s", index=index).collect()] == texts[index]
    first = maintain.session_versions(lake.read("raw_versions"), "s").first()
    assert [r.value for r in lake.restore("claude-code", "s", sha256=first.sha256).collect()] == texts[0]
    for index in (3, -4):
        with pytest.raises(LookupError):
            lake.restore("claude-code", "s", index=index)
    lost = next((tmp_path / "lake" / "raw_lines" / "source=claude-code").glob(f"day={first.day}"))
    lake.remove(str(lost))
    with pytest.raises(ValueError):
        lake.restore("claude-code", "s", index=0)
    talk(f, 1, said="v0")
    assert lake.capture(lines(spark, [str(f)]), "claude-code", LATER + 10 * DAY).count() == 1
    assert [r.value for r in lake.restore("claude-code", "s").collect()] == texts[0]


def test_retention_deletes(spark, tmp_path):
    src, lake = tmp_path / "in", Lake(spark, str(tmp_path / "lake"), buckets=2)
    talk(src / "old.jsonl", 1)
    talk(src / "also.jsonl", 2)
    one_pass(spark, lake, "claude-code", [str(src)], now_ns=LATER)
    talk(src / "old.jsonl", 3)
    one_pass(spark, lake, "claude-code", [str(src)], now_ns=LATER + 20 * DAY)
    now = LATER + 25 * DAY
    policies = maintain.policy(spark, {"raw": "10d", "analyzed": "forever"}, {"codex": {"raw": "1d"}})
    for dry in (True, False):
        (r,) = lake.retain(policies, now, dry_run=dry).collect()
        assert (r.tier, r.source, r.deleted) == ("raw", "claude-code", 2)
        assert lake.read("raw_versions").count() == (3 if dry else 1)
    assert len(lake.restore("claude-code", "old").collect()) == 6 and lake.read("raw_lines").count() == 6
    assert lake.retain(policies, now).count() == 0 and lake.read("sessions").count() == 2
    all_gone = maintain.policy(spark, {"raw": "1d", "analyzed": "1d"})
    (seen,) = passes(spark, lake, "claude-code", [str(src)], 0, 1, policies=all_gone, now_ns=now)
    assert {r["action"]: r["files"] for r in seen.collect()} == {"unchanged": 2}
    assert all(lake.read(t) is None for t in ("sessions", "turns", "contents", "raw_versions", "raw_lines"))
    assert lake.retain(all_gone, now).count() == 0


def test_rebuild(spark, tmp_path):
    src, lake = tmp_path / "in", Lake(spark, str(tmp_path / "lake"), buckets=2)
    for k, n in enumerate(("here", "archived", "lost", "emptied", "fresh"), 1):
        talk(src / f"{n}.jsonl", k)
    one_pass(spark, lake, "claude-code", [str(src)], now_ns=LATER)
    before = {t: sorted(str(r) for r in lake.read(t).drop("ingested_at_ns").collect()) for t in ("sessions", "turns", "contents")}
    wrong = lake.read("sessions").where("session_id != 'fresh'").drop("bucket").withColumn("pipeline_version", F.lit(1)).withColumn("turn_count", F.lit(99).cast("long"))
    wrong = lake.pinned(wrong.withColumn("bucket", lake.bucket()))
    lake.overwrite("sessions", wrong.unionByName(lake.read("sessions").where("session_id = 'fresh'")), None, "bucket")
    (src / "archived.jsonl").unlink()
    (src / "lost.jsonl").unlink()
    (src / "emptied.jsonl").write_text("[]\n")
    lake.delete_versions(lake.read("raw_versions").where("session_id = 'lost'"))
    plan = {r.origin: (r.outcome, r.sessions) for r in rebuild(spark, lake, "claude-code", [str(src)], dry_run=True).collect()}
    assert plan == {"from_original": (None, 2), "from_archive": (None, 1), "missing_raw": (None, 1)}
    done = {(r.outcome, r.origin): r.sessions for r in rebuild(spark, lake, "claude-code", [str(src)], now_ns=LATER + 1).collect()}
    assert done == {("rebuilt", "from_original"): 1, ("rebuilt", "from_archive"): 1, ("yielded_nothing", "from_original"): 1, ("missing_raw", "missing_raw"): 1}
    assert turns(lake) == {"here": 1, "archived": 2, "lost": 99, "emptied": 99, "fresh": 5}
    after = {t: sorted(str(r) for r in lake.read(t).drop("ingested_at_ns").collect()) for t in ("sessions", "turns", "contents")}
    assert (after["turns"], after["contents"]) == (before["turns"], before["contents"])
    again = {(r.outcome, r.origin) for r in rebuild(spark, lake, "claude-code", [str(src)], now_ns=LATER + 2).collect()}
    assert again == {("yielded_nothing", "from_original"), ("missing_raw", "missing_raw")}
    assert rebuild(spark, Lake(spark, str(tmp_path / "none")), "codex", [str(src)]).count() == 0


def test_state_survives_a_run_lost_while_replacing_it(spark, tmp_path):
    src, lake = tmp_path / "in", Lake(spark, str(tmp_path / "lake"), buckets=2)
    talk(src / "a.jsonl", 2)
    one_pass(spark, lake, "claude-code", [str(src)], now_ns=LATER)
    for p in (tmp_path / "lake" / "ingest_state").iterdir():
        p.unlink()  # the old state is deleted, the new one not yet written
    got = actions(one_pass(spark, lake, "claude-code", [str(src)], now_ns=LATER + 1))
    assert got == {"a.jsonl": ("unchanged", None)}
