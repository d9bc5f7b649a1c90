"""Growing files, repeated events and interrupted polls, all into one valid ledger."""

import json
import os

import pytest
from pyspark.sql import functions as F

from evledger import positions
from evledger.functions import text as X
from evledger.operators import verify as V
from evledger.operators.chain import chain_build, write_ledger
from evledger.operators.policy import CapturePolicy
from evledger.operators.read import zero_cursors
from evledger.sources import capture as C
from evledger.sources import files as T
from evledger.sources import tail as L
from evledger.sources.lines import ledger_lines
from evledger.streaming import incremental as I
from evledger.streaming import live
from tests.test_chain import events


def header(n):
    return json.dumps({"type": "session_meta", "payload": {"cwd": f"/w/garden{n}", "id": f"session{n}"}}) + "\n"


def said(text, who="user"):
    return json.dumps({"type": "event_msg", "payload": {"type": f"{who}_message", "message": text}}) + "\n"


def write(path, text, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode, newline="") as f:
        f.write(text)


@pytest.fixture
def place(tmp_path):
    names = {n: str(tmp_path / n) for n in ("root", "state", "ledger")}
    os.makedirs(names["root"])
    return names


def poll(spark, place, **options):
    rows = I.capture_once(spark, [I.codex(place["root"])], place["state"], place["ledger"], **options).orderBy("seq").collect()
    return [(r.raw_text, r.project, json.loads(r.payload)["session_id"]) for r in rows]


def check_valid(spark, place, tmp_path, n):
    kept = live.read_ledger(spark, place["ledger"])
    assert kept.count() == kept.select("event_id").distinct().count() == n
    write_ledger(kept, str(tmp_path / "text"))
    summary, errors = V.verify_ledger(spark, str(tmp_path / "text"))
    assert errors.count() == 0 and [r.valid for r in summary.collect()] == [True]


def test_header_carries_and_cut_files_restart(spark, place, tmp_path):
    file = f"{place['root']}/2024/a.jsonl"
    write(file, header(1) + said("before the baseline"))
    assert poll(spark, place) == []
    write(file, said("one") + said("one", "agent"), "a")
    assert poll(spark, place) == [("one", "garden1", "session1")] * 2
    write(file, header(2) + said("two"), "a")
    assert poll(spark, place) == [("two", "garden2", "session2")]
    write(file, said("three") + said("unfinished")[:-1], "a")
    assert poll(spark, place) == [("three", "garden2", "session2")]
    write(file, said("one"))  # cut: the same line at an old offset
    assert poll(spark, place) == [("one", "garden2", "session2")]
    write(file, said("left\rright")[:-1].replace("\\r", "\r") + "\n" + header(3) + said("four"), "a")
    assert poll(spark, place)[-1] == ("four", "garden3", "session3")
    check_valid(spark, place, tmp_path, 6)


def test_crash_between_append_and_state(spark, place, tmp_path, monkeypatch):
    file = f"{place['root']}/a.jsonl"
    write(file, header(1) + said("one"))
    with monkeypatch.context() as m:
        m.setattr(L, "save_source_state", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            poll(spark, place, backfill=True)
    first = live.read_ledger(spark, place["ledger"]).collect()
    write(file, said("two"), "a")
    assert [r[0] for r in poll(spark, place, backfill=True)] == ["one", "two"]
    rows = live.read_ledger(spark, place["ledger"]).orderBy("seq").collect()
    assert [r.event_id for r in rows][:1] == [r.event_id for r in first]
    check_valid(spark, place, tmp_path, 2)


def test_layouts_callback_and_policy(spark, place):
    line = json.dumps({"role": "user", "type": "user", "message": {"content": "hello"}, "cwd": "/w/p"}) + "\n"
    for path in ("p/agent-transcripts/x/y.jsonl", "p/agent-transcripts/z.jsonl", "p/other.jsonl", "top.jsonl", "p/q/deep.jsonl"):
        write(f"{place['root']}/{path}", line)
    specs = [I.cursor(place["root"]), I.claude_code(place["root"])]
    drop = lambda e: e.where(F.col("source") == "cursor").withColumn("project", F.lit("changed"))
    rows = I.capture_once(spark, specs, place["state"], place["ledger"], backfill=True, change=drop, policy=CapturePolicy()).collect()
    files = sorted(json.loads(r.payload)["transcript"].removeprefix(place["root"]) for r in rows)
    assert files == ["/p/agent-transcripts/x/y.jsonl", "/p/agent-transcripts/z.jsonl"]
    assert {r.project for r in rows} == {"changed"}
    state, version = L.load_source_state(spark, place["state"])
    tracked = {(r.tailer, r.path.removeprefix(place["root"])) for r in state.collect()}
    assert version == 1 and ("claude-code", "/p/other.jsonl") in tracked and len(tracked) == 3


def test_only_grown_files_are_opened(spark, place, monkeypatch):
    for k in range(4):
        write(f"{place['root']}/f[{k}].jsonl", said("x"))
    state = L.load_source_state(spark, place["state"])[0]
    _, state = L.poll(spark, place["root"], state, "t")
    write(f"{place['root']}/f[2].jsonl", said("y"), "a")
    seen = []
    real = L.source_lines
    monkeypatch.setattr(L, "source_lines", lambda s, p, g=None: seen.append(p) or real(s, p, g))
    lines, _ = L.poll(spark, place["root"], state, "t")
    assert [json.loads(r.text)["payload"]["message"] for r in lines.collect()] == ["y"]
    assert len(seen) == 1 and len(seen[0]) == 1 and "2" in seen[0][0]


def test_repeated_edits_and_captures_have_own_ids(spark, place):
    watched, state = place["root"], place["state"]
    options = {"ts": "2024-01-01T00:00:00Z"}
    ids = [r.event_id for r in T.watch_once(spark, watched, state, **options).collect()]
    assert len(ids) == 1  # an empty root has its baseline too
    write(f"{watched}/a.txt", "1")
    ids += [r.event_id for r in T.watch_once(spark, watched, state, **options).collect()]
    for text in ("22", "333", "4444"):
        write(f"{watched}/a.txt", text)
        found = T.watch_once(spark, watched, state, **options).collect()
        assert len(found) == 1
        ids.append(found[0].event_id)
    assert T.watch_once(spark, watched, state, **options).count() == 0
    assert len(set(ids)) == len(ids) == 5
    page = ("u", "t", "h", "", "body")
    pages = spark.createDataFrame([(*page, 1), (*page, 2)], "url string, title string, host string, selection string, page_text string, capture long")
    assert C.web_clips(pages).select("event_id").distinct().count() == 2
    assert C.web_clips(pages.drop("capture")).select("event_id").distinct().count() == 1
    assert len(X.position_parts(["path", "text", "byte_offset", "part"])) == 3


def test_positions_survive_an_unfinished_write(spark, tmp_path):
    path = str(tmp_path / "p")
    assert positions.load(spark, path) == (None, 0)
    for k in range(5):
        positions.save(spark.createDataFrame([(k,)], "n long"), path)
    assert positions.versions(spark, path) == [3, 4, 5]
    os.makedirs(f"{path}/version={6:012d}")  # a crash left no success mark
    rows, version = positions.load(spark, path)
    assert version == 5 and rows.first().n == 4
    assert positions.save(rows.withColumn("n", F.col("n") + 1), path).first().n == 5
    assert positions.load(spark, path)[1] == 6


def test_cursor_stream_reports_every_ledger_when_stopped(spark, tmp_path):
    write_ledger(chain_build(events(spark, 60)), str(tmp_path / "text"))
    lines = ledger_lines(spark, str(tmp_path / "text"))
    names = {r.ledger_id for r in zero_cursors(lines).collect()}
    report = live.cursor_stream(lines, str(tmp_path / "c"), lambda e, n: None, max_rounds=1, max_bytes=2000)
    rows = report.collect()
    assert sorted(r.ledger_id for r in rows) == sorted(names)
    assert {r.ledger_id for r in rows if r.truncated} and positions.versions(spark, str(tmp_path / "c")) == [1]
