"""Growing files through real triggers, against batch polls of the same files."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from evledger.operators import verify as V
from evledger.operators.chain import write_ledger
from evledger.sources import growing as G
from evledger.streaming import incremental as I
from evledger.streaming import live
from tests.test_incremental import header, said, write


@pytest.fixture
def place(tmp_path):
    names = {n: str(tmp_path / n) for n in ("root", "state", "polled", "streamed", "checkpoint")}
    os.makedirs(names["root"])
    return names


def both(spark, place, **options):
    """One poll and one pass of the stream over the same files; their new events."""
    spec = I.codex(place["root"])
    I.capture_once(spark, [spec], place["state"], place["polled"], **options)
    I.capture_stream(spark, [spec], place["streamed"], place["checkpoint"], once=True, **options).awaitTermination()


def events(spark, ledger):
    if not os.path.isdir(f"{ledger}/events"):
        return []
    rows = live.read_ledger(spark, ledger).orderBy("seq").collect()
    return [(r.seq, r.event_id, r.raw_text, r.project, json.loads(r.payload)["session_id"], r.event_type) for r in rows]


STEPS = [
    lambda f: write(f, header(1) + said("before the first start")),
    lambda f: write(f, said("one") + said("half a line")[:20], "a"),
    lambda f: write(f, said("half a line")[20:] + header(2) + said("two", "agent"), "a"),
    lambda f: None,
    lambda f: write(f, said("after the cut")),
    lambda f: write(f, said("left\rright")[:-1].replace("\\r", "\r") + "\n\n" + said("last"), "a"),
]


@pytest.mark.parametrize("backfill", [False, True])
def test_stream_equals_polls(spark, place, backfill):
    """Growth, half lines, a cut, files that come later; each pass is a restart from the checkpoint."""
    for k, step in enumerate(STEPS):
        step(f"{place['root']}/a.jsonl")
        if k == 2:
            write(f"{place['root']}/2024/late.jsonl", header(7) + said("late") + said("late", "agent"))
        both(spark, place, backfill=backfill)
        polled, streamed = events(spark, place["polled"]), events(spark, place["streamed"])
        assert [e[2:] for e in streamed] == [e[2:] for e in polled]
        assert {e[1] for e in streamed} == {e[1] for e in polled}
    assert len(streamed) == (8 if backfill else 7)
    text = f"{place['streamed']}-text"
    write_ledger(live.read_ledger(spark, place["streamed"]), text)
    summary, errors = V.verify_ledger(spark, text)
    assert errors.count() == 0 and summary.first().valid


def test_lost_commit_repeats_the_batch(spark, place):
    """A batch whose commit is lost is read again and leaves the same ledger."""
    file = f"{place['root']}/a.jsonl"
    write(file, header(1) + said("one"))
    spec = I.codex(place["root"])
    run = lambda: I.capture_stream(spark, [spec], place["streamed"], place["checkpoint"], once=True, backfill=True).awaitTermination()
    run()
    write(file, said("two"), "a")
    run()
    first = events(spark, place["streamed"])
    commits = sorted(n for n in os.listdir(f"{place['checkpoint']}/commits") if n.isdigit())
    for name in (commits[-1], f".{commits[-1]}.crc"):
        os.remove(f"{place['checkpoint']}/commits/{name}")
    run()
    assert events(spark, place["streamed"]) == first and [e[2] for e in first] == ["one", "two"]
    write(file, said("three"), "a")
    run()
    assert [e[2] for e in events(spark, place["streamed"])] == ["one", "two", "three"]


def test_budget_and_ranges(spark, tmp_path, monkeypatch):
    """Budgets cut inside lines; parts of a file are read side by side; nothing is lost or doubled."""
    lines = [f"line {k} " + "x" * (k * 37 % 400) for k in range(500)]
    write(str(tmp_path / "root/a.jsonl"), "\n".join(lines) + "\n" + "unfinished")
    monkeypatch.setattr(G, "RANGE_BYTES", 1000)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    size = os.path.getsize(tmp_path / "root/a.jsonl")
    for _ in range(4):
        stream = G.line_stream(spark, str(tmp_path / "root"), f"{checkpoint}/places", backfill=True, max_bytes=size // 3 + 1)
        writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start(out).awaitTermination()
    rows = spark.read.parquet(out).orderBy("byte_offset").collect()
    assert [r.text for r in rows] == lines
    assert [r.byte_offset for r in rows] == [sum(len(x) + 1 for x in lines[:k]) for k in range(500)]


def test_ranges_hold_each_line_once(tmp_path):
    path = tmp_path / "f"
    path.write_bytes(b"\n\nab\n" + b"x" * 200_000 + b"\nlast\nopen")
    fs, name = G.file_system(str(path))
    size = path.stat().st_size
    for step in (1000, 65_536, 99_999, size):
        with fs.open_input_file(name) as file:
            found = [x for at in range(0, size, step) for x in G.range_lines(file, at, min(size, at + step))]
        assert found == [(0, b""), (1, b""), (2, b"ab"), (5, b"x" * 200_000), (200_006, b"last")]


def test_places_are_few_and_vanished_files_stay_known(spark, place):
    file = f"{place['root']}/a.jsonl"
    write(file, header(1))
    spec = I.codex(place["root"])
    run = lambda: I.capture_stream(spark, [spec], place["streamed"], place["checkpoint"], once=True).awaitTermination()
    run()
    for k in range(5):
        write(file, said(f"m{k}"), "a")
        run()
    assert len(os.listdir(f"{place['checkpoint']}/places-codex")) <= 3
    shutil.move(file, f"{place['root']}/hidden")
    run()
    shutil.move(f"{place['root']}/hidden", file)
    run()
    assert [e[2] for e in events(spark, place["streamed"])] == [f"m{k}" for k in range(5)]
    assert live.read_ledger(spark, place["streamed"]).where(F.col("project") != "garden1").count() == 0
