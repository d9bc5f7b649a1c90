import json
import random

import pytest
from pyspark.sql import functions as F

from evledger.operators import read as R
from evledger.sources import lines as L
from tests.reference_fold import chain, damage, dump, lines_of, read


def write_all(tmp_path, ledgers):
    for name, data in ledgers.items():
        folder = tmp_path / f"ledger_id={name}"
        folder.mkdir(parents=True)
        (folder / "part-0.txt").write_bytes(data)
    return str(tmp_path)


def outcome(events, envelopes):
    picked = {}
    for r in events.orderBy("ledger_id", "byte_offset").collect():
        picked.setdefault(r.ledger_id, []).append(r.event_id)
    return {
        r.ledger_id: (
            picked.get(r.ledger_id, []),
            r.byte_offset,
            r.last_event_id,
            r.last_content_hash,
            r.chain_status,
            r.cursor_status,
            r.truncated,
        )
        for r in envelopes.collect()
    }


@pytest.mark.parametrize("seed", range(4))
def test_random_ledgers_equal_the_sequential_rules(spark, small_splits, tmp_path, seed):
    rng = random.Random(seed)
    sources = rng.choice([None, ["a"], ["b", "c"]])
    limit = rng.choice([None, 1, 5, 0])
    max_bytes = rng.choice([1 << 30, 3000, 900, 10])
    ledgers, cursors, want = {}, [], {}
    for i in range(40):
        data = b"".join(dump(e) for e in chain(rng.randint(1, 25)))
        for _ in range(rng.randint(0, 2)):
            data = damage(rng, data)
        if not data.strip():
            continue
        name = f"l{i:02d}"
        ledgers[name] = data
        offset = event_id = digest = None
        spot = rng.choice(["zero", "zero", "good", "wrong", "unnamed", "far"])
        rows = [(at + len(raw), raw) for _, at, raw in lines_of(data) if raw.startswith(b'{"art')]
        if spot == "zero" or not rows:
            offset = 0
        else:
            import json

            offset, raw = rng.choice(rows)
            e = json.loads(raw)
            event_id, digest = e["event_id"], e["content_hash"]
            if spot == "wrong":
                digest = "0" * 64
            elif spot == "unnamed":
                event_id = None
            elif spot == "far":
                offset += 1 << 20
        offset = min(offset, len(data)) if spot != "far" else offset
        cursors.append((name, R.Cursor(name, offset, event_id, digest)))
        want[name] = read(data, offset, event_id, digest, sources, limit, max_bytes)
    lines = L.ledger_lines(spark, write_all(tmp_path, ledgers))
    events, envelopes, _ = R.read_batches(
        lines, R.cursor_table(spark, cursors), sources=sources, limit=limit, max_bytes=max_bytes, width=1500
    )
    assert outcome(events, envelopes) == want


def test_resume_until_the_end(spark, tmp_path):
    data = b"".join(dump(e) for e in chain(50))
    lines = L.ledger_lines(spark, write_all(tmp_path, {"one": data}))
    cursor, seen = None, []
    for _ in range(20):
        batch = R.read_incremental(lines, "one", after_cursor=cursor, sources=["a"], limit=4, projection="metadata")
        assert batch.usable
        seen += [r.event_id for r in batch.events.orderBy("byte_offset").collect()]
        cursor = json.loads(batch.next_cursor.document())
        if not batch.truncated:
            break
    assert seen == [f"evt_{i:04d}" for i in range(0, 50, 3)]
    assert "raw_text" not in batch.events.columns


def test_foreign_cursor_and_arguments(spark, tmp_path):
    lines = L.ledger_lines(spark, write_all(tmp_path, {"one": dump(chain(1)[0])}))
    batch = R.read_incremental(lines, "one", after_cursor=R.Cursor("two", 5))
    assert (batch.cursor_status, batch.chain_status, batch.next_cursor.byte_offset) == ("ledger_changed", "not_checked", 0)
    for bad in ({"limit": -1}, {"max_bytes": 0}, {"projection": "body"}):
        with pytest.raises(ValueError):
            R.read_incremental(lines, "one", **bad)
    with pytest.raises(ValueError):
        R.Cursor.parse('{"ledger_id": " "}')
    with pytest.raises(ValueError):
        R.Cursor.parse('{"ledger_id": "x", "schema": "other.v9"}')


def test_cursor_is_saved_only_after_a_sound_batch(spark, tmp_path):
    good = b"".join(dump(e) for e in chain(3))
    lines = L.ledger_lines(spark, write_all(tmp_path / "data", {"ok": good, "bad": good + b"{x\n"}))
    path = str(tmp_path / "cursor")
    assert R.load_cursor(spark, path) is None
    assert not R.save_cursor(R.read_incremental(lines, "bad"), path)
    assert R.load_cursor(spark, path) is None
    assert R.save_cursor(R.read_incremental(lines, "ok"), path)
    assert R.load_cursor(spark, path).byte_offset == len(good)


def test_filter_values(spark):
    df = spark.createDataFrame([("a", None), (None, "p"), ("b", "q")], "source string, project string").withColumn(
        "event_type", F.lit("t")
    )
    assert R.filter_events(df, sources=[""]).count() == 1
    assert R.filter_events(df, sources=[]).count() == 0
    assert R.filter_events(df, projects=["p", "q"], sources=["b", ""]).count() == 2


def test_export_keeps_log_order(spark, tmp_path):
    data = b"".join(dump(e) for e in chain(40))
    lines = L.ledger_lines(spark, write_all(tmp_path / "data", {"one": data}))
    events = lines.select("byte_offset", F.col("value").cast("string").alias("event"))
    out = tmp_path / "out"
    R.export_jsonl(events, str(out))
    text = b"".join(p.read_bytes() for p in sorted(out.glob("part-*")))
    assert text == data
