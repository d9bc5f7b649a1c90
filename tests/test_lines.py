import random

import pytest
from pyspark.sql import functions as F

from evledger.sources import lines as L
from tests.reference_fold import chain, dump, lines_of


def mixed(rng, n=200):
    out = b""
    for i in range(n):
        pick = rng.random()
        if pick < 0.4:
            out += b'{"a": %d}' % i
        elif pick < 0.5:
            out += b""
        elif pick < 0.7:
            out += b"x\xff\xfe" + b"y" * rng.randint(0, 300)
        elif pick < 0.8:
            out += b"  \r"
        else:
            out += '{"é":"ü"}'.encode()
        out += b"\n"
    return out


@pytest.mark.parametrize("head,tail", [(b"", b""), (b"", b"tail"), (b"\xef\xbb\xbf", b""), (b"\xef\xbb\xbf", b"q")])
def test_positions_across_splits(spark, small_splits, tmp_path, head, tail):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    data = head + mixed(random.Random(1)) + tail
    path = tmp_path / "one.jsonl"
    path.write_bytes(data)
    rows = L.ledger_lines(spark, str(path)).orderBy("line").collect()
    assert L.read_text_splits(spark, str(path)).rdd.getNumPartitions() > 3
    got = [(r.line, r.byte_offset, r.byte_len, bytes(r.value), r.terminated) for r in rows]
    want = [
        (n, at, len(raw), raw.removesuffix(b"\n"), raw.endswith(b"\n")) for n, at, raw in lines_of(data)
    ]
    assert got == want
    assert rows[0].ledger_id == "one"


def test_one_log_in_several_files(spark, small_splits, tmp_path):
    folder = tmp_path / "ledger_id=big"
    folder.mkdir()
    parts = [b"".join(dump(e) for e in chain(9)[i : i + 3]) for i in (0, 3, 6)]
    for i, part in enumerate(parts):
        (folder / f"part-{i:05d}.txt").write_bytes(part)
    rows = L.ledger_lines(spark, str(tmp_path)).orderBy("line").collect()
    want = [(n, at) for n, at, _ in lines_of(b"".join(parts))]
    assert [(r.line, r.byte_offset) for r in rows] == want
    assert {r.ledger_id for r in rows} == {"big"}


def test_strict_read_raises_on_first_bad_line(spark, tmp_path):
    path = tmp_path / "l.jsonl"
    path.write_bytes(dump(chain(1)[0]) + b"\n{bad\n")
    events = L.read_events(L.ledger_lines(spark, str(path)))
    with pytest.raises(Exception, match="Invalid JSON in l line 3"):
        events.collect()


def test_boundary_and_recent(spark, tmp_path):
    data = b"\n" + b"".join(dump(e) for e in chain(6)) + b"\n"
    path = tmp_path / "l.jsonl"
    path.write_bytes(data)
    lines = L.ledger_lines(spark, str(path))
    assert L.first_event(lines).first().line == 2
    assert L.last_event(lines).first().line == 7
    third = [at for n, at, _ in lines_of(data) if n == 4][0]
    assert L.last_event(lines, third + 1).first().line == 3
    assert {r.line for r in L.recent_events(lines, 2).collect()} == {6, 7}
    assert L.recent_events(lines, 0).count() == 0
    assert lines.where(F.col("line") == 1).first().byte_len == 1
