import json

import pytest
from pyspark.sql import functions as F

from evledger.operators import verify as V
from evledger.sources import lines as L
from tests.reference_fold import chain, digest, dump, lines_of


def write(tmp_path, data):
    path = tmp_path / "ledger.jsonl"
    path.write_bytes(data)
    return str(path)


def codes(errors):
    return [(r.line, r.code) for r in errors.orderBy("line", "rank").collect()]


def test_clean_ledger(spark, small_splits, tmp_path):
    events = chain(60)
    summary, errors = V.verify_ledger(spark, write(tmp_path, b"".join(map(dump, events))))
    row = summary.first()
    assert row.valid and row.event_count == 60 and row.error_count == 0
    assert row.first_content_hash == events[0]["content_hash"]
    assert row.last_content_hash == events[-1]["content_hash"]
    assert row.last_event_id == "evt_0059"
    assert errors.count() == 0


def mutate(events, kind):
    rows = [dump(e) for e in events]
    if kind == "append_junk":
        rows.append(b"{invalid\n")
        return rows, [(31, "invalid_json")]
    if kind == "schema":
        e = dict(events[-1], schema="other")
        e["content_hash"] = digest(e)
        rows[-1] = dump(e)
        return rows, [(30, "schema_mismatch")]
    if kind == "body":
        rows[4] = rows[4].replace(b"text", b"tent")
        return rows, [(5, "content_hash_mismatch")]
    if kind == "copy_id":
        e = dict(events[-1], event_id="evt_0000")
        e["content_hash"] = digest(e)
        rows[-1] = dump(e)
        return rows, [(30, "duplicate_event_id")]
    if kind == "no_id":
        e = dict(events[-1], event_id=" ")
        e["content_hash"] = digest(e)
        rows[-1] = dump(e)
        return rows, [(30, "missing_event_id")]
    if kind == "previous":
        e = dict(events[-1], previous_hash="f" * 64)
        e["content_hash"] = digest(e)
        rows[-1] = dump(e)
        return rows, [(30, "previous_hash_mismatch")]
    if kind == "drop":
        del rows[9]
        return rows, [(10, "previous_hash_mismatch")]
    if kind == "swap":
        rows[3], rows[4] = rows[4], rows[3]
        return rows, [(4, "previous_hash_mismatch"), (5, "previous_hash_mismatch"), (6, "previous_hash_mismatch")]
    if kind == "junk_inside":
        rows.insert(10, b"\xff\xfe\n")
        rows.insert(10, b"[1]\n")
        rows.insert(10, b" \r\n")
        return rows, [(12, "invalid_json"), (13, "invalid_json")]
    if kind == "no_newline":
        rows[-1] = rows[-1][:-1]
        return rows, []
    if kind == "several":
        e = dict(events[5], schema="x", event_id="evt_0001", previous_hash=5)
        rows[5] = dump(e)
        return rows, [
            (6, "schema_mismatch"),
            (6, "duplicate_event_id"),
            (6, "previous_hash_mismatch"),
            (6, "content_hash_mismatch"),
        ]
    raise AssertionError(kind)


KINDS = ["append_junk", "schema", "body", "copy_id", "no_id", "previous", "drop", "swap", "junk_inside", "no_newline", "several"]


@pytest.mark.parametrize("kind", KINDS)
def test_mutations(spark, small_splits, tmp_path, kind):
    rows, want = mutate(chain(30), kind)
    data = b"".join(rows)
    path = write(tmp_path, data)
    summary, errors = V.verify_ledger(spark, path)
    assert codes(errors) == want
    offsets = {n: at for n, at, _ in lines_of(data)}
    assert all(r.byte_offset == offsets[r.line] for r in errors.collect())
    assert summary.first().valid is (not want)
    # the table form agrees, whatever the segment width
    table = V.verify_errors(L.table_facts(L.ledger_lines(spark, path), width=900))
    assert codes(table) == want


def test_breakpoint_details(spark, small_splits, tmp_path):
    events = chain(20)
    rows = [dump(e) for i, e in enumerate(events) if i != 7]
    _, errors = V.verify_ledger(spark, write(tmp_path, b"".join(rows)))
    b = V.verify_breakpoints(errors).first()
    assert (b.line, b.event_id, b.previous_event_id) == (8, "evt_0008", "evt_0006")
    assert b.expected_previous_hash == events[6]["content_hash"]
    assert b.actual_previous_hash == events[7]["content_hash"]
    assert b.content_hash == events[8]["content_hash"]


def test_number_spelling_is_part_of_the_hash(spark, tmp_path):
    e = chain(1)[0]
    e["payload"] = {"v": 1}
    e["content_hash"] = digest(e)
    raw = dump(e).replace(b'{"v": 1}', b'{"v": 1.0}')
    _, errors = V.verify_ledger(spark, write(tmp_path, raw))
    assert codes(errors) == [(1, "content_hash_mismatch")]


def test_lone_surrogate_is_a_hash_error(spark, tmp_path):
    e = chain(1)[0]
    raw = dump(e).replace(b"text", b"\\ud800")
    _, errors = V.verify_ledger(spark, write(tmp_path, raw))
    assert codes(errors) == [(1, "content_hash_mismatch")]
    assert errors.first().calculated_content_hash is None


def test_changed_files(spark, tmp_path):
    path = write(tmp_path, dump(chain(1)[0]))
    before = spark.createDataFrame(V.file_versions(spark, path).collect())
    (tmp_path / "ledger.jsonl").write_bytes(b"".join(map(dump, chain(2))))
    changed = V.verify_changed(before, V.file_versions(spark, path)).collect()
    assert [r.code for r in changed] == ["ledger_changed_during_verification"]


def test_seal_gate_lists_sorted_codes(spark, tmp_path):
    rows, _ = mutate(chain(30), "several")
    _, errors = V.verify_ledger(spark, write(tmp_path, b"".join(rows)))
    message = V.seal_gate(errors).first().message
    assert message.endswith("content_hash_mismatch, duplicate_event_id, schema_mismatch")
    assert json.dumps(message)
    assert V.error_codes(errors.where(F.col("code") == "previous_hash_mismatch")).count() == 0


def tree(data):
    """The digest tree in plain code: lines, then 1 MiB of offsets, then fixed fan-in."""
    import hashlib

    hexed = lambda b: hashlib.sha256(b).hexdigest()
    rows, at = [], 0
    for line in data.splitlines(keepends=True) if b"\r" not in data else [x + b"\n" for x in data.split(b"\n")[:-1]]:
        rows.append((at, hexed(line)))
        at += len(line)
    for width in (1 << 20, 4096, 4096, 4096):
        groups = {}
        for at, h in rows:
            groups.setdefault(at // width, []).append(h)
        rows = [(k, hexed("".join(v).encode())) for k, v in sorted(groups.items())]
    return rows[0][1]


@pytest.mark.parametrize("size", ["700", "4000", "128m"])
@pytest.mark.parametrize("shape", ["plain", "open", "bom", "bom-open-single", "blank"])
def test_digest_of_the_scan(spark, tmp_path, size, shape):
    """Equal at any split size, with a byte order mark, without the last newline; ids follow from it."""
    from evledger.operators.archive import snapshot_digest

    data = b"".join(map(dump, chain(1 if "single" in shape else 40)))
    data = (b"\xef\xbb\xbf" if "bom" in shape else b"") + (data[:-1] if "open" in shape else data)
    data = data + b"\n\r\n" if shape == "blank" else data
    path = write(tmp_path, data)
    for key, value in (("maxPartitionBytes", size), ("openCostInBytes", "0")):
        spark.conf.set(f"spark.sql.files.{key}", value)
    try:
        row = V.verify_ledger(spark, path)[0].first()
        table = snapshot_digest(L.ledger_lines(spark, path)).first()
    finally:
        for key in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{key}")
    assert row.snapshot_sha256 == table.sha256 == tree(data)
    assert row.path == path and row.known_id.startswith("ledger_") and len(row.known_id) == 39
    known = spark.createDataFrame([(path, "known-id")], "path string, ledger_id string")
    assert V.verify_ledger(spark, path, manifests=known)[0].first().known_id == "known-id"
