import hashlib
import json
import threading

import pytest
from pyspark.sql import functions as F

from evledger.operators import archive as A
from evledger.sources import lines as L
from tests.reference_fold import chain, dump
from tests.test_read import write_all

AT = "2024-01-01T00:00:00Z"


def gapped(n, missing):
    return b"".join(dump(e) for i, e in enumerate(chain(n)) if i not in missing)


@pytest.fixture
def sealed(spark, tmp_path):
    lines = L.ledger_lines(spark, write_all(tmp_path / "in", {"one": gapped(20, {5, 11}), "two": gapped(4, ())}))
    path = str(tmp_path / "archive")
    A.seal(lines, path, sealed_at=AT, active="/active")
    return path


def test_seal_read_and_verify(spark, sealed):
    batch = A.archive_read(spark, sealed, "one")
    assert (batch.chain_status, batch.cursor_status, batch.events.count()) == ("partial", "ok", 18)
    assert [r.event_id for r in batch.integrity_warnings.orderBy("byte_offset").collect()] == ["evt_0006", "evt_0012"]
    assert "raw_text" not in batch.events.columns
    assert A.archive_read(spark, sealed, "two").chain_status == "verified"
    status = {r.ledger_id: r for r in A.verify_archive(spark, sealed).collect()}
    assert status["one"].valid and status["one"].accepted_breakpoint_count == 2
    assert status["two"].valid and status["two"].manifest_sha256_matches_registry is None
    tail = A.archive_tail(spark, sealed, 2, source="a")
    assert {r.event_id for r in tail.where("ledger_id = 'one'").collect()} == {"evt_0015", "evt_0018"}


def test_active_calls_refuse_an_archive(spark, sealed, tmp_path):
    with pytest.raises(A.SealedArchiveError):
        A.assert_active(spark, sealed)
    A.assert_active(spark, str(tmp_path / "elsewhere"))
    with pytest.raises(A.SealedArchiveError, match="manifest missing"):
        A.archive_read(spark, str(tmp_path / "elsewhere"), "one")
    assert A.list_archives(spark, str(tmp_path / "none")).count() == 0
    assert not (tmp_path / "none").exists()


@pytest.mark.parametrize("kind", ["junk", "body"])
def test_other_errors_block_the_seal(spark, tmp_path, kind):
    good = gapped(6, ())
    bad = good + b"{bad\n" if kind == "junk" else good.replace(b"text", b"tent", 1)
    lines = L.ledger_lines(spark, write_all(tmp_path / "in", {"bad": bad, "good": good}))
    code = "invalid_json" if kind == "junk" else "content_hash_mismatch"
    with pytest.raises(A.LedgerNotSealableError, match=code):
        A.seal(lines, str(tmp_path / "a"), sealed_at=AT)
    assert not (tmp_path / "a").exists()
    rows = A.seal(lines, str(tmp_path / "b"), sealed_at=AT, strict=False)
    assert [r.ledger_id for r in rows.collect()] == ["good"]


def rewrite(spark, folder, change):
    rows = spark.read.parquet(folder)
    kept = spark.createDataFrame(rows.collect(), rows.schema)
    change(kept).write.mode("overwrite").parquet(folder)


@pytest.mark.parametrize("part", ["lines", "breakpoints", "breakpoint_lists", "reports", "manifests"])
def test_any_changed_part_closes_the_archive(spark, sealed, part):
    folder = f"{sealed}/{part}"
    if part == "lines":
        one = f"{folder}/ledger_id=one"
        flip = F.when(
            F.col("line") == 9, F.replace(F.col("value").cast("string"), F.lit("text"), F.lit("tent")).cast("binary")
        ).otherwise(F.col("value"))
        rewrite(spark, one, lambda df: df.withColumn("value", flip))
    elif part == "breakpoints":
        rewrite(spark, folder, lambda df: df.where("line > 8"))
    elif part == "breakpoint_lists":
        rewrite(spark, folder, lambda df: df.withColumn("document", F.replace("document", F.lit('"count":2'), F.lit('"count":3'))))
    elif part == "reports":
        rewrite(spark, folder, lambda df: df.withColumn("report", F.concat("report", F.lit(" "))))
    else:
        rewrite(spark, folder, lambda df: df.withColumn("manifest", F.replace("manifest", F.lit(AT), F.lit("2025"))))
    with pytest.raises(A.SealedArchiveError, match="check failed"):
        A.archive_read(spark, sealed, "one", limit=1)


def test_unfinished_seal_is_not_an_archive(spark, sealed):
    import pathlib

    (pathlib.Path(sealed) / "manifests" / "_SUCCESS").unlink()
    assert not A.is_sealed(spark, sealed)
    with pytest.raises(A.SealedArchiveError):
        A.archive_batches(spark, sealed)


def test_manifest_fields_and_registry(spark, sealed):
    import json

    rows = A.load_manifests(spark, sealed)
    m = json.loads(rows.where("ledger_id = 'one'").first().manifest)
    assert sorted(m) == [
        "append_policy",
        "archive",
        "archive_id",
        "breakpoints",
        "query_policy",
        "schema_version",
        "sealed_at",
        "source_active_ledger",
        "state_sidecar",
        "verification",
    ]
    assert len(m["archive"]) == 8
    entries = A.registry_entries(rows, "m")
    assert len(entries.columns) == 11
    match = {r.ledger_id: r.registry_match for r in A.registry_pin_match(rows, entries.where("ledger_id = 'one'")).collect()}
    assert match == {"one": True, "two": False}
    new = A.start_new_ledgers(rows, AT).select("value", "previous_hash").collect()
    assert len(new) == 2 and all(r.previous_hash is None for r in new)
    assert {json.loads(r.value)["event_type"] for r in new} == {"ledger_transition"}


def change_list(spark, sealed, text, extra=None):
    """Break the list of ledger "one" and pin the broken document, so that only its content can tell."""
    doc = f"{sealed}/breakpoint_lists"
    before = spark.read.parquet(doc).where("ledger_id = 'one'").first().document
    after = text(before)
    hit = F.col("ledger_id") == "one"
    rewrite(spark, doc, lambda df: df.withColumn("document", F.when(hit, F.lit(after)).otherwise(F.col("document"))))
    old, new = (hashlib.sha256(x.encode()).hexdigest() for x in (before, after))
    fix = F.replace(F.col("manifest"), F.lit(old), F.lit(new))
    rewrite(
        spark, f"{sealed}/manifests",
        lambda df: df.withColumn("manifest", fix).withColumn("manifest_sha256", F.sha2("manifest", 256)),
    )
    if extra is not None:
        rewrite(spark, f"{sealed}/breakpoints", extra)


@pytest.mark.parametrize(
    "check, text, extra",
    [
        ("breakpoint_schema", lambda t: t.replace("breakpoint_list.v1", "breakpoint_list.v9"), None),
        ("breakpoint_count", lambda t: t.replace('"count":2', '"count":1'), None),
        ("breakpoint_owner", lambda t: t.replace("archive_", "archive_0"), None),
        ("breakpoint_offsets", lambda t: t, lambda df: df.withColumn("byte_offset", F.lit(7).cast("long"))),
        ("breakpoint_digest", lambda t: t, lambda df: df.withColumn("event_id", F.lit("evt_x"))),
    ],
)
def test_a_wrong_list_refuses_its_ledger_only(spark, sealed, check, text, extra):
    change_list(spark, sealed, text, extra)
    failed = {r.ledger_id: r.failed_checks for r in A.refused_ledgers(A.archive_context(spark, sealed)).collect()}
    assert set(failed) == {"one"} and check in failed["one"]
    events, _, _ = A.archive_batches(spark, sealed)
    assert {r.ledger_id for r in events.select("ledger_id").collect()} == {"two"}


def test_frozen_bytes_are_held_against_the_verified_ones(spark, tmp_path, monkeypatch):
    lines = L.ledger_lines(spark, write_all(tmp_path / "in", {"one": gapped(6, ())}))
    real = A.archive_lines
    grown = lambda s, p: real(s, p).withColumn("value", F.concat("value", F.lit(b" ")))
    with monkeypatch.context() as m:
        m.setattr(A, "archive_lines", grown)
        with pytest.raises(A.SealedArchiveError, match="changed while"):
            A.seal(lines, str(tmp_path / "a"), sealed_at=AT)
    assert not A.is_sealed(spark, str(tmp_path / "a"))


@pytest.fixture
def whole(spark, tmp_path):
    lines = L.ledger_lines(spark, write_all(tmp_path / "in", {"one": gapped(9, {4}), "two": gapped(3, ())}))
    paths = str(tmp_path / "seals"), str(tmp_path / "registry")
    return lines, paths, lambda rows=lines, **more: A.seal_and_continue(rows, *paths, sealed_at=AT, active="/a", **more)


def test_whole_seal(spark, whole):
    lines, (seals, registry), run = whole
    entries = run()
    assert len(entries.columns) == 11 and entries.count() == 2
    assert {r.ledger_id for r in A.registered_archives(spark, registry).collect()} == {"one", "two"}
    opened = A.continued_ledgers(spark, registry)
    assert opened.count() == 2 and {json.loads(r.value)["event_type"] for r in opened.collect()} == {"ledger_transition"}
    archive = A.committed_seals(spark, registry)[0]
    assert all(r.valid for r in A.verify_archive(spark, archive, A.registered_archives(spark, registry)).collect())
    with pytest.raises(A.LedgerAlreadySealedError):
        run()
    # A successor is sealed in its turn: it is no longer an open ledger.
    later = opened.where(F.col("ledger_id") == opened.first().ledger_id)
    text = later.select("ledger_id", F.lit(1).cast("long").alias("line"), F.lit(0).cast("long").alias("byte_offset"),
                        F.octet_length("value").cast("long").alias("byte_len"), F.lit(False).alias("terminated"), F.col("value").cast("binary").alias("value"))
    run(text)
    assert A.registered_archives(spark, registry).count() == 3 and A.continued_ledgers(spark, registry).count() == 2


STEPS = ["table_facts", "verify_reports", "breakpoint_lists", "manifests", "registry_entries", "start_new_ledgers", "create_once"]


@pytest.mark.parametrize("step", STEPS)
def test_a_crash_before_the_commit_leaves_nothing(spark, whole, monkeypatch, step):
    """Whatever write dies, the registry is as before and the next seal is whole."""
    _, (seals, registry), run = whole
    with monkeypatch.context() as m:
        m.setattr(A, step, lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            run()
    assert A.committed_seals(spark, registry) == [] and A.registered_archives(spark, registry).count() == 0
    assert A.continued_ledgers(spark, registry) is None
    if step == STEPS[-1]:
        run()
        assert A.registered_archives(spark, registry).count() == 2


def test_of_two_seals_one_is_committed(spark, whole):
    _, (seals, registry), run = whole
    results = []

    def attempt():
        try:
            results.append(run().count())
        except A.LedgerAlreadySealedError:
            results.append("refused")

    threads = [threading.Thread(target=attempt) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(map(str, results)) == ["2", "refused"]
    assert A.registered_archives(spark, registry).count() == 2 and len(A.committed_seals(spark, registry)) == 1


def test_one_of_many_creators_wins(spark, tmp_path):
    won = []
    work = lambda k: won.append(k) if A.create_once(spark, f"{tmp_path}/c/1.json", f"{k}") else None
    threads = [threading.Thread(target=work, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and (tmp_path / "c/1.json").read_text() == str(won[0])
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == ["1.json"]


def test_seal_sorts_by_rows_not_by_the_shuffle_width(spark, tmp_path):
    lines = L.ledger_lines(spark, write_all(tmp_path / "in", {"one": gapped(40, {5})}))
    path = str(tmp_path / "archive")
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        A.seal(lines, path, sealed_at=AT)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    stored = A.archive_lines(spark, path)
    assert len(stored.inputFiles()) > 1
    assert [tuple(r) for r in stored.orderBy("byte_offset").select("line", "value").collect()] == [
        tuple(r) for r in lines.orderBy("byte_offset").select("line", "value").collect()
    ]
