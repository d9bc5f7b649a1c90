"""Plans and sizes that must hold on large tables; results on rows that cross their borders."""

import pyarrow as pa
from pyspark.sql import functions as F

from evledger.functions import text as X
from evledger.operators import chain as H
from evledger.operators import segments as G
from evledger.operators.envelope import build_event


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def chain_events(spark, n, ledgers=3):
    rows = spark.range(n).select(
        F.format_string("l%d", F.col("id") % ledgers).alias("ledger_id"), F.col("id").alias("seq"), "id"
    )
    return build_event(
        rows,
        source=F.lit("s"),
        event_type=F.lit("t"),
        event_id=F.concat(F.lit("evt_"), F.col("id").cast("string")),
        ts="2024-01-01T00:00:00Z",
        raw_text=F.repeat(F.lit("word "), F.lit(200)),
        keep=("ledger_id", "seq"),
    )


def test_many_repeated_ids_do_not_pass_through_the_driver(spark, monkeypatch):
    rows = spark.range(3000).select(F.col("id").alias("at"), (F.col("id") % 700).alias("key"))
    monkeypatch.setattr(G, "broadcast_if_small", lambda df: df)
    copies = G.later_copies(rows, ["key"], "at")
    assert "BroadcastHashJoin" not in plan_of(copies)
    assert sorted(r["at"] for r in copies.collect()) == list(range(700, 3000))


def test_chain_across_blocks(spark):
    """Ledgers that span many blocks, with ties of nothing and rows without an order, chain as in one block."""
    rows = chain_events(spark, 500)
    whole = {r.seq: r.content_hash for r in H.chain_build(rows).collect()}
    tasks = H._fold_round(rows, None, "seq", 4, block_rows=7)
    assert {r.seq: r.content_hash for r in tasks.collect()} == whole
    assert tasks.columns == H.chain_build(rows).columns
    heads = H.chain_heads(H.chain_build(rows.where("seq < 200")))
    rest = H._fold_round(rows.where("seq >= 200"), heads, "seq", 4, block_rows=7)
    assert {r.seq: r.content_hash for r in rest.collect()} == {k: v for k, v in whole.items() if k >= 200}


def test_a_ledger_comes_to_its_fold_in_compressed_blocks(spark):
    """One row a block is sorted there, far smaller than the rows' text."""
    rows = chain_events(spark, 3000, 1).repartitionByRange(2, "ledger_id", "seq").sortWithinPartitions("seq")
    parts = rows.withColumn("_parts", H.C.chain_parts(H.event_body()))
    blocks = parts.mapInArrow(H._pack("seq", 1024), "ledger_id string, seq long, _nth long, _block binary").collect()
    assert len(blocks) <= 6
    assert sum(len(b["_block"]) for b in blocks) < 200 * 3000  # a row's text alone has over 2,000 bytes


def test_compressed_ledgers_scan_as_plain_ones(spark, tmp_path):
    from evledger.operators import verify as V
    from evledger.sources.lines import ledger_lines

    chained = H.chain_build(chain_events(spark, 300)).localCheckpoint()
    plain, packed = str(tmp_path / "plain"), str(tmp_path / "gzip")
    H.write_ledger(chained, plain)
    H.write_ledger(chained, packed, compression="gzip")
    assert any(p.name.endswith(".gz") for p in (tmp_path / "gzip").rglob("part-*"))
    columns = ["ledger_id", "line", "byte_offset", "byte_len", "terminated", "value"]
    first, second = (sorted(ledger_lines(spark, p).select(*columns).collect()) for p in (plain, packed))
    assert first == second
    one, two = (V.verify_ledger(spark, p)[0].drop("path", "known_id") for p in (plain, packed))
    assert sorted(one.collect()) == sorted(two.collect())
    # Small files are larger when compressed; that is no byte order mark.
    tiny = tmp_path / "tiny"
    spark.createDataFrame([("l0", 0, "x")], "ledger_id string, seq long, value string").write.parquet(str(tiny))
    H.write_ledger(spark.read.parquet(str(tiny)), str(tmp_path / "t"), compression="gzip")
    assert [(r.byte_offset, r.byte_len) for r in ledger_lines(spark, str(tmp_path / "t")).collect()] == [(0, 2)]


def test_last_before_over_segments(spark):
    """Nulls pass a value on, also across segments that hold nothing else."""
    rows = spark.range(40).select(F.lit("k").alias("k"), F.col("id").alias("at"))
    value = F.when(F.col("at").isin(3, 4, 21), F.col("at"))
    got = {r["at"]: r["v"] for r in G.last_before(rows, ["k"], "at", value, "v", 5).collect()}
    last, want = None, {}
    for at in range(40):
        want[at] = last
        last = at if at in (3, 4, 21) else last
    assert got == want


def test_facts_of_a_table_shuffle_once(spark):
    from evledger.sources.lines import table_facts

    lines = H.chain_lines(H.chain_build(chain_events(spark, 20))).select(
        "ledger_id", F.col("seq").alias("line"), F.col("seq").alias("byte_offset"), F.lit(1).alias("byte_len"), F.col("value").cast("binary")
    )
    facts = table_facts(lines)
    wide = [part for part in plan_of(facts).split("Exchange hashpartitioning")[1:] if part.startswith("(ledger_id") and "byte_offset" in part.split(")", 1)[0]]
    assert not wide  # no join of all facts by their place
    assert all(r["link_ok"] and r["hash_ok"] and r["calculated_hash"] == r["stored_hash"] for r in facts.collect())


def test_chain_text_of_odd_bodies_in_one_pass(spark):
    """Vectorised canonical text is that of Python's JSON, and rows cross to Python once before the fold."""
    import json

    odd = ['q"', "back\\slash", "\n\t\x00\x1f\x7f", "é\U0001f600", "", None, "plain"]
    privacy = [{"scope": t, "review_required": f} for t, f in zip(odd, [True, False, None] * 3)]
    rows = [
        {n: odd[(i + k) % len(odd)] for k, n in enumerate(H.BODY_FIELDS)}
        | {"tags": [odd[i], "t"], "privacy": privacy[i], "payload": '{"z": 1e16, "a": [1.50, "\\u00e9"]}', "artifacts": "[]"}
        for i in range(len(odd))
    ]
    for part in (rows, rows[-1:]):
        arrays = [pa.array([r[n] for r in part]) for n in H.BODY_FIELDS]
        arrays = [a.cast(pa.string()) if pa.types.is_null(a.type) else a for a in arrays]
        body = pa.StructArray.from_arrays(arrays, list(H.BODY_FIELDS))
        for row, text in zip(part, H.C.body_parts(body).to_pylist()):
            whole = row | {"payload": json.loads(row["payload"]), "artifacts": [], "previous_hash": "x"}
            want = json.dumps(whole, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
            assert text["head"] + '"x"' + text["tail"] == want
    assert "ArrowEvalPython" not in plan_of(H.chain_build(chain_events(spark, 20)))


def written(monkeypatch, module):
    """Labels and columns of the tables that ``module`` writes from here on."""
    found, write = {}, module.materialize

    def noted(df, label, *rest):
        found[label] = df.columns
        return write(df, label, *rest)

    monkeypatch.setattr(module, "materialize", noted)
    return found


def ledger_of(spark, n):
    size = F.octet_length("value").cast("long") + 1
    lines = H.chain_lines(H.chain_build(chain_events(spark, n))).select(
        "ledger_id", F.col("seq").alias("line"), (F.col("seq") * 10_000).alias("byte_offset"), size.alias("byte_len"),
        F.lit(True).alias("terminated"), F.col("value").cast("binary").alias("value"),
    )
    return lines.localCheckpoint()


def test_newest_lines_are_found_by_offset_alone(spark, monkeypatch):
    from evledger.sources import lines as L

    rows = [("a", i, i * 10, b"x%d" % i if i % 4 else b"  ") for i in range(30)]
    rows += [("b", 1, 5, b"one"), ("c", 1, None, b"none"), ("c", 2, 7, b"two"), (None, 1, 3, b"y")]
    rows += [("d", i, 8, b"tie") for i in range(4)]
    lines = spark.createDataFrame(rows, "ledger_id string, line long, byte_offset long, value binary")
    tables = written(monkeypatch, L)
    got = sorted(L.recent_events(lines, 3).collect(), key=str)
    assert tables["recent"] == ["_of", "_from"]  # what is sorted over all lines has no text
    assert {r.line for r in got if r.ledger_id == "a"} == {27, 29, 26}
    assert len(got) == 3 + 1 + 2 + 1 + 3 and {r.line for r in got if r.ledger_id == "c"} == {1, 2}


def test_reads_and_seals_write_what_they_check(spark, monkeypatch, tmp_path):
    """No calculated hash beside an equal one, no routing fields, and no second copy of the facts."""
    from evledger.operators import archive as A
    from evledger.operators import read as R
    from evledger.sources import lines as L

    lines = ledger_of(spark, 30)
    batch, facts, sealed = (written(monkeypatch, m) for m in (R, L, A))
    events, envelopes, _ = R.read_batches(lines, R.zero_cursors(lines), sources=["s"])
    assert {r.chain_status for r in envelopes.collect()} == {"verified"} and events.count() == 30
    assert not {"calculated_hash", "source", "event_type", "project"} & set(batch["batch"])
    A.seal(lines, str(tmp_path / "sealed"), sealed_at="2024-06-01T00:00:00Z")
    assert "seal-facts" not in sealed and not {"source", "event_id_raw"} & set(facts["facts"])
    assert R.read_batches(lines, R.zero_cursors(lines), sources=["other"])[0].count() == 0


def test_digests_shuffle_as_bytes(spark):
    texts = ["0" * 64, "A" * 64, "ab", "", None, "f" * 63 + "\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    short = X.short_hash(F.col("t"))
    got = rows.select(short.alias("s"), X.long_hash(short).alias("t")).collect()
    assert [r.t for r in got] == texts and [r.s.digest is not None for r in got] == [True] + [False] * 5


def test_events_are_built_after_the_exchange(spark):
    """Narrow rows are ordered and folded; their events exist in between only, and hashes are those of whole events."""
    rows = spark.range(300).select(F.format_string("l%d", F.col("id") % 3).alias("ledger_id"), F.col("id").alias("seq"), (F.col("id") * 7).alias("part"))

    def build(rows, keep=("ledger_id", "seq", "part")):
        return build_event(
            rows, source=F.lit("s"), event_type=F.lit("t"), event_id=F.concat(F.lit("evt_"), F.col("seq").cast("string")),
            ts="2024-01-01T00:00:00Z", raw_text=F.repeat(F.lit("word "), F.lit(200)),
            payload=F.concat(F.lit('{"part": '), F.col("part").cast("string"), F.lit("}")), keep=keep,
        )

    narrow = H.chain_build(rows, build=build)
    assert narrow.columns == ["ledger_id", "seq", "part", "previous_hash", "content_hash"]
    assert "word" not in plan_of(narrow).split("Exchange rangepartitioning")[1]
    hashes = ["ledger_id", "seq", "previous_hash", "content_hash"]
    want = sorted(H.chain_build(build(rows)).select(*hashes).collect(), key=str)
    assert sorted(narrow.select(*hashes).collect(), key=str) == want
    rounds = H.chain_build(rows, build=build, round_rows=40)
    assert rounds.columns == narrow.columns and sorted(rounds.select(*hashes).collect(), key=str) == want


def test_bulk_text_comes_from_narrow_rows(spark, monkeypatch, tmp_path):
    """The text is that of whole chained events; the export parses lines that may be kept, in one scan."""
    from evledger.operators import verify as V
    from evledger.plans import bulk_queries as B

    rows = [(i // 4, i % 4, i * 3, 1, "RNA"[i % 3], 1.0, 2.0, "1995-01-01") for i in range(400)] + [(5, 1, 63, 1, "R", 1.0, 2.0, "1995-01-01")]
    names = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_returnflag string, l_quantity double, l_extendedprice double, l_shipdate string"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "lineitem.parquet"))
    tables = written(monkeypatch, B)
    assert "raw_text" not in B.bulk_chained(spark, str(tmp_path)).columns
    got = sorted(r.value for r in spark.read.text(B.bulk_files(spark, str(tmp_path))).collect())
    assert got == sorted(r.value for r in H.chain_lines(H.chain_build(B.bulk_events(spark, str(tmp_path)))).collect())
    assert V.verify_ledger(spark, B.bulk_files(spark, str(tmp_path)))[0].where("valid").count() == 64
    flags = [r[4] for r in rows]
    assert B.bulk_export(spark, str(tmp_path)).first()["lines"] == flags.count("R") and tables["bulk-kept"] == ["value", "event_id"]


def test_payload_of_one_number_is_spelled_as_python_does():
    import json

    odd = ['{"a": 1}', '{"a":1}', '{"a": -7}', '{"a": 0}', '{"a": -0}', '{"a": 1.0}', '{"a": 1e3}', '{"a": 1}\n', ' {"a":  1}']
    odd += ['{"é": 1}', '{"a": 123456789012345678901}', '{"a": "x"}', '{"a: b": 1}', '{"a": 1, "A": 2}', '{"\\u0061": 1}', "{}", '{"a": true}']
    for texts in [[t] for t in odd] + [odd, odd[:4]]:
        body = pa.StructArray.from_arrays([pa.array(texts)], ["payload"])
        for encode, item, colon in ((H.C._canonical, ",", ":"), (H.C._stored, ", ", ": ")):
            got = H.C._fields(body, encode, item, colon)["payload"].to_pylist()
            assert got == [encode(json.loads(t)) for t in texts]
