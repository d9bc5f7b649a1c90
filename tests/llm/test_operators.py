"""Operators against plain versions on small tables."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from evledger.llm import (
    components,
    decontaminate,
    html_text,
    language,
    mixing,
    near_copies,
    queries,
    rans,
    simhash,
    token_counts,
    token_store,
    tokens,
    toxicity,
)
from evledger.session import materialize
from tests.llm.data import TOKENIZER, prose

DATA = "/root/testdata/sf0.001"
SEEN = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text, width=4):
    words = SEEN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    width = min(width, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, bits):
    """Root of each number: the smallest that is reachable."""
    root = {f: f for f in fps}
    left = set(fps)
    while left:
        first = min(left)
        front = {first}
        left -= front
        while front:
            near = {g for g in left if any((f ^ g).bit_count() <= bits for f in front)}
            for g in near:
                root[g] = first
            left -= near
            front = near
    return root


def plain_copies(sets):
    """Root of each shingle set: sets at Jaccard 0.8 or more connect."""
    every = sorted(set(sets), key=sorted)
    root = {s: s for s in every}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(every):
        for b in every[:i]:
            both = len(a & b)
            if 10 * both >= 8 * (len(a) + len(b) - both) and (both or not (a or b)):
                root[find(a)] = find(b)
    return {s: find(s) for s in every}


@pytest.fixture(scope="module")
def documents(spark):
    if not os.path.isdir(DATA):
        pytest.skip("test tables absent")
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_shared_bytes_bound_the_distance():
    """The tally counts equal bytes; pairs within d bits share eight less d of them."""
    rng = np.random.default_rng(9)
    one = rng.integers(0, 2**63, 4000, np.uint64)
    for bits in range(5):
        flips = [sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in one]
        apart = np.array(flips, np.uint64)
        tally = simhash.shared_bytes(apart)
        assert (tally >= 8 - bits).all()
        assert tally.tolist() == [sum(x >> 8 * k & 255 == 0 for k in range(8)) for x in flips]


@pytest.mark.parametrize("hot", [2048, 8])
def test_simhash_equals_brute_force(spark, documents, monkeypatch, hot):
    """Also with buckets split down to pairs of bits."""
    monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
    rng = random.Random(3)
    base = documents.select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in base]
    one = prose(40, 300).split(" ")
    for k in range(150):  # a dense group of near copies
        copy = list(one)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 5)}"
        rows.append((10_000 + k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = {i: plain_fingerprint(t) for i, t in rows}
    root = plain_components(set(expected.values()), 4)
    least = defaultdict(lambda: 1 << 60)
    for i, f in expected.items():
        least[root[f]] = min(least[root[f]], i)
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f, least[root[f]]) for i, f in expected.items()}


def plain_shingles(text, width=5):
    words = SEEN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def test_near_copies_equal_jaccard_brute_force(spark, documents):
    """Also at 0.8 to 0.9, which fingerprints within four bits mostly miss."""
    rng = random.Random(11)
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    for k in range(60):
        one = prose(500 + k, 300).split()
        rows.append((20_000 + 2 * k, " ".join(one)))
        for at in rng.sample(range(300), 1 + k % 9):
            one[at] = "changed"
        rows.append((20_001 + 2 * k, " ".join(one)))
    sets = {i: plain_shingles(t) for i, t in rows}
    alike = lambda a, b: a == b or 10 * len(a & b) >= 8 * len(a | b)
    want = {}
    for i in sorted(sets):  # components, by their smallest id
        if i not in want:
            front = [i]
            want[i] = i
            while front:
                near = [j for j in sets if j not in want and any(alike(sets[j], sets[f]) for f in front)]
                want |= dict.fromkeys(near, i)
                front = near
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string"), "copies")
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_duplicates(docs).collect()}
    assert got == want
    assert sum(want[20_001 + 2 * k] == 20_000 + 2 * k for k in range(60)) > 30
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == set(want.values())


def test_links_in_hot_buckets(spark, monkeypatch):
    """Fingerprints that share most bytes need every level of the index."""
    monkeypatch.setattr(simhash, "HOT_BUCKET", 4)
    rng = random.Random(9)
    fps = {0x0123456789ABCDEF}
    while len(fps) < 300:
        f = rng.choice(sorted(fps))
        for _ in range(rng.randint(1, 7)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), len(signed))
    found = components.components(links).collect()
    got = {r["node"]: r["root"] for r in found}
    want = plain_components([s[0] for s in signed], 0)
    groups = plain_components(fps, 4)
    assert {got.get(s[0], s[0]) for s in signed} == {
        min(s[0] for s, f in zip(signed, fps) if groups[f] == g) for g in set(groups.values())
    }
    assert len(want) == len(fps)


def test_components_of_chain_and_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(101, 161)} | {k: 1 for k in range(2, 40)}


def test_sql_of_operators(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    for name, text in queries.ORACLES.items():
        result = entry.queries()[name](spark, DATA)
        columns = sorted(result.columns)
        relation = con.sql(text)
        assert sorted(relation.columns) == columns
        order = [relation.columns.index(c) for c in columns]
        got = sorted(([r[c] for c in columns] for r in result.collect()), key=repr)
        assert got == sorted(([r[i] for i in order] for r in relation.fetchall()), key=repr)


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert {m[1] for n in names if (m := re.match(r"op(\d+)_", n))} == {str(k) for k in range(1, 11)}
    assert "pipeline" in names


def test_containment_equals_brute_force(spark, documents):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"], r["n_shared"]) for r in decontaminate.find(documents, items).collect()}
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda w: {tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)}
    docs = [(r["doc_id"], grams(split(r["text"] or ""))) for r in documents.collect()]
    want = set()
    for r in items.collect():
        own = grams(split(r["text"]))
        want |= {(d, r["item_id"], len(own & g)) for d, g in docs if own and 10 * len(own & g) >= 8 * len(own)}
    assert got == want and want
    blocks = list(decontaminate.blocks(decontaminate.classes(items), 500))
    assert len(blocks) > 3 and sum(map(len, blocks)) == decontaminate.classes(items).count()


def test_edited_item_is_found_in_long_text(spark):
    item = prose(50, 60)
    words = item.split(" ")
    words[30] = "changed"
    long = prose(51, 20_000) + " " + " ".join(words).upper() + " " + prose(52, 5_000)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, long), (2, prose(53, 20_000))], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.find(docs, items).collect()] == [1]


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 600_000])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.4, n) % 50_000).astype(np.uint32)
    table = rans.Table(rans.quantize(np.bincount(ids, minlength=50_257)))
    assert int(table.freq.sum()) == 1 << table.precision
    block = rans.encode_block(ids, table)
    assert np.array_equal(rans.decode_block(block, table), ids)
    spans = [rans.decode_block(block, table, k, k + 1) for k in range(3)]
    assert np.array_equal(np.concatenate(spans), ids[: sum(map(len, spans))])
    for place in (4, len(block) // 2, len(block) - 1):
        broken = bytearray(block)
        broken[place] ^= 1
        with pytest.raises(ValueError):
            rans.decode_block(bytes(broken), table)
    with pytest.raises(ValueError):
        rans.decode_block(block[:30], table)


def test_rans_rejects_unknown_ids():
    table = rans.Table(rans.quantize(np.bincount([1, 2, 2], minlength=10)))
    with pytest.raises(ValueError):
        rans.encode_block(np.array([3], np.uint32), table)


def plain_ids(texts):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)
    return [x.ids for x in found]


def test_encoder_equals_library():
    rng = random.Random(1)
    parts = ["a", "word", " ", "  ", "\n", " \n", "\t", "'s", "12", "é", "!", "<|endoftext|>", "\x00", "\u00a0", "\u3000", "\x1c"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)]
    for remember in (100, 100_000):
        coder = tokens.Encoder(TOKENIZER, remember)
        for at in range(0, len(texts), 500):
            got = coder.encode(texts[at : at + 500])
            assert [np.frombuffer(g, coder.dtype).tolist() for g in got] == plain_ids(texts[at : at + 500])
            assert len(coder.known) <= remember


def test_store_equals_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_TOKENS", 5000)
    rows = {r["doc_id"]: r for r in token_store.store_digest(documents, TOKENIZER).collect()}
    start = 0
    texts = sorted((r["doc_id"], r["text"] or "") for r in documents.collect())
    for (doc_id, _), ids in zip(texts, plain_ids([t for _, t in texts])):
        ids = [*ids, 0]
        assert rows[doc_id]["start"] == start and rows[doc_id]["n_tokens"] == len(ids)
        assert rows[doc_id]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_edits_equal_encoding_anew():
    coder = tokens.Encoder(TOKENIZER)
    count = token_counts.counter(coder)
    rng = random.Random(5)
    parts = ["a", "b", "foo", "bar", " ", "  ", "\n", " \n", "'s", "12", "é", "!", "\t", "x<|endoftext|>y", "\x00"]
    for _ in range(150):
        text = "".join(rng.choices(parts, k=rng.randint(0, 60)))
        tree = token_counts.CountTree(tokens.pieces(text), count(tokens.pieces(text)), count)
        for _ in range(rng.randint(1, 10)):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.randint(0, 8))
            new = "".join(rng.choices(parts, k=rng.choice([0, 1, 5, 200])))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.text() == text and tree.tokens == len(plain_ids([text])[0])
    long = prose(60, 20_000)
    tree = token_counts.CountTree(tokens.pieces(long), count(tokens.pieces(long)), count)
    tree.edit(50_000, 50_003, "new words")
    assert tree.reencoded < 200 and tree.tokens == len(plain_ids([tree.text()])[0])


def test_edit_tables_equal_encoding_anew(spark, documents):
    held = materialize(token_counts.states(documents, TOKENIZER), "states")
    edits = F.expr("array(struct(0 as start, 3 as end, 'new ' as new), struct(10 as start, 10 as end, cast(null as string) as new))")
    edited = token_counts.apply_edits(held.withColumn("edits", edits), TOKENIZER).collect()
    for r, ids in zip(edited, plain_ids([r["text"] for r in edited])):
        assert r["n_tokens"] == len(ids) == sum(r["counts"]) and r["n_edits"] == 2
    scrubbed = token_counts.apply_edits(held, TOKENIZER, token_counts.scrub).collect()
    assert any(r["n_edits"] for r in scrubbed)
    names = ["doc_id", "n_before", "n_edits", "reencoded", "n_tokens"]
    at_once = token_counts.edit_documents(documents, TOKENIZER, token_counts.scrub).select(*names).collect()
    assert sorted(map(tuple, at_once)) == sorted(tuple(r[n] for n in names) for r in scrubbed)
    for r, ids in zip(scrubbed, plain_ids([r["text"] for r in scrubbed])):
        assert r["n_tokens"] == len(ids)


def test_mix_meets_targets(spark, documents):
    rows = materialize(mixing.sized(documents), "sized")
    mixed = mixing.mix(rows).collect()
    again = mixing.mix(rows).collect()
    key = lambda r: (r["doc_id"], r["copies"])
    assert sorted(map(key, mixed)) == sorted(map(key, again))
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert all(r["size"] == len(SEEN.findall(texts[r["doc_id"]] or "")) for r in mixed)
    sizes, taken, target = Counter(), Counter(), {}
    for r in mixed:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    assert {r["source"]: r["source_size"] for r in mixed} == dict(sizes)
    want = plain_targets(sizes)
    assert all(abs(target[s] - want[s]) < 1e-6 for s in sizes)
    for s in sizes:
        assert abs(taken[s] - target[s]) < max(0.1 * target[s], max(r["size"] for r in mixed if r["source"] == s))


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, full = float(sum(sizes.values())), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else left * weight[s] / share for s in names}
        over = {s for s in names if target[s] > 3 * sizes[s]} - full
        if not over:
            return target
        full |= over


def test_targets_stop_and_reshare(spark):
    sizes = {"a": 1000, "b": 10, "c": 5, "d": 0, None: 300}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    want = plain_targets(sizes)
    assert all(abs(got[s] - want[s]) < 1e-9 for s in sizes)


def test_balance_in_rounds(spark):
    """Blocks far smaller than a group still end near both totals."""
    rng = random.Random(2)
    rows = [(k % 2, rng.randrange(1 << 62), k, rng.randint(1, 2000), 0.37) for k in range(4000)]
    df = materialize(spark.createDataFrame(rows, mixing.COLUMNS), "rows")
    out = mixing.balance(df, block=100).collect()
    assert len(out) == len(rows) and {r["p"] for r in out} == {0.0, 1.0}
    for g in (0, 1):
        words = sum(r["p"] * r["size"] for r in out if r["group"] == g)
        assert abs(words - 0.37 * sum(r[3] for r in rows if r[0] == g)) < 500
        assert abs(sum(r["p"] for r in out if r["group"] == g) - 0.37 * 2000) < 10


def test_flight_keeps_probabilities_and_totals():
    rng = np.random.default_rng(4)
    size = rng.integers(1, 100, 12)
    p = np.full(12, 0.3)
    flown = [mixing.flight(p, size, rng.random(12)) for _ in range(3000)]
    assert abs(np.mean(flown, axis=0) - 0.3).max() < 0.05
    assert max(abs((f - p).sum()) + abs(((f - p) * size).sum()) for f in flown) < 1e-6
    assert max(((f > 0) & (f < 1)).sum() for f in flown) <= 2


def test_language_of_unseen_words(spark):
    rows = [("aa", prose(k, 60, ("ka", "lo", "mi"))) for k in range(20)] + [("bb", prose(k, 60, ("shu", "zet", "org"))) for k in range(20)]
    model = language.train(spark.createDataFrame(rows, "lang string, text string"))
    langs, scores = model.predict([b"kalomikalomika lomimikakalo", b"ZETORGSHUSHUZET", b"12 --", b""])
    assert langs == ["aa", "bb", "und", "und"] and scores[0] > 0.9 and scores[1] > 0.9
    small = language.train(spark.createDataFrame(rows, "lang string, text string"), words=3, grams=20)
    assert len(small.words) == 6 and small.predict([b"kalomi", b"shuzet"])[0] == ["aa", "bb"]
    # A large language leaves the share of a small one alone.
    many = rows + [("cc", prose(k, 400, ("ba", "du", "fe", "gi", "ny"))) for k in range(60)]
    large = language.train(spark.createDataFrame(many, "lang string, text string"), words=30, grams=60)
    assert large.predict([b"zetorgshu orgzet"])[0] == ["bb"] and len(large.words) == 90


def test_language_held_out(spark):
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    found = entry.queries()["op1_language_id"](spark, data).join(docs, "doc_id").filter("held_out").collect()
    assert len(found) > 100 and sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.97


def test_toxicity_of_unseen_misspellings():
    clean = [prose(k, 120).encode() for k in range(200)]
    toxic = [prose(1000 + k, 120).encode() + b" " + w + b" " + prose(2000 + k, 100).encode()
             for k, w in enumerate([b"scoundrel", b"nitwit", b"blockhead", b"scoundrels"] * 25)]
    model = toxicity.fit(clean + toxic, [0] * 200 + [1] * 100)
    bad = model.score([prose(5000 + k, 150).encode() + b" " + w for k, w in enumerate([b"scoundrell", b"nitwits", b"blockheadz"])])
    good = model.score([prose(6000 + k, 150).encode() for k in range(50)] + [b""])
    assert (bad >= 0.3).all() and (good < 0.3).mean() > 0.7 and good[-1] < 0.3


def test_toxicity_of_labelled_and_held_out_rows(spark):
    data = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "toxic")
    rows = entry.queries()["op10_toxicity"](spark, data).join(labels, "doc_id").collect()
    learned = [r["predicted"] for r in rows if r["toxic"] and not r["held_out"]]
    assert sum(learned) / len(learned) > 0.9
    clean = [r["predicted"] for r in rows if not r["toxic"] and r["held_out"]]
    assert sum(clean) / len(clean) < 0.05
    caught = [r["predicted"] for r in rows if r["toxic"] and r["held_out"]]
    assert sum(caught) / len(caught) > 0.4  # about 40 toxic rows to learn from


def test_pipeline_against_brute_force(spark, documents, tmp_path):
    """Each stage keeps what plain code keeps of the rows it gets."""
    docs = documents
    stages = dict(corpus_pipeline.STAGES)
    kept = materialize(stages["quality_rules"](spark, docs, DATA), "s1")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    good = {r[0] for r in con.sql(f"SELECT doc_id FROM ({queries.ORACLES['op8_quality_rules']}) WHERE kept").fetchall()}
    assert {r["doc_id"] for r in kept.collect()} == good
    sets = {r["doc_id"]: frozenset(near_copies.shingles((r["text"] or "").encode()).tolist()) for r in kept.collect()}
    root = plain_copies(list(sets.values()))
    least = {}
    for i in sorted(sets):
        least.setdefault(root[sets[i]], i)
    single = materialize(stages["near_dedup"](spark, kept, DATA), "s2")
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(least.values())
    clean = materialize(stages["decontamination"](spark, single, DATA), "s3")
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    bad = {r["doc_id"] for r in decontaminate.find(single, items).collect()}
    assert {r["doc_id"] for r in clean.collect()} == set(least.values()) - bad
    mixed = materialize(stages["source_mixing"](spark, clean, DATA), "s4")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(materialize(mixing.sized(clean), "sized")).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: v for k, v in copies.items() if v})
    assert stages["token_output"](spark, mixed, DATA).count() == mixed.count()


PAGES = [
    ("<p>a<p>b", "a\n\nb"),
    ("a <b>b</b>c<i> d </i> e", "a bc d e"),
    ("<ul><li>x<li>y<ul><li>z</ul></ul>t", "- x\n- y\n  - z\n\nt"),
    ("<ol start=9><li>x<li>y</ol>", "9. x\n10. y"),
    ("<table><tr><td>ab<td>c<tr><td>d<td>ef</table>", "ab | c\nd  | ef"),
    ("<script>x</script>a<style>y</style><!-- z -->b<p hidden>c</p><p style='DISPLAY : none'>d</p>", "ab"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<pre>\n a\n  b</pre>", "\n a\n  b"),
    ("&lt;&amp;&nbsp;x &copy;", "<&\u00a0x \u00a9"),
    ("<div>a<div>b</div></div>c", "a\nb\nc"),
    ("<title>no</title><h1>T</h1>x<blockquote>q<p>r</blockquote>", "T\n\nx\n\n  q\n\n  r"),
    ("x</p>y<td>z", "x\n\nyz"),
    ("<a title='>'>k</a><img alt=pic>", "kpic"),
    ("", ""),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_rendering(page, text):
    assert html_text.render(page) == text
