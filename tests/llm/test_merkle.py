"""The manifest against plain code, on odd rows and across block borders."""

import hashlib

import pytest
from pyspark.sql import functions as F

from evledger.llm import merkle
from evledger.session import materialize
from tests.llm.data import odd_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    fields = (doc_id, source, lang, n_chars, text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def plain_tree(row):
    """Root of a tree and each leaf's (siblings before, after) by level."""
    paths, held = [[] for _ in row], [[i] for i in range(len(row))]
    while len(row) > 1:
        above, below = [], []
        for i in range(0, len(row), 3):
            run = row[i : i + 3]
            for j, members in enumerate(held[i : i + 3]):
                for m in members:
                    paths[m].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(h("".join(run)))
            below.append(sum(held[i : i + 3], []))
        row, held = above, below
    return row[0], paths


def plain_audit(rows, tampered):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        members = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        trees[s] = members, plain_tree([plain_leaf(*r) for r in members])
    root, tops = plain_tree([trees[s][1][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        members, (subroot, paths) = trees[s]
        for r, path in zip(members, paths):
            now = plain_leaf(*r)
            if tampered(r[0]) and r[1]:
                now = plain_leaf(r[0], r[1].replace("\n", ""), *r[2:])
            for before, after in path + top:
                now = h(before + now + after)
            proof = h("".join(b + a for b, a in path + top))
            out.append((r[0], plain_leaf(*r), subroot, root, proof, now, now == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("height", [1, 2, 5])
def test_manifest_equals_plain(spark, height):
    """Nulls, repeats, hot and lone sources; low blocks make many levels of them."""
    rows = odd_documents()
    rows += [(100 + k, f"line {k}\nand {k % 7}", "aa", "hot", k) for k in range(83)]
    rows += [(300 + k, "alone\n", None, f"s{k}é", None) for k in range(11)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit("clash")).withColumn("key", F.lit(1))
    docs = docs.repartition(5)
    tampered = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    got = merkle.audit(docs, tampered, height)
    assert got.columns == COLUMNS
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    assert got == plain_audit(rows, lambda i: i is not None and i % 2 == 0)
    assert {r[6] for r in got} == {True, False}


def test_empty_and_single(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.audit(none, F.lit(True)).count() == 0
    one = merkle.audit(spark.createDataFrame([(1, None, None, None, None)], SCHEMA), F.lit(True)).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] == h("1:1----")
    assert one["proof_sha256"] == h("") and one["verified"]


@pytest.mark.parametrize("levels", range(1, 8))
def test_layout_is_a_permutation(levels):
    """Every node has one place; a subtree at half height is one range."""
    places = [merkle.addresses(levels, d) for d in range(levels)]
    assert sorted(int(p) for row in places for p in row) == list(range(merkle.nodes(levels)))
    top = levels // 2
    for s in range(3**top if levels > 1 else 0):
        inside = [int(p) for d in range(top, levels) for p in places[d][s * 3 ** (d - top) : (s + 1) * 3 ** (d - top)]]
        assert max(inside) - min(inside) + 1 == len(inside)


def test_blocks_hold_the_tree(spark):
    """The stored manifest alone gives roots and siblings."""
    docs = materialize(spark.createDataFrame([(k, f"t{k}", "aa", "s", k) for k in range(700)], SCHEMA), "docs")
    manifest = merkle.build(docs)
    assert [b.count() for b in manifest.levels] == [3, 1]
    leaves = [plain_leaf(k, f"t{k}", "aa", "s", k) for k in range(700)]
    assert manifest.root == plain_tree(leaves)[0]
    row = manifest.levels[0].filter("block = 2").first()
    levels = merkle.levels_for(row["total"])
    assert merkle.digest_at(row["tree"], levels, levels - 1, 5) == leaves[2 * 243 + 5]
    steps = merkle.climb(row["tree"], levels, row["count"])[5]
    assert "".join(s for _, s in steps) == "".join(a + b for a, b in plain_tree(leaves)[1][2 * 243 + 5][:5])
