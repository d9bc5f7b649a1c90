"""Small tables for tests, made by rule."""

import random

import public_tokenizers

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(seed, words, stems=("ka", "lo", "mi", "re", "tu", "san", "vor", "eli")):
    rng = random.Random(seed)
    parts = ["".join(rng.choices(stems, k=rng.randint(1, 4))) for _ in range(words)]
    return " ".join(w + rng.choice(["", "", "", ",", ".", ".\n"]) for w in parts)


def odd_documents():
    """Nulls in every column, blanks, ties, repeats, a long text, odd characters."""
    long = prose(1, 30_000)
    rows = [
        (1, None, "aa", "s1"), (2, "", "aa", "s1"), (3, " \t\n 12 --", "aa", None), (4, prose(2, 80), "aa", "s1"),
        (5, prose(3, 90), None, "s2"), (6, prose(4, 70), "bb", None), (7, prose(4, 70), "bb", "s2"), (8, long, "aa", "s2"),
        (9, "one", "bb", "s3"), (10, "one two three", "bb", "s3"), (11, "a  b\u00a0c \n\n d<|endoftext|>\x00 e", None, None),
        (None, prose(5, 60), "aa", "s1"), (None, prose(5, 60), "aa", "s1"), (None, prose(6, 60), "aa", "s1"),
        (12, prose(7, 60), "aa", "s1"), (12, prose(7, 60), "aa", "s1"), (12, prose(8, 60), "bb", "s1"),
        (13, "é" * 5000, "bb", "s1"), (14, prose(9, 60) + " mail me: jo@example.org +1 555 0101234", "aa", "s1"),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def write_tables(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    items = [(1, prose(2, 80)[:200]), (2, None), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
