"""Language identification: known words first, shorter and shorter n-grams else.

Words and their counts per language come from all labelled rows, counted by Spark.
The model keeps ``WORDS`` words and ``GRAMS`` character n-grams of each length, an equal share
for the most frequent of each language; its size does not grow with the corpus.  A known
word adds its log frequency in each language.  An unseen word backs off: the longest
n-grams of which the model knows any decide, by their mean log frequency.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evledger.llm.common import arrow_map, as_bytes, crc_fold, slices
from evledger.session import broadcast_if_small, materialize, ship_package

WORDS = 200_000
GRAMS = 50_000
#: Keys of a language that are kept at least, however many languages there are.
LEAST = 10_000
LONGEST = 5
UNKNOWN = "und"
#: Distinct words that a counting task holds before it hands them on.
HELD = 200_000
SMOOTH = 0.5
_LETTERS = regex.compile(r"\p{L}+")


def words_of(text: bytes) -> list[str]:
    """Lower-cased runs of letters."""
    return _LETTERS.findall(text.decode("utf-8", "replace").lower())


def word_counts(docs: DataFrame) -> DataFrame:
    """``(lang, word, n)`` over all rows of ``docs(lang, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter[str]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                columns = [[lang] * len(counts), list(counts), list(counts.values())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))],
                    ["lang", "word", "n"],
                )
            held.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                for lang, text in zip(part.column("lang").to_pylist(), as_bytes(part.column("text"))):
                    held.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, held.values())) > HELD:
                    yield from out()
        yield from out()

    ship_package(docs.sparkSession)
    counted = docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _most(counts: DataFrame, key: str, limit: int, langs: list[str]) -> DataFrame:
    """Counts of the most frequent keys of each language, ties by the key.

    Every language has the same share of ``limit``, at least `LEAST`, so a large one does not
    push a small one out.  A key that one language keeps is kept with its counts in all.
    """
    share = max(min(LEAST, limit), -(-limit // max(1, len(langs))))
    top = None
    for lang in langs:
        own = counts.filter(F.col("lang") == lang).orderBy(F.desc("n"), key).limit(share).select(key)
        top = own if top is None else top.union(own)
    if top is None:
        return counts.limit(0)
    return counts.join(broadcast_if_small(top.distinct(), 2 * limit), key)


class Model:
    """Log frequencies of words and n-grams per language."""

    def __init__(self, langs: list[str], words: pa.Table, grams: dict[int, pa.Table], totals: dict[str, int]) -> None:
        self.langs = langs
        size = np.array([totals.get(x, 0) for x in langs], float)
        self.prior = np.log((size + 1) / (size.sum() + len(langs))) if langs else np.zeros(0)
        self.words, self.word_rows = self._rows(words, size)
        self.grams = {}
        for n, table in grams.items():
            at = {x: i for i, x in enumerate(langs)}
            mass = np.zeros(len(langs))
            np.add.at(mass, [at[x] for x in table.column("lang").to_pylist()], table.column("n").to_numpy())
            self.grams[n] = self._rows(table, mass)

    def _rows(self, table: pa.Table, mass: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
        at = {x: i for i, x in enumerate(self.langs)}
        index: dict[str, int] = {}
        rows = [index.setdefault(k, len(index)) for k in table.column("key").to_pylist()]
        counts = np.full((len(index), len(self.langs)), SMOOTH)
        np.add.at(counts, (rows, [at[x] for x in table.column("lang").to_pylist()]), table.column("n").to_numpy())
        return index, np.log(counts / (mass + SMOOTH * max(1, len(index)))).astype(np.float32)

    def backoff(self, words: list[str]) -> np.ndarray:
        """Rows for unseen words; a word without any known n-gram adds nothing."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        pairs: dict[int, tuple[list[int], list[int]]] = {n: ([], []) for n in self.grams}
        lengths = sorted(self.grams, reverse=True)
        for i, word in enumerate(words):
            padded = f" {word} "
            for n in lengths:
                known = self.grams[n][0]
                found = [known[g] for g in (padded[j : j + n] for j in range(len(padded) - n + 1)) if g in known]
                if found:
                    pairs[n][0].extend([i] * len(found))
                    pairs[n][1].extend(found)
                    break
        for n, (owners, rows) in pairs.items():
            if owners:
                share = np.bincount(owners, minlength=len(words))[owners]
                np.add.at(out, owners, self.grams[n][1][rows] / share[:, None])
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and its posterior for each text."""
        found = [words_of(t) for t in texts]
        index: dict[str, int] = {}
        ids = [[index.setdefault(w, len(index)) for w in words] for words in found]
        names = list(index)
        known = np.array([self.words.get(w, -1) for w in names], np.int64)
        rows = np.zeros((len(names), len(self.langs)), np.float32)
        if len(self.words):
            rows[known >= 0] = self.word_rows[known[known >= 0]]
        unseen = np.flatnonzero(known < 0)
        rows[unseen] = self.backoff([names[i] for i in unseen])
        langs, scores = [], np.zeros(len(texts))
        for k, own in enumerate(ids):
            if not own or not self.langs:
                langs.append(UNKNOWN)
                continue
            total = self.prior + rows[own].sum(axis=0, dtype=float)
            best = int(np.argmax(total))  # ties go to the first name
            langs.append(self.langs[best])
            scores[k] = 1 / np.exp(total - total[best]).sum()
        return langs, scores


def train(docs: DataFrame, words: int = WORDS, grams: int = GRAMS, longest: int = LONGEST) -> Model:
    """Fit on ``docs(lang, text)``; rows with a null language are not used.

    Statistics cover every row.  What reaches the driver is the model: about
    ``words`` words and ``grams`` n-grams of each length, shared out among the languages.
    """
    counts = materialize(word_counts(docs.filter(F.col("lang").isNotNull())), "words")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    kept = _most(counts, "word", words, langs).select("lang", F.col("word").alias("key"), "n").toArrow()
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))

    def parts(n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n)))
        return F.when(F.length(padded) >= n, cut).otherwise(F.array())

    tables = {}
    # Unseen words are rare ones: each distinct word counts once for the n-grams.
    every = counts.select(
        "lang",
        F.explode(F.flatten(F.array(*(parts(n) for n in range(1, longest + 1))))).alias("key"),
    )
    every = materialize(every.groupBy("lang", "key").agg(F.count("*").alias("n")), "grams")
    for n in range(1, longest + 1):
        tables[n] = _most(every.filter(F.length("key") == n), "key", grams, langs).select("lang", "key", "n").toArrow()
    return Model(langs, kept, tables, totals)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score)`` per row, from the text alone.

    A null text or one without a letter is ``und`` with score 0, as is everything
    under a model without a language.  Ties go to the first name; repeated rows are judged
    alike, texts of any length count whole, other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        langs, scores = shared.value.predict(as_bytes(batch.column("text")))
        return {"doc_id": batch.column("doc_id"), "lang_pred": langs, "score": scores}

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(kept, "doc_id long, lang_pred string, score double", each, sized_by="text")


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return crc_fold(doc_id, folds) == fold
