"""Toxicity by averaged subword embeddings under a linear softmax, in numpy.

A word is the bag of its character n-grams and itself, hashed to embeddings; a window of
a few words is the average of its words; a softmax over two classes reads it.  A text
is as toxic as its worst window, so one insult in a long text is not averaged away.
Embeddings and softmax are trained together.  Only texts carry labels, so each round
first looks up which window of a toxic text is its worst and which windows of clean
texts look toxic, then takes gradient steps on these.  Unseen misspellings and
inflections share n-grams with what was learned.

Training reads at most ``SAMPLE`` rows of each label, those with the smallest
hashes; scoring reads every word of every text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evledger.llm.common import arrow_map, as_bytes, crc_fold

SAMPLE = 2000
SAMPLE_BYTES = 10_000_000
BUCKETS = 1 << 17
DIM = 12
GRAM_LENGTHS = (3, 4, 5, 6)
WINDOW = 5
ROUNDS = 24
_LETTERS = regex.compile(r"\p{L}+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def words_of(text: bytes) -> list[str]:
    return _LETTERS.findall(text.decode("utf-8", "replace").lower())


def buckets_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams and whole words: ``(owner, bucket)`` sorted by owner."""
    text = "\n".join(f"<{w}>" for w in words)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    gap = code == 10
    owner = np.cumsum(gap)
    wholes = np.array([zlib.crc32(w.encode()) for w in words], np.uint64)
    owners, found = [np.arange(len(words))], [wholes * _MIX[0] >> np.uint64(64 - 17)]
    for n in GRAM_LENGTHS:
        total = len(code) - n + 1
        if total < 1:
            continue
        mixed = np.full(total, n, np.uint64)
        crosses = np.zeros(total, bool)
        for j in range(n):
            mixed = (mixed ^ code[j : j + total]) * _MIX[j]
            crosses |= gap[j : j + total]
        owners.append(owner[:total][~crosses])
        found.append(mixed[~crosses] >> np.uint64(64 - 17))
    owner, bucket = np.concatenate(owners), np.concatenate(found).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return owner[order], bucket[order]


def _means(values: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """Mean of the rows of each owner; all owners occur, in order."""
    starts = np.searchsorted(owner, np.arange(size))
    return np.add.reduceat(values, starts, axis=0) / np.diff(np.append(starts, len(owner)))[:, None]


class Model:
    def __init__(self, rate: float = 0.0) -> None:
        rng = np.random.default_rng(7)
        self.embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        self.out = rng.uniform(-0.1, 0.1, (DIM, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.scale, self.shift = 1.0, float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
        self.fitted = False
        self.flat: np.ndarray | None = None

    def freeze(self) -> None:
        """Folds softmax into embeddings: one number a bucket."""
        self.flat = self.embed @ (self.out[:, 1] - self.out[:, 0])
        self.embed = np.zeros((0, DIM), np.float32)

    def word_scores(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        owner, bucket = buckets_of(words)
        flat = self.flat if self.flat is not None else self.embed @ (self.out[:, 1] - self.out[:, 0])
        sums = np.bincount(owner, flat[bucket], len(words))
        return sums / np.bincount(owner, minlength=len(words))

    def windows(self, ids: list[np.ndarray], scores: np.ndarray) -> list[np.ndarray]:
        """Log odds of the windows of each text."""
        tilt = float(self.bias[1] - self.bias[0])
        out = []
        for own in ids:
            starts = np.arange(0, len(own), WINDOW)
            lengths = np.minimum(WINDOW, len(own) - starts)
            out.append(np.add.reduceat(scores[own], starts) / lengths + tilt if len(own) else np.zeros(0))
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability that the label is 1; texts without a word get the base rate."""
        if not self.fitted:
            return np.full(len(texts), 1 / (1 + np.exp(-self.shift)))
        index: dict[str, int] = {}
        ids = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], np.int64) for t in texts]
        worst = [w.max() if len(w) else -12.0 for w in self.windows(ids, self.word_scores(list(index)))]
        return 1 / (1 + np.exp(-np.clip(self.scale * np.array(worst) + self.shift, -40, 40)))


def fit(texts: list[bytes], labels: list[int], rounds: int = ROUNDS) -> Model:
    """Train on labelled texts; reruns agree."""
    y = np.array(labels, float)
    model = Model(float(y.mean()) if len(y) else 0.0)
    index: dict[str, int] = {}
    ids = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], np.int64) for t in texts]
    kept = [k for k, own in enumerate(ids) if len(own)]
    if not kept or y[kept].min() == y[kept].max():
        model.freeze()
        return model
    ids, y = [ids[k] for k in kept], y[kept]
    owner, bucket = buckets_of(list(index))
    starts = np.searchsorted(owner, np.arange(len(index) + 1))
    rng = np.random.default_rng(11)
    memory = [np.full(BUCKETS, 1e-6, np.float32), np.full(model.out.shape, 1e-6, np.float32)]
    for turn in range(rounds):
        flat = model.embed @ (model.out[:, 1] - model.out[:, 0])
        scores = np.add.reduceat(flat[bucket], starts[:-1]) / np.diff(starts)
        chosen: list[np.ndarray] = []
        marks: list[float] = []
        for own, label, odds in zip(ids, y, model.windows(ids, scores)):
            if turn < 2:  # nothing is known yet: windows at random
                take = rng.integers(0, len(odds), 24)
            elif label:
                take = np.argsort(-odds, kind="stable")[:1]
            else:
                take = np.concatenate([np.argsort(-odds, kind="stable")[:4], rng.integers(0, len(odds), 2)])
            chosen += [own[k * WINDOW : (k + 1) * WINDOW] for k in take.tolist()]
            marks += [label] * len(take)
        _steps(model, chosen, np.array(marks), bucket, starts, memory, rng, 0.3 * (1 - turn / rounds))
    flat = model.embed @ (model.out[:, 1] - model.out[:, 0])
    scores = np.add.reduceat(flat[bucket], starts[:-1]) / np.diff(starts)
    worst = np.array([w.max() for w in model.windows(ids, scores)])
    model.scale, model.shift = _calibrate(worst, y)
    model.fitted = True
    model.freeze()
    return model


def _steps(
    model: Model, windows: list[np.ndarray], y: np.ndarray, bucket: np.ndarray, starts: np.ndarray,
    memory: list[np.ndarray], rng: np.random.Generator, rate: float, batch: int = 256,
) -> None:
    """Gradient steps on windows; rates follow the squared gradients so far."""
    order = rng.permutation(len(windows))
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    for at in range(0, len(order), batch):
        take = order[at : at + batch]
        words = np.concatenate([windows[k] for k in take])
        window = np.repeat(np.arange(len(take)), [len(windows[k]) for k in take])
        sizes = starts[words + 1] - starts[words]
        word = np.repeat(np.arange(len(words)), sizes)
        places = np.repeat(starts[words] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        rows = bucket[places]
        share = 1 / (sizes[word] * np.bincount(window)[window[word]])
        hidden = np.zeros((len(take), DIM), np.float32)
        np.add.at(hidden, window[word], model.embed[rows] * share[:, None].astype(np.float32))
        logits = hidden @ model.out + model.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(take)), y[take].astype(int)] -= 1
        error = (p * weight[take, None] / len(take)).astype(np.float32)
        down = error @ model.out.T
        slope = hidden.T @ error
        memory[1] += slope**2
        model.out -= rate * slope / np.sqrt(memory[1])
        model.bias -= 0.05 * error.sum(axis=0)
        used, back = np.unique(rows, return_inverse=True)
        grad = np.zeros((len(used), DIM), np.float32)
        np.add.at(grad, back, down[window[word]] * share[:, None].astype(np.float32))
        memory[0][used] += (grad**2).mean(axis=1)
        model.embed[used] -= rate * grad / np.sqrt(memory[0][used])[:, None]


def _calibrate(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit of labels on log odds by damped Newton steps."""
    x = np.stack([np.clip(odds, -20, 20), np.ones(len(odds))], axis=1)
    pull = np.diag([0.1, 0.01])

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + (v - start) @ pull @ (v - start) / 2)

    start = at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -40, 40)))
        slope = x.T @ (p - y) + pull @ (at - start)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pull, slope)
        size = 1.0
        while size > 1e-4 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if abs(step).max() * size < 1e-6:
            break
    return float(max(at[0], 0.05)), float(at[1])


def sample(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE) -> DataFrame:
    """At most ``rows`` labelled texts of each label, by hash: ``(text, toxic)``.

    Labels with several values for an id, null ids and null labels are left out.
    """
    known = labels.filter(learn & F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("_id"), "toxic")
    known = known.groupBy("_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most"))
    known = known.filter("toxic = _most")
    order = [F.xxhash64("_id"), "_id"]
    picked = [known.filter(f"toxic = {k}").orderBy(*order).limit(rows).select("_id", "toxic") for k in (0, 1)]
    texts = docs.select("doc_id", "text").join(
        F.broadcast(picked[0].union(picked[1])), F.col("doc_id") == F.col("_id")
    )
    return texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")


def packed(rows: list[tuple[int, int, int]], limit: int) -> list[int]:
    """Ids of the ``(id, label, bytes)`` that fit into ``limit`` together, taken in order.

    The label with fewer bytes has half of it at most, the other what is left.  A
    text that does not fit is passed over, so it displaces no later one.
    """
    total: dict[int, int] = {}
    for _, label, size in rows:
        total[label] = total.get(label, 0) + size
    taken: list[int] = []
    for k, label in enumerate(sorted(total, key=lambda x: (total[x], x))):
        room = start = limit // (len(total) - k)
        for doc_id, own, size in rows:
            if own == label and size <= room:
                taken.append(doc_id)
                room -= size
        limit -= start - room
    return taken


def train(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE, size: int = SAMPLE_BYTES) -> Model:
    """Fit on the sample; of its texts, in hash order, what fits into ``size`` bytes."""
    chosen = sample(docs, labels, learn, rows)
    length = F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")
    sizes = chosen.select("doc_id", "toxic", length, F.xxhash64("doc_id").alias("hash")).collect()
    if sum(r["size"] for r in sizes) > size:
        ordered = sorted(sizes, key=lambda r: (r["hash"], r["doc_id"]))
        chosen = chosen.filter(F.col("doc_id").isin(packed([(r["doc_id"], r["toxic"], r["size"]) for r in ordered], size)))
    found = sorted(chosen.select("doc_id", "text", "toxic").collect(), key=lambda r: r["doc_id"])
    return fit([(r["text"] or "").encode() for r in found], [r["toxic"] for r in found])


def rate(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` per row; null and wordless texts get a low score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        return {"doc_id": batch.column("doc_id"), "score": shared.value.score(as_bytes(batch.column("text")))}

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(kept, "doc_id long, score double", each, sized_by="text")


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return crc_fold(doc_id, folds) == fold
