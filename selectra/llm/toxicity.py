"""Toxicity: a convolutional text classifier trained in numpy.

Words are hashed into an embedding table; filters of several widths slide over the whole text, the maximum of each
filter over all positions feeds a logistic output. The fit takes a bounded sample of labelled rows; one part of it is
set aside to calibrate a rejection threshold per language. The score itself sees the text alone.

Cases: a null or empty text is one padding word and gets the score of its bias; a null id belongs to the training fold
but has no label; labels given twice count as toxic if one of them is; without labelled rows of both classes nothing is
learned, every score is 0 and nothing is rejected; a missing or unseen language has the common threshold; repeated rows
are scored each for itself; long texts are scored in overlapping segments whose maxima are joined, never cut; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

#: the fit takes at most so many labelled rows (those with the smallest hashes), every fifth of them for calibration
FIT_ROWS = 16_000
BUCKETS, WIDTH_OF_WORD, FILTERS, WIDTHS = 1 << 19, 8, 12, (1, 2, 3)
EPOCHS, BATCH, RATE = 8, 64, 0.1
SEGMENT = 1 << 14
DECISION = 0.3
#: thresholds by language stay in this range, whatever few calibration rows say
CUTS = (0.15, 0.85)
_EDGES = b".,;:!?\"'()[]"


class _Buckets(dict):
    """Bucket of a word; bucket 0 is padding. Emptied at a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = xxhash.xxh32_intdigest(word.strip(_EDGES)) % (BUCKETS - 1) + 1
        return value


_buckets = _Buckets()


def word_buckets(text: str | None) -> np.ndarray:
    words = (text or "").encode().lower().split()
    return np.fromiter(map(_buckets.__getitem__, words), np.int32, len(words)) if words else np.zeros(1, np.int32)


@dataclass
class Convolution:
    """Embeddings, filters (one matrix for all widths and offsets), output weights, thresholds by language."""

    words: np.ndarray
    filters: np.ndarray
    output: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    common: float = DECISION

    @staticmethod
    def start() -> Convolution:
        draw = np.random.default_rng(7)
        taps = sum(WIDTHS)
        return Convolution(draw.normal(0, 0.05, (BUCKETS, WIDTH_OF_WORD)).astype(np.float32),
                           draw.normal(0, 0.3, (WIDTH_OF_WORD, taps * FILTERS)).astype(np.float32),
                           draw.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), 0.0)

    def responses(self, ids: np.ndarray) -> np.ndarray:
        """Every filter at every position of ids that end in max(WIDTHS) - 1 words beyond the last position."""
        n, tap = len(ids) - max(WIDTHS) + 1, 0
        flat = self.words[ids] @ self.filters
        out = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
        for k, width in enumerate(WIDTHS):
            block = out[:, k * FILTERS:(k + 1) * FILTERS]
            for j in range(width):
                column = flat[j:j + n, tap * FILTERS:(tap + 1) * FILTERS]
                block[:] = column if j == 0 else block + column
                tap += 1
        return out

    def scores(self, documents: list[np.ndarray]) -> np.ndarray:
        segments, owner = [], []
        for i, ids in enumerate(documents):
            for s in segment(ids):
                segments.append(s)
                owner.append(i)
        pooled = np.full((len(documents), len(self.output)), -np.inf, np.float32)
        at, tail = 0, max(WIDTHS) - 1
        while at < len(segments):  # segments are joined up to a bounded number of words
            until, words = at, 0
            while until < len(segments) and (words == 0 or words + len(segments[until]) <= 2 * SEGMENT):
                words += len(segments[until])
                until += 1
            starts = np.cumsum([0, *map(len, segments[at:until])])
            cuts = np.column_stack([starts[:-1], starts[1:] - tail]).ravel()
            response = self.responses(np.concatenate([*segments[at:until], np.zeros(tail, np.int32)]))
            np.maximum.at(pooled, owner[at:until], np.maximum.reduceat(response, cuts)[::2])
            at = until
        return 1 / (1 + np.exp(-np.clip(pooled @ self.output + self.bias, -30, 30).astype(np.float64)))


def segment(ids: np.ndarray) -> list[np.ndarray]:
    """Overlapping pieces; every position of the text starts a window in exactly one of them."""
    tail = max(WIDTHS) - 1
    padded = np.concatenate([ids, np.zeros(tail, np.int32)])
    return [padded[i:i + SEGMENT + tail] for i in range(0, len(ids), SEGMENT)]


def _step(model: Convolution, documents: list[np.ndarray], labels: np.ndarray, memory: dict[str, np.ndarray]) -> None:
    """One adaptive gradient step on a batch; only the positions of the maxima have a gradient."""
    tail, count = max(WIDTHS) - 1, len(model.output)
    ids = np.concatenate([np.concatenate([d, np.zeros(tail, np.int32)]) for d in documents] + [np.zeros(tail, np.int32)])
    starts = np.cumsum([0] + [len(d) + tail for d in documents])
    response = model.responses(ids)
    at = np.stack([s + response[s:s + len(d)].argmax(0) for s, d in zip(starts, documents)])
    pooled = response[at, np.arange(count)]
    error = 1 / (1 + np.exp(-(pooled @ model.output + model.bias))) - labels
    error = (error / len(documents)).astype(np.float32)
    back = error[:, None] * model.output[None, :]
    filters, rows, changes, tap = np.zeros_like(model.filters), [], [], 0
    for k, width in enumerate(WIDTHS):
        own = slice(k * FILTERS, (k + 1) * FILTERS)
        for j in range(width):
            columns = slice(tap * FILTERS, (tap + 1) * FILTERS)
            hit = ids[at[:, own] + j]
            filters[:, columns] = np.einsum("bf,bfd->df", back[:, own], model.words[hit])
            rows.append(hit.ravel())
            changes.append((back[:, own, None] * model.filters[:, columns].T[None]).reshape(-1, WIDTH_OF_WORD))
            tap += 1
    touched, where = np.unique(np.concatenate(rows), return_inverse=True)
    change = np.zeros((len(touched), WIDTH_OF_WORD), np.float32)
    np.add.at(change, where, np.concatenate(changes))
    memory["words"][touched] += (change ** 2).mean(1)
    model.words[touched] -= RATE * change / np.sqrt(memory["words"][touched] + 1e-8)[:, None]
    model.words[0] = 0
    for name, change in (("filters", filters), ("output", error @ pooled)):
        memory[name] += change ** 2
        getattr(model, name)[...] -= 0.5 * RATE * change / np.sqrt(memory[name] + 1e-8)
    model.bias -= RATE * float(error.sum())


def fit(documents: list[np.ndarray], labels: np.ndarray, languages: list[str]) -> Convolution | None:
    """The model from hashed texts; every fifth row calibrates the thresholds instead."""
    held = np.arange(len(labels)) % 5 == 4
    if len(np.unique(labels[~held])) < 2:
        return None
    model, draw = Convolution.start(), np.random.default_rng(11)
    share = labels[~held].mean()
    model.bias = float(np.log(share / (1 - share)))
    memory = {"words": np.zeros(BUCKETS, np.float32), "filters": np.zeros_like(model.filters),
              "output": np.zeros_like(model.output)}
    train = np.flatnonzero(~held)
    for _ in range(EPOCHS):
        draw.shuffle(train)
        for i in range(0, len(train), BATCH):
            batch = train[i:i + BATCH]
            # a long training text is seen through one segment at a time, another one in each epoch
            pieces = [segment(documents[i]) if len(documents[i]) > SEGMENT else [documents[i]] for i in batch]
            seen = [p[draw.integers(len(p))] for p in pieces]
            _step(model, seen, labels[batch], memory)
    model.words[memory["words"] == 0] = 0  # words never learned from are neutral
    check = np.flatnonzero(held)
    scores = model.scores([documents[i] for i in check]) if len(check) else np.zeros(0)
    model.common = _threshold(scores, labels[check], DECISION)
    for language in {languages[i] for i in check} - {None}:
        own = np.array([languages[i] == language for i in check])
        model.thresholds[language] = _threshold(scores[own], labels[check][own], model.common)
    return model


def _threshold(scores: np.ndarray, labels: np.ndarray, otherwise: float, least: int = 10) -> float:
    """The cut with the best F1 among the calibration rows, in the middle of its gap; needs some of both classes."""
    if labels.sum() < least or (1 - labels).sum() < least:
        return otherwise
    order = np.argsort(-scores, kind="stable")
    found = np.cumsum(labels[order])
    f1 = 2 * found / (np.arange(1, len(order) + 1) + labels.sum())
    best = int(f1.argmax())
    below = scores[order[best + 1]] if best + 1 < len(order) else 0.0
    return float(np.clip((scores[order[best]] + below) / 2, *CUTS))


def fold(parts: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo the parts."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = pa.array([word_buckets(t.as_py()).tobytes() for t in batch.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], ["toxic", "lang", "words"])


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Convolution | None:
    """Fit on at most ``rows`` labelled documents outside fold 2 of 4; their hashed words go to the driver."""
    marked = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .where(F.col("toxic").isNotNull() & (fold(4) != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    # at most FIT_ROWS ids go to the tasks, so that no text is shuffled to find the sample
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                        F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min(F.struct("toxic", "lang", "text")).alias("row")).select("doc_id", "row.*")
    hashed = (sample.select("toxic", "lang", "text").mapInArrow(_hashed, "toxic int, lang string, words binary")
              .toArrow().to_pydict())
    if not hashed["toxic"]:
        return None
    order = sorted(range(len(hashed["toxic"])), key=lambda i: xxhash.xxh64_intdigest(hashed["words"][i]))
    documents = [np.frombuffer(hashed["words"][i], np.int32) for i in order]
    return fit(documents, np.array([hashed["toxic"][i] for i in order], np.float32), [hashed["lang"][i] for i in order])


def score(docs: DataFrame, model: Convolution | None) -> DataFrame:
    """The rows of ``docs`` with _score (0 to 1) and _rejected (by the threshold of the language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: the tables of the model
    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = [docs.columns.index(c) for c in ("text", "lang")]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        for batch in batches:
            texts, languages = batch.column(at[0]), batch.column(at[1]).to_pylist()
            parts = [np.zeros(0)]
            for i in range(0, len(texts), 256):
                hashed = [word_buckets(t.as_py()) for t in texts[i:i + 256]]
                parts.append(np.zeros(len(hashed)) if learned is None else learned.scores(hashed))
            values = np.concatenate(parts)
            cuts = np.array([2.0 if learned is None else learned.thresholds.get(x, learned.common) for x in languages])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values), pa.array(values >= cuts)],
                                             [*batch.schema.names, "_score", "_rejected"])

    return docs.mapInArrow(scored, f"{carried}, _score double, _rejected boolean")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: whether it was held out, its score, the decision at 0.3 and that of its language's threshold."""
    columns = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                          F.col("text").cast("string").alias("text"))
    return score(columns, train(docs, labels)).select(
        "doc_id", (fold(4) == 2).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= DECISION).cast("int").alias("predicted"), F.col("_rejected").alias("rejected"))
