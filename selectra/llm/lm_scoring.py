"""Language-model scoring by online logistic context mixing.

Short words tell languages and kinds of text apart: how often they follow each other gives a few classes. All training
documents are counted as (gate, word) pairs, the gate being the likeliest class of the last short words. All pairs fill
the tables of the bit predictors, whose size follows the number of pairs: tasks count their pairs by slot, the counts
are summed by blocks of slots, and only the summed tables are sent. The mixing weights and the adaptive map are learned
online by every task over its share of all pairs, and averaged. A document's score is the sum over its words and its
end, so a worker evaluates a pair once and looks it up afterwards.

The word counts also give a base score. Frequent words, a bounded number, go to every task; the words of a document
beyond them are joined with the table of all counts.

Cases: a null or empty text is the end alone; a null id belongs to the fold of the empty text; without training
documents every count is 0 and the model is uniform; very long words and texts are scored whole; repeated rows are
scored each for itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from selectra.llm.context_mixing import END, GATES, MAP_CELLS, ORDERS, PLACES, SLOTS, Mixer, levels, refine
from selectra.session import materialise

#: frequent words sent to every task; slots of a predictor for each pair at least; slots of a summed block
HEAD_WORDS, SLOTS_PER_PAIR, BLOCK = 1 << 20, 2, 1 << 14
#: pairs whose counts by slot are sent together, and of these the pairs that are spelled at once
TALLIED, SPELLED = 100_000, 20_000
#: words that a worker keeps values of; bytes of a short word, buckets of short words, and how many set the gate
KEPT_WORDS, SHORT, SHORT_BUCKETS, MEMORY = 400_000, 3, 256, 6
RATE, SMOOTH = 0.3, 0.1


def fold() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10


def classes_of(together: np.ndarray, count: int = GATES - 1, rounds: int = 200) -> np.ndarray:
    """Log likelihood of each short-word bucket in each class, from how often two follow each other.

    Two short words in a row are drawn from one class; expectation and maximisation find the classes (languages, kinds
    of text) that explain the table. A row per bucket, relative to the mean of the classes."""
    pairs = together + together.T
    draw = np.random.default_rng(3)
    share, within = np.full(count, 1 / count), draw.dirichlet(np.ones(len(pairs)), count) + 1 / len(pairs)
    within /= within.sum(1, keepdims=True)
    for _ in range(rounds if pairs.sum() else 0):
        joint = share[:, None, None] * within[:, :, None] * within[:, None, :]
        part = joint * (pairs / np.maximum(joint.sum(0), 1e-300))
        share = part.sum((1, 2))
        within = (part.sum(2) + 0.5) / (share[:, None] + 0.5 * len(pairs))
        share = (share + 1) / (share + 1).sum()
    logs = np.log(within)
    return (logs - logs.mean(0)).T


class Vocabulary(dict):
    """Numbers for words in order of appearance, and the bucket of each short word (-1: it is not short)."""

    def __init__(self, classes: np.ndarray | None = None):
        super().__init__()
        self.classes = classes
        self.words: list[bytes] = []
        self.buckets: list[int] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        self.buckets.append(xxhash.xxh32_intdigest(word) % SHORT_BUCKETS if len(word) <= SHORT and word != END else -1)
        return number

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of all tokens, where each text begins, and the places of the short words."""
        numbers, starts = [], [0]
        for text in texts:
            words = (text or "").encode().lower().split()
            numbers.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
            numbers.append(np.array([self[END]], np.int64))
            starts.append(starts[-1] + len(words) + 1)
        token = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        short = np.flatnonzero(np.array(self.buckets, np.int64)[token] >= 0) if len(token) else token
        return token, np.array(starts[:-1], np.int64), short

    def together(self, texts: list[str | None]) -> np.ndarray:
        """How often a short word of each bucket is followed by one of each."""
        token, begins, short = self.tokens(texts)
        text = np.searchsorted(begins, short, "right")
        bucket = np.array(self.buckets, np.int64)[token[short]]
        same = text[1:] == text[:-1]
        flat = bucket[:-1][same] * SHORT_BUCKETS + bucket[1:][same]
        return np.bincount(flat, minlength=SHORT_BUCKETS ** 2)

    def pairs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word * GATES + gate of every token, and where each text begins. The gate is the likeliest class of the last
        short words before the token in its text, 0 if there are none."""
        token, begins, short = self.tokens(texts)
        if not len(short):
            return token * GATES, begins
        likely = self.classes[np.array(self.buckets, np.int64)[token[short]]]
        total = np.concatenate([np.zeros((1, likely.shape[1])), np.cumsum(likely, 0)])
        text = np.searchsorted(begins, short, "right") - 1
        opens = np.searchsorted(short, begins)[text]  # the first short word of the same text
        after = np.arange(len(short)) + 1
        gate = (total[after] - total[np.maximum(after - MEMORY, opens)]).argmax(1) + 1
        before = np.searchsorted(short, np.arange(len(token))) - 1
        owner = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(token))))
        good = (before >= 0) & (text[np.maximum(before, 0)] == owner)
        return token * GATES + np.where(good, gate[np.maximum(before, 0)], 0), begins


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocabulary, counts = Vocabulary(), np.zeros(SHORT_BUCKETS ** 2, np.int64)
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            counts += vocabulary.together(batch.column(0)[i:i + 512].to_pylist())
            if len(vocabulary.words) > 2 * KEPT_WORDS:
                vocabulary = Vocabulary()
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["cell", "n"])


def _counted(batches: Iterator[pa.RecordBatch], classes: np.ndarray) -> Iterator[pa.RecordBatch]:
    vocabulary, counts = Vocabulary(classes), np.zeros(0, np.int64)

    def flush():
        used = np.flatnonzero(counts)
        words = pa.array([vocabulary.words[i] for i in (used // GATES).tolist()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array((used % GATES).astype(np.int32)), words, pa.array(counts[used])],
                                          ["gate", "word", "n"])

    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            pairs, _ = vocabulary.pairs(batch.column(0)[i:i + 512].to_pylist())
            more = np.bincount(pairs, minlength=len(vocabulary.words) * GATES)
            more[:len(counts)] += counts
            counts = more
            if len(vocabulary.words) > 2 * KEPT_WORDS:
                yield flush()
                vocabulary, counts = Vocabulary(classes), np.zeros(0, np.int64)
    yield flush()


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each byte is written, by counted words; a blank after each."""
    counts = np.zeros(256, np.int64)
    for batch in batches:
        words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        data = np.frombuffer(b"".join(words), np.uint8)
        each = np.repeat(n, np.fromiter(map(len, words), np.int64, len(words)))
        counts += np.bincount(data, each, 256).astype(np.int64)
        counts[32] += n.sum()
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(counts)], ["byte", "n"])


_PACKER = pa.Codec("zstd", 1)


def _packed(slots: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising slots of a block and (unset, set) counts by planes of bytes, compressed: most counts are small."""
    planes = [np.diff(slots, prepend=0).astype(np.uint16).view(np.uint8).reshape(-1, 2).T,
              *(c.astype(np.int64).view(np.uint8).reshape(-1, 8).T for c in counts)]
    return _PACKER.compress(b"".join(x.tobytes() for x in planes), asbytes=True)


def _unpacked(packed: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(_PACKER.decompress(packed, 18 * n, asbytes=True), np.uint8).reshape(18, n)
    slots, unset, ones = (np.ascontiguousarray(x.T).view(kind).ravel()
                          for x, kind in ((planes[:2], np.uint16), (planes[2:10], np.int64), (planes[10:], np.int64)))
    return np.cumsum(slots, dtype=np.int64), np.stack([unset, ones])


def tallied(mixer: Mixer, words: list[bytes], gates: np.ndarray, times: np.ndarray
            ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``Mixer.tallies``, holding the single bits of ``SPELLED`` pairs only."""
    parts = [list(mixer.tallies(words[i:i + SPELLED], gates[i:i + SPELLED], times[i:i + SPELLED]))
             for i in range(0, len(words), SPELLED)]
    for k in range(len(ORDERS)):
        slots = np.concatenate([p[k][0] for p in parts])
        counts = np.concatenate([p[k][1] for p in parts], 1)
        for p in parts:
            p[k] = None
        slot, at = np.unique(slots, return_inverse=True)
        yield slot, np.stack([np.bincount(at, c, len(slot)) for c in counts])


def _slotted(batches: Iterator[pa.RecordBatch], mixer: Mixer) -> Iterator[pa.RecordBatch]:
    """Counts of (unset, set) bits by slot, in blocks of slots of a predictor."""
    words, gates, times = [], [], []

    def flush():
        order = sorted(range(len(words)), key=words.__getitem__)  # neighbours share their first steps
        found = tallied(mixer, [words[i] for i in order], np.concatenate(gates)[order],
                        np.concatenate(times)[order].astype(np.float64))
        for k, (slot, counts) in enumerate(found):
            block, first = np.unique(slot // BLOCK, return_index=True)
            parts = np.append(first, len(slot))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(block), k, np.int32)), pa.array(block.astype(np.int32)),
                 pa.array(np.diff(parts).astype(np.int32)),
                 pa.array([_packed(slot[i:j] % BLOCK, counts[:, i:j]) for i, j in zip(parts, parts[1:])], pa.binary())],
                ["predictor", "block", "n", "packed"])

    for batch in batches:
        words += batch.column(1).to_pylist()
        gates.append(batch.column(0).to_numpy())
        times.append(batch.column(2).to_numpy())
        if len(words) >= TALLIED:
            yield from flush()
            words, gates, times = [], [], []
    if words:
        yield from flush()


def _summed(block: pa.Table) -> pa.Table:
    total = np.zeros((2, BLOCK), np.int64)
    for n, packed in zip(block.column("n").to_pylist(), block.column("packed").to_pylist()):
        slots, counts = _unpacked(packed, n)
        total[:, slots] += counts
    unset, ones = levels(total)
    return pa.table({"predictor": block.column("predictor")[:1], "block": block.column("block")[:1],
                     "unset": pa.array([unset.tobytes()], pa.binary()), "ones": pa.array([ones.tobytes()], pa.binary())})


def _weighed(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    mixer, seen, mass = shared.value, np.zeros((2, PLACES * MAP_CELLS)), 0.0
    mixer.weights = mixer.weights.copy()
    for batch in batches:
        gates, words, n = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
        for i in range(0, len(n), 20_000):
            part = slice(i, i + 20_000)
            mixer.train(words[part].to_pylist(), gates[part], n[part], seen, RATE)
            mass += float(n[part].sum())
    if mass:
        yield pa.RecordBatch.from_arrays([pa.array([mass]), pa.array([mixer.weights.ravel().tolist()]),
                                          pa.array([seen.ravel().tolist()])], ["mass", "weights", "seen"])


def _at_most(counted: DataFrame, bound: int) -> int:
    """The smallest count such that at most ``bound`` rows have it or more."""
    level = F.floor(F.log2("n") * 16).cast("int")
    rows = sorted(((r[0], r[1]) for r in counted.groupBy(level.alias("l")).agg(F.count("*")).collect()), reverse=True)
    total, least = 0, None
    for at, n in rows:  # a level is a sixteenth of a doubling: few rows, whatever the corpus
        if total + n > bound:
            break
        total, least = total + n, at
    return (1 << 62) if least is None else int(np.ceil(2 ** (least / 16) - 1e-9))


def learn(docs: DataFrame) -> tuple[DataFrame, Mixer, np.ndarray]:
    """Word counts of all training documents, the model, and the classes of short words."""
    texts = docs.where(fold() != 0).select(F.col("text").cast("string").alias("text"))
    cells = (texts.mapInArrow(_together, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
             .toArrow())  # at most the square of the buckets
    together = np.zeros(SHORT_BUCKETS ** 2)
    together[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    classes = classes_of(together.reshape(SHORT_BUCKETS, SHORT_BUCKETS))
    pairs = materialise(texts.mapInArrow(lambda b: _counted(b, classes), "gate int, word binary, n bigint")
                        .groupBy("gate", "word").agg(F.sum("n").alias("n")))
    words = materialise(pairs.groupBy("word").agg(F.sum("n").alias("n")))
    counts = np.zeros(256)
    for r in words.mapInArrow(_spelled, "byte int, n bigint").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        counts[r["byte"]] = r["n"]
    distinct = pairs.count()
    bits = max(SLOTS, int(np.ceil(np.log2(max(distinct, 1) * SLOTS_PER_PAIR))))
    mixer = Mixer.start(counts, bits)
    if distinct:
        tables = pairs.mapInArrow(lambda b: _slotted(b, Mixer.start(counts, bits)),
                                  "predictor int, block int, n int, packed binary")
        for r in tables.groupBy("predictor", "block").applyInArrow(
                _summed, "predictor int, block int, unset binary, ones binary").toLocalIterator():
            at = slice(r["block"] * BLOCK, (r["block"] + 1) * BLOCK)
            for bit in (0, 1):
                mixer.counted[bit, r["predictor"], at] = np.frombuffer(r[("unset", "ones")[bit]], np.uint8)
        shared = docs.sparkSession.sparkContext.broadcast(mixer)  # the summed tables: some bytes a pair
        width = len(mixer.weights.ravel())
        tasks = pairs.mapInArrow(lambda b: _weighed(b, shared), "mass double, weights array<double>, seen array<double>")
        summed = tasks.select("mass", F.posexplode(F.concat(F.transform("weights", lambda w: w * F.col("mass")), "seen"))
                              ).groupBy("pos").agg(F.sum("col").alias("v"), F.sum("mass").alias("mass")).collect()
        shared.destroy()  # every executor and the driver hold it on their disks
        values = np.zeros(len(summed))
        for r in summed:
            values[r["pos"]] = r["v"] / r["mass"] if r["pos"] < width else r["v"]
        mixer.weights = values[:width].reshape(mixer.weights.shape)
        refine(mixer, values[width:].reshape(2, -1))
    return words, mixer, classes


class _Scorer:
    """Values of words met by a task: their count among the frequent ones, and their score after each gate."""

    def __init__(self, mixer: Mixer, classes: np.ndarray, hashes: np.ndarray, counts: np.ndarray):
        self.mixer, self.classes, self.hashes, self.counts = mixer, classes, hashes, counts
        self.reset()

    def reset(self):
        self.vocabulary = Vocabulary(self.classes)
        self.scores = np.zeros((0, GATES))
        self.head = np.zeros(0)

    def batch(self, texts: list[str | None]):
        if len(self.vocabulary.words) > KEPT_WORDS:
            self.reset()
        pairs, begins = self.vocabulary.pairs(texts)
        new = self.vocabulary.words[len(self.head):]
        if new:
            hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in new], np.uint64)
            at = np.minimum(np.searchsorted(self.hashes, hashed), max(len(self.hashes) - 1, 0))
            found = self.hashes[at] == hashed if len(self.hashes) else np.zeros(len(new), bool)
            self.head = np.concatenate([self.head, np.where(found, self.counts[at] if len(self.counts) else 0, -1)])
            self.scores = np.concatenate([self.scores, np.full((len(new), GATES), np.nan)])
        flat = self.scores.ravel()
        needed = np.unique(pairs)
        needed = needed[np.isnan(flat[needed])]
        for i in range(0, len(needed), 20_000):
            part = needed[i:i + 20_000]
            flat[part] = self.mixer.log10([self.vocabulary.words[w] for w in (part // GATES).tolist()], part % GATES)
        token = pairs // GATES
        count = self.head[token]
        total = np.add.reduceat(flat[pairs], begins)
        logs = np.add.reduceat(np.where(count >= 0, np.log10(np.maximum(count, 0) + SMOOTH), 0.0), begins)
        known = np.add.reduceat((count > 0).astype(np.int64), begins)
        size = np.diff(np.append(begins, len(pairs)))
        rare = []
        for at, n in zip(begins.tolist(), size.tolist()):
            own = token[at:at + n]
            rare.append([self.vocabulary.words[w] for w in own[count[at:at + n] < 0].tolist()])
        return total, logs, known, size, rare


def _scored(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    scorer = _Scorer(*shared.value)
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            ids = batch.column(0)[i:i + 256]
            total, logs, known, size, rare = scorer.batch(batch.column(1)[i:i + 256].to_pylist())
            rows = pa.array(np.arange(number, number + len(size)))
            number += len(size)
            yield pa.RecordBatch.from_arrays(
                [rows, ids, pa.array(total), pa.array(logs), pa.array(known), pa.array(size.astype(np.int64)),
                 pa.array(rare, pa.list_(pa.binary()))],
                ["row", "doc_id", "score", "logs", "known", "n_tokens", "rare"])


def score(docs: DataFrame) -> DataFrame:
    """Per document: fold, token counts, the base score from word counts and the model's score (both log10)."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words, mixer, classes = learn(source)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    head = words.where(F.col("n") >= _at_most(words, HEAD_WORDS)).toArrow()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in head.column("word").to_pylist()], np.uint64)
    order = np.argsort(hashes)
    counts = head.column("n").to_numpy().astype(np.float64)[order]
    shared = docs.sparkSession.sparkContext.broadcast((mixer, classes, hashes[order], counts))  # at most HEAD_WORDS entries
    scored = materialise(source.mapInArrow(
        lambda b: _scored(b, shared), "row bigint, doc_id bigint, score double, logs double, known bigint, "
                                      "n_tokens bigint, rare array<binary>"))
    shared.destroy()  # the scores are kept, so it is not read again
    rare = scored.select("row", F.explode("rare").alias("word")).join(words, "word", "left")
    joined = rare.groupBy("row").agg(
        F.sum(F.log10(F.coalesce(F.col("n"), F.lit(0)) + SMOOTH)).alias("more_logs"),
        F.count("n").alias("more_known"))
    norm = float(np.log10(total["n"] + SMOOTH * (total["v"] + 1)))
    return scored.drop("rare").join(joined, "row", "left").select(
        "doc_id", (fold() == 0).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(total["n"])).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        "score")
