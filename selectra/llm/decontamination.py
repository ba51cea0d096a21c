"""Benchmark decontamination by the q-gram lemma: find passages within a budget of edits of a benchmark item.

An item of m characters that occurs with at most k edits keeps m - q + 1 - k * q of its q-grams, on diagonals at most k
apart. k is the stated share of m, and q the longest of 8, 4, 2 and 1 with which at least one q-gram is kept. So the shared q-grams of a text are counted in overlapping bands of diagonals, bands with fewer are dropped, and
the others are verified by a banded alignment that gives the edits and the ends. The items are taken in blocks of a
bounded size; each block goes to every executor and is searched in one narrow pass over the documents.

Texts are compared without case and with runs of white space as one space; ends are given in the original text.

Cases: null, empty or blank texts and items match nothing; items below 8 characters whose share is
no whole edit must occur as they are; repeated
items and repeated rows are reported each for itself; of overlapping places of one item the best counts, then the first;
long texts are searched in overlapping pieces; an empty table on either side gives no matches; other columns are kept.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: longest q-gram, a power of two
Q = 8
#: edits allowed, as a share of the item's characters
EDITS = 0.10
#: characters of the items of a block, and of the texts that are searched together
BLOCK_CHARS, PIECE_CHARS = 4_000_000, 500_000
_SLOTS = 24
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_MATCH = pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())])


@functools.cache
def _lower_case() -> np.ndarray:
    codes = [ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(0x2000)]
    return np.array([32 if chr(c).isspace() else low for c, low in enumerate(codes)], np.uint32)


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points with single spaces, and the place of each in the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes < 0x2000, _lower_case()[np.minimum(codes, 0x1FFF)], codes)
    space = codes == 32
    kept = np.flatnonzero(~(space & np.concatenate([[True], space[:-1]]))) if len(codes) else np.zeros(0, np.int64)
    if len(kept) and codes[kept[-1]] == 32:
        kept = kept[:-1]
    return codes[kept], kept


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """The 64-bit hash of the q-gram at each place; built up by doubling."""
    with np.errstate(over="ignore"):
        value, width = codes.astype(np.uint64), 1
        while width < q:
            mix = _MIX[width.bit_length() - 1]
            value = value[:-width] * mix + value[width:] if len(value) > width else value[:0]
            width *= 2
        return (value ^ (value >> np.uint64(31))) * _MIX[3]


class Index:
    """The q-grams of the items with one q: hashes in order, and the item and place of each."""

    def __init__(self, q: int, members: list[int], codes: list[np.ndarray]):
        self.q = q
        each = [grams(codes[i], q) for i in members]
        hashed, counts = np.concatenate(each), [len(g) for g in each]
        order = np.argsort(hashed, kind="stable")
        self.hashed, self.item = hashed[order], np.repeat(np.array(members, np.int64), counts)[order]
        self.place = np.concatenate([np.arange(n) for n in counts])[order]
        self.present = np.zeros(1 << _SLOTS, bool)
        self.present[(self.hashed >> np.uint64(64 - _SLOTS)).astype(np.int64)] = True


class Items:
    """A block of benchmark items, indexed by q-gram."""

    def __init__(self, items: list[tuple[int, str]], share: float = EDITS):
        self.ids, self.codes = [], []
        for item_id, text in items:
            codes, _ = normal(text)
            if len(codes):
                self.ids.append(item_id)
                self.codes.append(codes)
        self.length = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.minimum((self.length * share).astype(np.int64), np.maximum(self.length - 1, 0))
        q = np.ones(len(self.codes), np.int64)
        while True:  # twice as long while a q-gram is kept
            longer = (2 * q <= Q) & (self.length - 2 * q + 1 - self.edits * 2 * q >= 1)
            if not longer.any():
                break
            q[longer] *= 2
        self.least = self.length - q + 1 - self.edits * q
        exact = (self.length < Q) & (self.edits == 0)
        self.short = np.flatnonzero(exact).tolist()
        self.indexes = [Index(int(n), np.flatnonzero((q == n) & ~exact).tolist(), self.codes)
                        for n in np.unique(q[~exact])]

    def search(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """Per text the (item_id, start, end, edits) of its matches."""
        found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        if not self.ids:
            return found
        overlap, waiting, size = int(2 * self.length.max() + 2 * self.edits.max() + Q), [], 0
        for i, text in enumerate(texts):
            codes, places = normal(text or "")
            for at in range(0, max(1, len(codes)), PIECE_CHARS):
                piece = codes[at:at + PIECE_CHARS + overlap]
                waiting.append((i, piece, places[at:at + PIECE_CHARS + overlap]))
                size += len(piece)
            if size >= PIECE_CHARS:
                self._search(waiting, found)
                waiting, size = [], 0
        self._search(waiting, found)
        return [_best(matches) for matches in found]

    def _search(self, pieces: list[tuple[int, np.ndarray, np.ndarray]], found: list[list]) -> None:
        if not pieces:
            return
        gap = np.zeros(1, np.uint32)  # occurs in no item, so no q-gram crosses it
        joined = np.concatenate([part for _, codes, _ in pieces for part in (codes, gap)])
        starts = np.cumsum([0] + [len(codes) + 1 for _, codes, _ in pieces])
        for index in self.indexes:
            self._search_index(index, joined, starts, pieces, found)
        for x in self.short:
            wanted = self.codes[x].tobytes()
            for number, codes, places in pieces:
                raw, at = codes.tobytes(), -1
                while (at := raw.find(wanted, at + 1)) >= 0:
                    if at % 4 == 0:
                        found[number].append((self.ids[x], int(places[at // 4]),
                                              int(places[at // 4 + len(self.codes[x]) - 1]) + 1, 0))

    def _search_index(self, index: Index, joined: np.ndarray, starts: np.ndarray,
                      pieces: list[tuple[int, np.ndarray, np.ndarray]], found: list[list]) -> None:
        hashed = grams(joined, index.q)
        at = np.flatnonzero(index.present[(hashed >> np.uint64(64 - _SLOTS)).astype(np.int64)])
        low = np.searchsorted(index.hashed, hashed[at], "left")
        times = np.searchsorted(index.hashed, hashed[at], "right") - low
        at, low, times = at[times > 0], low[times > 0], times[times > 0]
        entry = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
        place, item = np.repeat(at, times), index.item[entry]
        piece = np.searchsorted(starts, place, "right") - 1
        diagonal = place - starts[piece] - index.place[entry] + self.length[item]
        step = self.edits[item] + 1
        band = diagonal // step
        span = int(band.max(initial=0)) + 2
        key = (piece * len(self.ids) + item) * span + band + 1
        # bands overlap by half: a hit counts in its own and in the one before
        keys, counts = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        owner = keys // span
        good = counts >= self.least[owner % len(self.ids)]
        keys, owner = keys[good], owner[good]
        first = 0
        for i in range(len(keys)):
            if i + 1 < len(keys) and owner[i + 1] == owner[i] and keys[i + 1] - keys[i] <= 1:
                continue
            p, x = divmod(int(owner[i]), len(self.ids))
            step = int(self.edits[x]) + 1
            low_band, high_band = int(keys[first] % span) - 1, int(keys[i] % span) - 1
            _, codes, places = pieces[p]
            place = self._verify(codes, x, low_band * step - int(self.length[x]),
                                 (high_band + 2) * step - int(self.length[x]))
            if place:
                found[pieces[p][0]].append((self.ids[x], int(places[place[0]]), int(places[place[1] - 1]) + 1, place[2]))
            first = i + 1

    def _verify(self, codes: np.ndarray, item: int, low: int, high: int) -> tuple[int, int, int] | None:
        """The best place of the item that starts between the diagonals, if it needs few enough edits."""
        wanted, budget = self.codes[item], int(self.edits[item])
        first = max(0, low)
        raw, exact = codes[first:high + len(wanted) + 1].tobytes(), wanted.tobytes()
        at = raw.find(exact)
        while at > 0 and at % 4:  # not at the start of a code
            at = raw.find(exact, at + 1)
        if at >= 0:  # no edits: nothing to align
            return first + at // 4, first + at // 4 + len(wanted), 0
        edits, end = align(wanted, codes, low - budget, high + budget)
        if edits > budget:
            return None
        back, start = align(wanted[::-1], codes[:end][::-1], 0, 2 * budget, anchored=True)
        return end - start, end, edits


def align(wanted: np.ndarray, text: np.ndarray, low: int, high: int, anchored: bool = False) -> tuple[int, int]:
    """Edits and end of the best match of all of ``wanted`` whose diagonals lie between low and high; it starts at any
    of them for nothing, or at the start of the text when anchored. Ties end first. Beyond its ends the text is thought
    to go on with a code that nothing equals, which costs what leaving out the wanted codes would."""
    if anchored:
        low = -high
    width = high - low + 1
    lanes = np.arange(width)
    begin = lanes + low
    row = np.where(begin >= 0, begin, len(wanted) + len(text) + 1) if anchored else np.zeros(width, np.int64)
    before, after = max(0, -low), max(0, high + len(wanted) - len(text))
    padded = np.concatenate([np.zeros(before, np.uint32), text, np.zeros(after, np.uint32)])
    for i, code in enumerate(wanted.tolist()):
        at = low + i + before
        step = row + (padded[at:at + width] != code)
        np.minimum(step[:-1], row[1:] + 1, out=step[:-1])
        row = np.minimum.accumulate(step - lanes) + lanes
    best = int(row.argmin())
    return int(row[best]), min(max(best + low + len(wanted), 0), len(text))


def _best(matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of overlapping places of one item only the best."""
    kept: list[tuple[int, int, int, int]] = []
    for match in sorted(set(matches), key=lambda m: (m[3], m[1], m[2], m[0])):
        if all(k[0] != match[0] or k[2] <= match[1] or match[2] <= k[1] for k in kept):
            kept.append(match)
    return sorted(kept)


def blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> list[list[tuple[int, str]]]:
    """The items, block by block, each block of at most about ``chars`` characters (or one longer item)."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")
                             ).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-2 * total // chars)) if total > chars else 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for i in range(count):
        yield [tuple(r) for r in items.where(part == i).orderBy("item_id", "text").collect()]


def mark(docs: DataFrame, benchmark: DataFrame, share: float = EDITS) -> DataFrame:
    """The rows of ``docs`` with _leaks: the matches (item_id, start, end, edits) in their texts."""
    context = docs.sparkSession.sparkContext
    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    kind = "array<struct<item_id: bigint, start: bigint, `end`: bigint, edits: bigint>>"
    text = docs.columns.index("text")
    out = docs
    for number, block in enumerate(blocks(benchmark)):
        shared = context.broadcast(block)

        def searched(batches: Iterator[pa.RecordBatch], shared=shared, more=number > 0) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value, share)
            for batch in batches:
                found = []
                for i in range(0, batch.num_rows, 256):
                    found += items.search(batch.column(text)[i:i + 256].to_pylist())
                columns, names = batch.columns, batch.schema.names
                if more:
                    before = [[tuple(m.values()) for m in x] for x in columns[-1].to_pylist()]
                    found = [a + b for a, b in zip(before, found)]
                    columns, names = columns[:-1], names[:-1]
                matches = [[dict(zip(("item_id", "start", "end", "edits"), m)) for m in x] for x in found]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(matches, pa.list_(_MATCH))], [*names, "_leaks"])

        out = out.mapInArrow(searched, f"{carried}, _leaks {kind}")
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = EDITS) -> DataFrame:
    """One row per passage of a document that matches a benchmark item."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mark(texts, benchmark, share).select("doc_id", F.explode("_leaks").alias("m")).select("doc_id", "m.*")
