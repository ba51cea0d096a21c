"""Edit-aware token counts: a segment tree of pre-tokens per document.

A text is split into pre-tokens by the tokenizer's pattern; each has a length and a number of tokens. The leaves of the
tree are runs of pre-tokens, its inner nodes sum characters and tokens. An edit finds its place from the root, splits and
encodes again from the pre-token before it up to the first boundary that the old split has as well (from there on the
pattern, which only looks ahead, splits as before), and updates the sums above the leaves it touched.

Cases: a null or empty text has a tree without tokens; edits are applied in order of their place and given in places of
the original text, an edit that starts inside an earlier one begins where that ends, places beyond the text are its end,
a null replacement is empty; ties go by length and replacement; repeated rows have trees of their own; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

#: pre-tokens of a leaf, distinct pre-tokens whose count a worker keeps
LEAF, KEPT = 64, 500_000
#: fixed value: the splitting pattern of the vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: the same for Python, whose \s has more characters
SPLIT = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
_SPACE = regex.compile(r"\p{White_Space}")
#: what the production query redacts: mail addresses, and runs of four digits or more
NUMBER = r"\d(?:[ -]?\d){3,}"
REDACTED = regex.compile(r"(?<![\w.+-])[\w.+-]{1,64}@[\w-]{1,64}(?:\.[\w-]{1,64})+|" + NUMBER)
NUMBERS = regex.compile(NUMBER)
_EDIT = "struct<start: int, length: int, replacement: string>"


class _Counts(dict):
    """Tokens of a pre-token; emptied at a bound."""

    def __init__(self, encoding: tiktoken.Encoding):
        super().__init__()
        self.encode = encoding.encode_ordinary

    def __missing__(self, piece: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        value = self[piece] = len(self.encode(piece))
        return value


@functools.cache
def counter(path: str) -> tuple[Callable[[str], list[str]], _Counts]:
    """The split into pre-tokens and the tokens of each, for a vocabulary file of ranks."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return SPLIT.findall, _Counts(encoding)


class CountTree:
    """Texts, lengths and token counts of the leaves, and sums of characters and tokens above them."""

    def __init__(self, text: str, split: Callable[[str], list[str]], counts: _Counts):
        self.split, self.counts, self.encoded = split, counts, 0
        pieces = split(text)
        lengths = list(map(len, pieces))
        tokens = list(map(counts.__getitem__, pieces))
        self.leaves: list[tuple[str, list[int], list[int]]] = []
        at = 0
        for i in range(0, len(pieces), LEAF):
            own = lengths[i:i + LEAF]
            self.leaves.append((text[at:at + sum(own)], own, tokens[i:i + LEAF]))
            at += sum(own)
        self.size = 1 << max(0, (max(1, len(self.leaves)) - 1).bit_length())
        if not self.leaves:
            self.leaves.append(("", [], []))
        self.chars, self.tokens = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        n = len(self.leaves)
        self.chars[self.size:self.size + n] = [len(x[0]) for x in self.leaves]
        self.tokens[self.size:self.size + n] = [sum(x[2]) for x in self.leaves]
        level = self.size
        while level > 1:
            for sums in (self.chars, self.tokens):
                sums[level // 2:level] = sums[level:2 * level:2] + sums[level + 1:2 * level:2]
            level //= 2

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def text(self) -> str:
        return "".join(x[0] for x in self.leaves)

    def _find(self, place: int) -> tuple[int, int]:
        """The leaf of a character and the characters before that leaf; the last filled leaf for the end."""
        node, before = 1, 0
        place = min(place, int(self.chars[1]) - 1)
        while node < self.size:
            node *= 2
            if place - before >= self.chars[node]:
                before += int(self.chars[node])
                node += 1
        return node - self.size, before

    def _piece(self, place: int) -> tuple[int, int, int, int]:
        """The pre-token of a character: its leaf, the characters before the leaf, its number there, its start."""
        leaf, at = self._find(place)
        begin, number, lengths = at, 0, self.leaves[leaf][1]
        while number < len(lengths) - 1 and begin + lengths[number] <= place:
            begin += lengths[number]
            number += 1
        return leaf, at, number, begin

    def _put(self, leaf: int, content: tuple[str, list[int], list[int]]) -> None:
        self.leaves[leaf] = content
        node = leaf + self.size
        self.chars[node], self.tokens[node] = len(content[0]), sum(content[2])
        node //= 2
        while node:
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            node //= 2

    def replace(self, start: int, length: int, replacement: str) -> None:
        whole = int(self.chars[1])
        start = min(max(start, 0), whole)
        end = min(start + max(length, 0), whole)
        if whole == 0:
            pieces = self.split(replacement)
            self.encoded += len(pieces)
            self._put(0, (replacement, [len(p) for p in pieces], [self.counts[p] for p in pieces]))
            return
        first, at, kept, begin = self._piece(max(start - 1, 0))
        # a run of white space is split by its end, so a run before that pre-token is context too
        while begin and _SPACE.match(self.leaves[(leaf := self._find(begin - 1))[0]][0][begin - 1 - leaf[1]]):
            first, at, kept, begin = self._piece(begin - 1)
        text, lengths, tokens = self.leaves[first]
        last, window, window_end = first, text[begin - at:], at + len(text)
        bounds = {begin: (first, kept)}
        self._add_bounds(bounds, first, at, kept)
        shift = len(replacement) - (end - start)
        while True:
            while window_end < min(end + 1, whole):
                last, window, window_end = self._widen(last, window, window_end, bounds)
            changed = window[:start - begin] + replacement + window[end - begin:]
            place, taken, met = begin, [], None
            for piece in self.split(changed):
                taken.append(piece)
                place += len(piece)
                # at the window's end the next character is unknown, unless the text ends there
                inside = place < begin + len(changed) or window_end == whole
                if place >= start + len(replacement) and inside and place - shift in bounds and place - shift >= end:
                    met = bounds[place - shift]
                    break
            if met or window_end == whole:
                break
            last, window, window_end = self._widen(last, window, window_end, bounds)
        self.encoded += len(taken)
        stop_leaf, stop = met or (last, len(self.leaves[last][1]))
        new = (text[:begin - at] + "".join(taken), lengths[:kept] + [len(p) for p in taken],
               tokens[:kept] + [self.counts[p] for p in taken])
        rest = self._after(stop_leaf, stop)
        if stop_leaf == first:
            self._put(first, tuple(x + y for x, y in zip(new, rest)))
        else:
            self._put(first, new)
            for leaf in range(first + 1, stop_leaf):
                self._put(leaf, ("", [], []))
            self._put(stop_leaf, rest)

    def _after(self, leaf: int, piece: int) -> tuple[str, list[int], list[int]]:
        text, lengths, tokens = self.leaves[leaf]
        return text[sum(lengths[:piece]):], lengths[piece:], tokens[piece:]

    def _add_bounds(self, bounds: dict[int, tuple[int, int]], leaf: int, at: int, kept: int = 0) -> None:
        lengths = self.leaves[leaf][1]
        place = at + sum(lengths[:kept])
        for i in range(kept, len(lengths)):
            place += lengths[i]
            bounds[place] = (leaf, i + 1)

    def _widen(self, last: int, window: str, window_end: int, bounds: dict) -> tuple[int, str, int]:
        self._add_bounds(bounds, last + 1, window_end)
        more = self.leaves[last + 1][0]
        return last + 1, window + more, window_end + len(more)

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Edits in places of the original text."""
        shift = done = 0
        for start, length, replacement in sorted(edits):
            end = max(start + max(length, 0), done)
            start = max(start, done)
            self.replace(start + shift, end - start, replacement)
            shift += len(replacement) - (end - start)
            done = end


def redactions(text: str | None) -> list[tuple[int, int, str]]:
    found = (REDACTED if "@" in (text or "") else NUMBERS).finditer(text or "")
    return [(m.start(), m.end() - m.start(), "<redacted>") for m in found]


def _edits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("replacement", pa.string())]))
    for batch in batches:
        edits = [[dict(zip(("start", "length", "replacement"), e)) for e in redactions(t.as_py())]
                 for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(edits, kind)], ["doc_id", "text", "edits"])


def with_redactions(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the edits that the production rule asks for."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_edits_of, f"doc_id bigint, text string, edits array<{_EDIT}>")


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """doc_id, text, and the edits of a table of (doc_id, start, length, replacement)."""
    listed = edits.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct(
        F.col("start").cast("int").alias("start"), F.col("length").cast("int").alias("length"),
        F.coalesce(F.col("replacement"), F.lit("")).alias("replacement")))).alias("edits"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(listed, "doc_id", "left").select("doc_id", "text", "edits")


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    split, counts = counter(path)
    for batch in batches:
        rows = []
        for doc_id, text, edits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            tree = CountTree(text.as_py() or "", split, counts)
            before, pieces = tree.total, sum(len(x[1]) for x in tree.leaves)
            edits = [(e["start"] or 0, e["length"] or 0, e["replacement"] or "") for e in edits or ()]
            tree.apply(edits)
            rows.append((doc_id, before, len(edits), tree.total, pieces, tree.encoded,
                         None if text.as_py() is None else tree.text()))
        kinds = [pa.int64()] * 6 + [pa.string()]
        names = ["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_pieces", "n_encoded_again", "edited"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds)], names)


def edited_counts(texts: DataFrame, vocabulary: str) -> DataFrame:
    """Per row of (doc_id, text, edits): tokens before and after the edits, pre-tokens at first, pre-tokens encoded
    again, and the edited text. ``vocabulary`` is the path of the rank file on every executor."""
    schema = ("doc_id bigint, n_tokens bigint, n_edits bigint, n_tokens_after bigint, n_pieces bigint, "
              "n_encoded_again bigint, edited string")
    return texts.mapInArrow(lambda b: _counted(b, vocabulary), schema)
