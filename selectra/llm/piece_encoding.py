"""Exact encoding under a merge-type sentencepiece vocabulary by backtracking, and its way back.

Merging joins, again and again, the neighbours whose joined piece scores best (the leftmost of equals). A sequence of
pieces is the result of merging exactly if each piece merges to itself and each two neighbours merge to themselves; so
the encoder never merges the text. It takes the longest piece at a place (Aho-Corasick), asks whether the piece before
would have stayed apart from it (merging just these two again; answers are kept), and otherwise tries the next shorter
piece. Where none fits, the place is marked in a bitfield and the piece before is taken back: only one sequence can end
at a place, so a marked place is never tried again.

No piece of such a vocabulary has the blank sign after another character. Texts are therefore cut before each run of
blanks, the parts are encoded alone, and a worker process keeps the ids of short parts (bounded, met again when emptied).

Cases: a null or empty text has no ids and decodes to an empty text; characters outside the vocabulary become the ids
of their bytes; the blank sign itself counts as a blank, as the library has it; ties, repeated rows and null ids are
rows like any others; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

BLANK = "▁"
#: answers and parts a worker keeps, and the longest part that is kept
KEPT, KEPT_CHARS = 500_000, 48
#: characters of a batch of texts after which its rows are handed on
BATCH_CHARS = 4_000_000


class PieceEncoder:
    """Pieces and ids of texts under one vocabulary."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        self.byte_ids = {int(self.model.id_to_piece(i)[1:-1], 16): i for i in ids if self.model.is_byte(i)}
        odd = {i for i in ids if self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i)}
        self.ids = {self.model.id_to_piece(i): i for i in ids if i not in odd}
        self.scores = {piece: self.model.get_score(i) for piece, i in self.ids.items()}
        if any(BLANK in piece.lstrip(BLANK) for piece in self.ids):
            raise ValueError("a piece has a blank after another character: texts can not be cut at blanks")
        whole = [piece for piece in self.ids if self.merge(piece) == [piece]]
        self.automaton = ahocorasick.Automaton()
        for piece in whole:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        known = set(whole)
        self.shorter = {piece: next((piece[:k] for k in range(len(piece) - 1, 0, -1) if piece[:k] in known), None)
                        for piece in whole}
        self.apart: dict[tuple[str, str], bool] = {}
        self.parts: dict[str, tuple[str, tuple[int, ...]]] = {}

    def merge(self, text: str) -> list[str]:
        """Pieces by merging; for short texts only."""
        symbols, score = list(text), self.scores.get
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging leaves the two neighbours as they are."""
        answer = self.apart.get((left, right))
        if answer is None:
            if len(self.apart) >= KEPT:
                self.apart.clear()
            answer = self.apart[left, right] = self.merge(left + right) == [left, right]
        return answer

    def pieces(self, part: str) -> list[str]:
        """The pieces of a part by backtracking."""
        longest = list(part)  # a character outside the vocabulary stands for itself
        for end, piece in self.automaton.iter(part):
            longest[end + 1 - len(piece)] = piece  # later ends are longer
        failed, shorter = bytearray(len(part) // 8 + 1), self.shorter.get
        out, place, piece = [], 0, longest[0] if part else None
        while place < len(part):
            end = place + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1 and (not out or self.compatible(out[-1], piece)):
                out.append(piece)
                place = end
                piece = longest[place] if place < len(part) else None
                continue
            piece = shorter(piece)
            while piece is None:
                failed[place >> 3] |= 1 << (place & 7)
                taken = out.pop()
                place -= len(taken)
                piece = shorter(taken)
        return out

    def _of_part(self, part: str) -> tuple[str, tuple[int, ...]]:
        ids: list[int] = []
        for piece in self.pieces(part):
            known = self.ids.get(piece)
            ids.extend([self.byte_ids[b] for b in piece.encode()] if known is None else [known])
        value = ",".join(map(str, ids)), tuple(ids)
        if len(part) <= KEPT_CHARS:
            if len(self.parts) >= KEPT:
                self.parts.clear()
            self.parts[part] = value
        return value

    def encode(self, text: str) -> list[tuple[str, tuple[int, ...]]]:
        """The ids of each part of the text, as text and as numbers."""
        if not text:
            return []
        known, of_part = self.parts.get, self._of_part
        return [known(part) or of_part(part) for part in _PARTS.findall(BLANK + text.replace(" ", BLANK))]

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


_PARTS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


@functools.cache
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, schema: pa.Schema, digest: bool):
    encoder = piece_encoder(path)
    out, chars = [], 0

    def flush():
        columns = list(zip(*out)) or [()] * len(schema)
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        out.clear()
        return batch

    for batch in batches:
        for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = value.as_py() or ""
            parts = encoder.encode(text)
            ids = list(itertools.chain.from_iterable(p[1] for p in parts))
            decoded = encoder.decode(ids) if ids else ""
            if digest:
                spelled = hashlib.sha256(",".join([p[0] for p in parts]).encode()).hexdigest()
                out.append((doc_id, len(ids), spelled, hashlib.sha256(decoded.encode()).hexdigest()))
            else:
                out.append((doc_id, ids, decoded))
            chars += len(text)
            if chars >= BATCH_CHARS:
                yield flush()
                chars = 0
    yield flush()


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """The ids of every whole text and the text they decode to. ``path`` is the vocabulary file on every executor."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    return _source(docs).mapInArrow(lambda b: _encoded(b, path, schema, False),
                                    "doc_id bigint, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """The same as counts and checksums, which are taken where the ids are made."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                        ("decoded_sha256", pa.string())])
    return _source(docs).mapInArrow(lambda b: _encoded(b, path, schema, True),
                                    "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
