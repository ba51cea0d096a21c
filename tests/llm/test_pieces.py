"""Piece encoding against the library itself: planted cases, edge cases and random texts."""

import hashlib
import random

import public_tokenizers
from hypothesis import given, settings, strategies as st

from selectra.llm import piece_encoding
from tests.conftest import SMALL
from tests.llm.conftest import ROWS

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def ids(encoder, text):
    return [i for _, numbers in encoder.encode(text) for i in numbers]


def expected(model, doc_id, text):
    wanted = model.encode(text or "")
    spelled = ",".join(map(str, wanted)).encode()
    return (doc_id, len(wanted), hashlib.sha256(spelled).hexdigest(),
            hashlib.sha256((model.decode(wanted) if wanted else "").encode()).hexdigest())


def test_documents_equal_the_library(spark, docs, nothing):
    model = piece_encoding.piece_encoder(VOCABULARY).model
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(r) for r in piece_encoding.digest_documents(docs, VOCABULARY).collect()), key=key)
    assert got == sorted((expected(model, r[0], r[1]) for r in ROWS), key=key)
    assert piece_encoding.digest_documents(nothing, VOCABULARY).count() == 0
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {tuple(r) for r in piece_encoding.digest_documents(table, VOCABULARY).collect()}
    assert got == {expected(model, r.doc_id, r.text) for r in table.collect()}


def test_ids_and_texts_are_returned(spark):
    rows = spark.createDataFrame([(1, "two  words "), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in piece_encoding.encode_documents(rows, VOCABULARY).collect()}
    model = piece_encoding.piece_encoder(VOCABULARY).model
    assert got[1].ids == model.encode("two  words ") and got[1].decoded == "two  words "
    assert got[2].ids == [] and got[2].decoded == ""


def test_long_texts_and_runs():
    encoder = piece_encoding.piece_encoder(VOCABULARY)
    for text in (" " * 30_001, "a" * 20_000, "ab" * 10_000, "▁" * 7 + "x", "é" * 3000 + "中" * 3000 + "😀" * 3000):
        assert ids(encoder, text) == encoder.model.encode(text)


def test_merging_and_backtracking_agree():
    encoder, draw = piece_encoding.piece_encoder(VOCABULARY), random.Random(3)
    for _ in range(500):
        part = piece_encoding.BLANK + "".join(draw.choice("etaoinshr") for _ in range(draw.randrange(1, 25)))
        assert encoder.pieces(part) == encoder.merge(part)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" ▁abthe\n\t0é")), st.characters(exclude_categories=["Cs"])),
               max_size=40))
def test_any_text_equals_the_library(text):
    encoder = piece_encoding.piece_encoder(VOCABULARY)
    assert ids(encoder, text) == encoder.model.encode(text)
