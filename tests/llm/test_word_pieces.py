"""Ids of words under the word-level vocabulary."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from selectra.llm import word_pieces

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_of_letters_need_no_splitter(monkeypatch):
    """Most words are one run of letters: they are encoded as they are, as the tokenizer would."""
    text = "Plain WORDS état İstan ǅa ªº ét"
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(word_pieces.word_encoder.__wrapped__(PATH)(text), "<u4").tolist() == want
    monkeypatch.setattr(word_pieces, "PRE_TOKENS", None)
    letters = "Plain WORDS état Ça"
    want = Tokenizer.from_file(PATH).encode(letters, add_special_tokens=False).ids
    assert np.frombuffer(word_pieces.word_encoder.__wrapped__(PATH)(letters), "<u4").tolist() == want


def test_specials_inside_words():
    tokenizer = Tokenizer.from_file(PATH)
    for special in (t.content for t in tokenizer.get_added_tokens_decoder().values()):
        text = f"a{special}B {special} c"
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(word_pieces.word_encoder.__wrapped__(PATH)(text), "<u4").tolist() == want
