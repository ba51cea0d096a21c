"""Operators that look at one document at a time: edge cases, brute force and round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from selectra.llm import packing, quality_rules, sharding, token_counts, toxicity
from selectra.llm.word_pieces import word_encoder
from tests.conftest import SMALL
from tests.llm.conftest import LONG, ROWS

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def by_brute_force(text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    seen, covered = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered |= {p + k for p in places for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(covered))


def test_quality_counts_match_brute_force(docs, nothing):
    rows = quality_rules.judge(docs).collect()
    assert len(rows) == len(ROWS)
    key = lambda r: (str(r[0]), r[1:])
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows), key=key)
    assert got == sorted(((r[0], *by_brute_force(r[1])) for r in ROWS), key=key)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows)
    assert quality_rules.judge(nothing).count() == 0


def test_quality_sorts_long_lists_of_repeats(spark):
    draw = random.Random(1)
    text = " ".join(draw.choice("abcdefgh") for _ in range(3000))  # far more repeated windows than are searched
    row = quality_rules.judge(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert row.n_repeat_words == by_brute_force(text)[4]


def test_quality_verdicts(spark):
    draw = random.Random(6)
    plain = " ".join(draw.choice(["the", "of", f"word{i}", f"thing{i}"]) + ("." if i % 9 == 0 else "") for i in range(200))
    texts = [(0, plain), (1, plain.replace(" ", "## ")), (2, plain.replace("the", "x").replace("of", "y")),
             (3, "the same line of words\n" * 60), (4, plain[:100])]
    rows = quality_rules.judge(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.kept for r in rows} == {0: True, 1: False, 2: False, 3: False, 4: False}
    assert {r.doc_id for r in rows if r.base_failed} == {3, 4}


def test_quality_rules_run_without_python(spark):
    plan = quality_rules.judge(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Exchange"))


def test_jump_hash_moves_rows_only_into_the_new_shard():
    keys = np.random.default_rng(1).integers(-2 ** 63, 2 ** 63 - 1, 50_000)
    before, after = sharding.jump(keys, 24), sharding.jump(keys, 25)
    moved = before != after
    assert (after[moved] == 24).all() and abs(moved.mean() - 1 / 25) < 0.005
    assert np.bincount(before, minlength=24).min() > 0.9 * len(keys) / 24
    assert sharding.jump(np.array([0, 1, 2 ** 40]), 1).tolist() == [0, 0, 0]


def test_shards_and_slots(docs, nothing):
    rows = sharding.assign_shards(sharding.document_rows(docs), F.col("doc_id")).collect()
    assert len(rows) == len(ROWS)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = sorted(len((r[1] or "").encode()) + 8 for r in ROWS)
    assert sorted(r["size"] for r in rows) == sizes
    assert {r.text_crc32 for r in rows} == {zlib.crc32((r[1] or "").encode()) for r in ROWS}
    assert sharding.assign_shards(sharding.document_rows(nothing), F.col("doc_id")).count() == 0


def test_shard_files_hold_every_row(docs, spark, tmp_path):
    plain = docs.drop("shard")
    sharding.write_shards(plain, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(ROWS)


def test_word_pieces_equal_the_tokenizer():
    tokenizer, encode = Tokenizer.from_file(VOCABULARY), word_encoder(VOCABULARY)
    texts = [r[1] or "" for r in ROWS] + ["Don't  stop here x <|endoftext|>y", "é É İ ΑΣ", "1234 ½ ٣", "\x1f a\x85b"]
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode(text), "<u4").tolist() == want


def test_packing_is_a_round_trip(docs, nothing):
    rows = packing.pack_documents(docs, VOCABULARY).collect()
    encode, end = word_encoder(VOCABULARY), np.array([2], "<u4").tobytes()
    want = sorted((str(r[0]), encode(r[1] or "") + end) for r in ROWS)
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert 0 < at <= packing.WINDOW
    # pieces of the same document in the order of their starts give its ids; repeated rows give them twice
    joined = {}
    for r in sorted(rows, key=lambda r: r.start):
        joined.setdefault((str(r.doc_id), r.doc_tokens), {}).setdefault(r.start, []).append(r.ids)
    got = []
    for (doc_id, _), parts in joined.items():
        for copy in range(len(parts[0])):
            got.append((doc_id, b"".join(p[copy] for _, p in sorted(parts.items()))))
    assert sorted(got) == want
    assert packing.pack_documents(nothing, VOCABULARY).count() == 0


def test_differencing_fills_windows():
    draw = random.Random(4)
    sizes = [draw.randint(1, 512) for _ in range(3000)]
    packed = packing.windows_of(sizes, 4096)
    assert sorted(i for w in packed for i in w) == list(range(len(sizes)))
    assert max(sum(sizes[i] for i in w) for w in packed) <= 4096
    assert len(packed) * 4096 <= 1.01 * sum(sizes) + 4096
    assert packing.windows_of([4096], 4096) == [[0]]
    assert len(packing.windows_of([3000, 3000, 3000], 4096)) == 3  # the count rises beyond the sum's share


def test_edits_equal_a_full_recount():
    split, counts = token_counts.counter(RANKS)
    draw = random.Random(2)
    alphabet = ["a", "b", " ", "  ", "\n", "1", "'s", "!", "é", "tion", "\t"]
    for _ in range(300):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 400)))
        edits = [(draw.randint(0, len(text) + 2), draw.randint(0, 40), "".join(draw.choice(alphabet) for _ in range(3)))
                 for _ in range(draw.randint(0, 5))]
        tree = token_counts.CountTree(text, split, counts)
        tree.apply(edits)
        want, at = [], 0
        for start, length, new in sorted(edits):
            end = max(start + length, at)
            start = max(start, at)
            want += [text[at:start], new]
            at = end
        edited = "".join([*want, text[at:]])
        assert tree.text() == edited
        assert tree.total == sum(counts[p] for p in split(edited))


def test_pieces_are_those_of_the_tokenizer():
    split, counts = token_counts.counter(RANKS)
    for text in [r[1] or "" for r in ROWS] + ["\x1f a\x85b  c", "we'll  don't\n\n x", "日本 ½"]:
        assert sum(counts[p] for p in split(text)) == len(counts.encode(text)) and "".join(split(text)) == text


def test_edits_touch_only_their_region():
    split, counts = token_counts.counter(RANKS)
    tree = token_counts.CountTree(LONG, split, counts)
    tree.replace(100_000, 5, "changed")
    assert tree.encoded < 10 and tree.text() == LONG[:100_000] + "changed" + LONG[100_005:]


def test_token_counts_of_edited_documents(docs, nothing, spark):
    edits = spark.createDataFrame([(7, 0, 3, "two words"), (0, 5, 2, None), (0, 999_999, 4, "end")],
                                  "doc_id bigint, start int, length int, replacement string")
    rows = token_counts.edited_counts(token_counts.with_edits(docs, edits), RANKS).collect()
    split, counts = token_counts.counter(RANKS)
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.n_tokens_after == sum(counts[p] for p in split(r.edited or ""))
    assert {r.edited for r in rows if r.doc_id == 7} == {"two words"}
    assert token_counts.edited_counts(token_counts.with_redactions(nothing), RANKS).count() == 0
    text = "mail a.b@example.org or call 0123-456 789, not 12"
    one = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = token_counts.edited_counts(token_counts.with_redactions(one), RANKS).first()
    assert row.edited == "mail <redacted> or call <redacted>, not 12"


def test_toxicity_learns_and_scores_whole_texts(spark):
    draw = random.Random(5)
    texts, marks = [], []
    for i in range(1500):
        words = [f"w{draw.randint(0, 3000)}" for _ in range(draw.randint(5, 80))]
        bad = i % 6 == 0
        if bad:
            words.insert(draw.randint(0, len(words)), "vile,")
        texts.append(" ".join(words))
        marks.append(bad)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(m)) for i, m in enumerate(marks)], "doc_id bigint, toxic int")
    rows = toxicity.classify(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(1500) if zlib.crc32(str(i).encode()) % 4 == 2}
    right = sum(r.predicted == marks[r.doc_id] for r in held) / len(held)
    assert right > 0.95
    model = toxicity.train(docs, labels)
    long = toxicity.word_buckets(" ".join(["calm"] * 60_000 + ["vile"] + ["calm"] * 10))
    clean, toxic = model.scores([toxicity.word_buckets(" ".join(["calm"] * 60_000)), long])
    assert clean < 0.3 < toxic


def test_toxicity_edge_cases(docs, nothing, labels):
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.classify(nothing, labels).count() == 0
    none = toxicity.classify(docs, labels.where("toxic = 5")).collect()
    assert all(r.score == 0 and not r.rejected for r in none)
    kept = toxicity.score(docs, None)
    assert kept.select(*docs.columns).collect() == docs.collect()
