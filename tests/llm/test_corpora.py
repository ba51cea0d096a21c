"""Operators that compare documents: brute force, planted cases, edge cases."""

import math
import os
import random
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from selectra.llm import decontamination, line_dedup, lm_scoring, ngram_join, substring_dedup
from selectra.llm.context_mixing import SPACE, Mixer, steps
from selectra.llm.shingles import components
from selectra.session import materialise
from tests.llm.conftest import BASE, LONG, PASSAGE, ROWS, near, prose


def grams(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def linked(texts, n, num, den):
    """Component of each text, by brute force."""
    sets, top = [grams(t, n) for t in texts], list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("n, num, den", [(3, 9, 10), (5, 4, 5)])
def test_join_equals_brute_force(spark, n, num, den):
    draw = random.Random(n)
    texts = []
    for i in range(12):
        own = prose(100 + i, draw.choice([1, 2, 4, 9, 14, 30, 80, 300]))
        texts += [own, own] + [near(own, draw.choice([7, 20, 45, 70, 150])) for _ in range(6)]
    crowd = prose(99, 200)  # many that share fragments, some of which link and some of which cannot
    texts += [near(crowd, draw.randint(12, 190)) for _ in range(40)] + [crowd]
    draw.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    rows = ngram_join.join_groups(docs, ngram_join.Likeness(n, num, den)).collect()
    want = linked(texts, n, num, den)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {
        i: (len(grams(t, n)), want[i]) for i, t in enumerate(texts)}
    assert len(set(want)) < len(texts)


def test_sets_with_empty_fragments_still_share_a_signature():
    like, draw = ngram_join.Likeness(3, 9, 10), np.random.default_rng(1)
    for size in [9, 10, 17, 18, 19, 35, 60, 61]:
        for _ in range(300):
            a = np.unique(draw.integers(0, 2 ** 63, size).astype(np.uint64) << np.uint64(1))
            b = a
            while 10 * len(np.intersect1d(a, b[1:])) >= 9 * len(np.union1d(a, b[1:])):
                b = b[1:]
                assert np.intersect1d(ngram_join.signatures(a, like), ngram_join.signatures(b, like)).size


def test_join_edge_cases(docs, nothing):
    rows = ngram_join.join_groups(docs, ngram_join.Likeness(3, 9, 10)).collect()
    assert len(rows) == len(ROWS)
    alone = {r.doc_id: r for r in rows if r.doc_id in (4, 5, 6)}
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id for r in alone.values())
    found = {r.doc_id: r.component_id for r in rows}
    assert found[1] == 0 and found[2] == 0 and found[3] == 3 and found[None] is None and found[9] == 9
    assert ngram_join.join_groups(nothing, ngram_join.Likeness()).count() == 0
    kept = ngram_join.one_of_each(docs, ngram_join.Likeness()).collect()
    ids = sorted((r.doc_id for r in kept), key=str)
    assert ids == sorted([0, 3, 4, 5, 6, 7, 8, None, 9, 10, 11, 12, 13, 14, 15], key=str)
    assert [f.name for f in kept[0].__fields__] if False else kept[0].asDict().keys() == docs.first().asDict().keys()


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    links = spark.createDataFrame(chain + star + [(5, 5), (2, 1)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)}


def test_patience_and_blocks():
    aligned = line_dedup.patience(list("xabcyd"), list("abczd"))
    assert aligned == [(1, 0), (2, 1), (3, 2), (5, 4)]
    assert line_dedup.patience(list("aaab"), list("aab")) and not line_dedup.patience([], list("ab"))
    assert len(line_dedup.patience(list("abababab"), list("babababa"))) == 7
    assert len(line_dedup.patience(list("ab") * 5000, list("ba") * 5000)) == 9999


def test_line_dedup_deletes_blocks_of_the_later_document(spark):
    block = prose(20, 60)
    texts = {1: prose(21, 40) + "\n" + block, 2: prose(22, 40) + "\n" + block + "\n" + prose(23, 40), 3: block,
             4: prose(24, 40) + "\nshort.\n" + prose(25, 40), 5: "short.\n" + prose(26, 40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in line_dedup.clean(docs).collect()}
    assert got == texts | {2: prose(22, 40) + "\n" + prose(23, 40), 3: ""}


def test_line_dedup_edge_cases(docs, nothing):
    rows = line_dedup.clean(docs).collect()
    assert len(rows) == len(ROWS) and set(docs.columns) <= set(rows[0].asDict())
    by_id = {r.doc_id: r for r in rows}
    assert by_id[0].text == BASE and by_id[1].text == "" and by_id[4].text is None and by_id[12].text == LONG
    twice = [r for r in rows if r.doc_id == 9]
    assert len(twice) == 2 and all(r._deleted == 0 for r in twice)
    assert line_dedup.clean(nothing).count() == 0


def test_leaks_within_the_budget_are_found(spark, benchmark):
    upper, spaced = PASSAGE.upper(), PASSAGE.replace(" ", "\n  ")
    edited = PASSAGE[:100] + "#" + PASSAGE[103:200] + " extra " + PASSAGE[200:]
    far = "".join(c if i % 5 else "#" for i, c in enumerate(PASSAGE))
    texts = [(0, "before " + PASSAGE + " after"), (1, upper), (2, spaced), (3, edited), (4, far), (5, PASSAGE[:200]),
             (6, prose(30, 20_000) + " " + PASSAGE), (7, "a tiny thing"), (8, None), (9, "")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = decontamination.leaks(docs, benchmark).collect()
    assert {r.doc_id for r in rows if r.item_id == 0} == {0, 1, 2, 3, 6}
    assert {r.doc_id for r in rows if r.item_id == 4} == {7}
    for r in rows:
        if r.doc_id in (0, 6):
            assert dict(texts)[r.doc_id][r.start:r.end] == PASSAGE and r.edits == 0
        if r.doc_id == 3:
            assert 0 < r.edits <= 10 and abs(r.end - r.start - len(edited)) <= 10


def test_banded_alignment_equals_full_dynamic_programming():
    draw = random.Random(9)
    for _ in range(200):
        text = [draw.randint(1, 4) for _ in range(draw.randint(0, 25))]
        wanted = [draw.randint(1, 4) for _ in range(draw.randint(1, 12))]
        row = [0] * (len(text) + 1)
        for i, w in enumerate(wanted, 1):
            new = [i]
            for j, t in enumerate(text, 1):
                new.append(min(row[j - 1] + (w != t), row[j] + 1, new[j - 1] + 1))
            row = new
        edits, end = decontamination.align(np.array(wanted, np.uint32), np.array(text, np.uint32), -13, 26)
        assert edits == min(row) and row[end] == edits


@pytest.mark.parametrize("share", [0.1, 0.3])
def test_items_of_every_length_are_found_with_all_edits_of_the_budget(share):
    draw = random.Random(17)
    for length in [*range(1, 64), 79, 80, 81, 200]:
        item = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(length))
        edits, changed = int(length * share), list(item)
        for n in range(edits):  # spread evenly, which leaves the shortest equal runs
            changed[(2 * n + 1) * length // (2 * edits)] = "#"
        text = "0123 456789 " * 3 + "".join(changed) + " 9876 543210" * 3
        found = decontamination.Items([(5, item)], share).search([text])[0]
        assert [(m[0], m[3]) for m in found][:1] == [(5, edits)] or (found and found[0][3] <= edits), (length, edits)
        assert not decontamination.Items([(5, item)], share).search(["0123 456789 " * 9])[0]


def test_the_whole_search_equals_alignment_at_every_place():
    draw = random.Random(23)
    items = [(i, "".join(draw.choice("abcd ") for _ in range(n)).strip() or "a") for i, n in enumerate([9, 14, 22, 35, 48, 70])]
    texts = []
    for _ in range(60):
        own = list(draw.choice(items)[1])
        for _ in range(draw.randint(0, 6)):
            at = draw.randrange(len(own) + 1)
            own[at:at + draw.randint(0, 1)] = draw.choice(["", "x", "ab"])
        texts.append("".join(draw.choice("efgh ") for _ in range(30)) + "".join(own) + "".join(draw.choice("efgh ") for _ in range(30)))
    found = decontamination.Items(items, 0.1).search(texts)
    for text, matches in zip(texts, found):
        codes, _ = decontamination.normal(text)
        for item_id, item in items:
            wanted, _ = decontamination.normal(item)
            row = [0] * (len(codes) + 1)
            for i, w in enumerate(wanted, 1):
                new = [i]
                for j, t in enumerate(codes, 1):
                    new.append(min(row[j - 1] + (w != t), row[j] + 1, new[j - 1] + 1))
                row = new
            within = min(row) <= int(len(wanted) * 0.1)
            assert within == any(m[0] == item_id for m in matches), (item, text)
            assert all(m[3] >= min(row) for m in matches if m[0] == item_id)


def test_leaks_edge_cases(docs, nothing, benchmark):
    marked = decontamination.mark(docs, benchmark).collect()
    assert len(marked) == len(ROWS)
    assert {r.doc_id for r in marked if any(m.item_id == 0 for m in r._leaks)} == {10, 11}
    assert decontamination.leaks(nothing, benchmark).count() == 0
    assert decontamination.leaks(docs, benchmark.where("item_id = 77")).count() == 0


def test_benchmark_in_blocks_gives_the_same(docs, benchmark, monkeypatch):
    whole = sorted(map(tuple, decontamination.leaks(docs, benchmark).collect()), key=str)
    parts = list(decontamination.blocks(benchmark, chars=300))
    assert len(parts) > 1 and sum(map(len, parts)) == 5
    monkeypatch.setattr(decontamination, "blocks", lambda b: iter(parts))
    assert sorted(map(tuple, decontamination.leaks(docs, benchmark).collect()), key=str) == whole


def test_passages_are_found_and_clean_documents_left(spark):
    exact, fuzzy = prose(40, 60).replace("\n", " "), prose(41, 90).replace("\n", " ")
    changed = fuzzy.split(" ")
    changed[30], changed[60:61] = "other", []
    texts = [(0, prose(50, 100) + " " + exact), (1, exact + " " + prose(51, 80)), (2, prose(52, 30) + " " + fuzzy),
             (3, prose(53, 200) + " " + " ".join(changed) + " " + prose(54, 40)), (4, prose(55, 300)),
             (5, prose(56, 60) + " " + " ".join(exact.split(" ")[:25])), (6, None), (7, "")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = substring_dedup.passages(docs).collect()
    assert {frozenset((r.doc_id, r.other_id)) for r in rows} == {frozenset((0, 1)), frozenset((2, 3))}
    words = {d: (t or "").split() for d, t in texts}
    for r in rows:
        own = words[r.doc_id][r.first_word:r.end_word]
        if r.doc_id in (0, 1):
            assert own == exact.split()
        else:
            assert len(own) >= 86 and r.equal_words >= 86


def test_every_run_of_equal_words_shares_a_seed():
    draw = random.Random(3)
    shared = [f"s{i}" for i in range(substring_dedup.K + substring_dedup.WINDOW - 1)]
    for _ in range(50):
        sides = []
        for _ in range(2):
            before = [f"a{draw.random()}" for _ in range(draw.randint(0, 30))]
            after = [f"b{draw.random()}" for _ in range(draw.randint(0, 30))]
            sides.append(set(substring_dedup.seeds(substring_dedup.word_hashes(" ".join(before + shared + after)))[0].tolist()))
        assert sides[0] & sides[1]


def test_chains_are_collinear_and_cover_all_matches():
    matches = [(i * 10, i * 10 + 5) for i in range(20)] + [(50, 400), (60, 2), (300, 300)]
    found = substring_dedup.chains(matches)
    assert sorted(m for c in found for m in c) == sorted(matches)
    assert all(a[0] < b[0] and a[1] < b[1] for c in found for a, b in zip(c, c[1:]))
    assert max(found, key=len)[:2] == [(0, 5), (10, 15)] and len(max(found, key=len)) == 20


def test_passages_edge_cases(docs, nothing):
    rows = substring_dedup.passages(docs).collect()
    pairs = {frozenset((r.doc_id, r.other_id)) for r in rows}
    assert frozenset((10, 11)) in pairs and not any(12 in p or None in p for p in pairs)
    assert {0, 1, 2} <= {d for p in pairs for d in p}
    assert substring_dedup.passages(nothing).count() == 0


def test_bit_predictors_form_a_distribution():
    mixer = Mixer.start(np.bincount(np.frombuffer(b"the cat and the dog ", np.uint8), minlength=256))
    words = [b"the", b"cat", b"and", b"dog"]
    mixer.learn_odds(words, np.array([0, 1, 0, 1]), np.array([9.0, 3.0, 4.0, 2.0]))
    # after any context the 256 next bytes have probabilities that sum to one
    nexts = [bytes([b]) for b in range(256) if b not in b"\n "]
    s = steps(nexts, np.zeros(len(nexts), np.int64))
    step, node, bit = mixer.bits(s)
    odds, gate = mixer.inputs(s, step, node)
    mix = np.einsum("ki,ki->i", mixer.weights.T[:, gate], odds)
    cost = np.logaddexp(0, np.where(bit > 0, -mix, mix))
    per_step = np.exp(-np.bincount(step, cost, len(s.byte)))
    first = s.taken[s.first]
    both = mixer.log10([b"\n"], np.zeros(1, np.int64))
    assert 0.9 < per_step[first].sum() <= 1 + 1e-9 and both[0] < 0
    assert SPACE == b" "


def test_scores_of_documents(spark, docs, nothing):
    rows = lm_scoring.score(docs).collect()
    tokens = [(r[0], (r[1] or "").encode().lower().split() + [None]) for r in ROWS]
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    counts = Counter(w for d, own in tokens if not fold(d) for w in own)
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((len(own), sum(counts[w] > 0 for w in own), total, fold(d), round(sum(
        math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own), 4)) for d, own in tokens)
    got = sorted((r.n_tokens, r.n_known, r.train_tokens, r.held_out, round(r.base_score, 4)) for r in rows)
    assert got == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert lm_scoring.score(nothing).count() == 0


def test_rare_words_beyond_the_frequent_ones_are_joined(docs, monkeypatch):
    whole = sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in lm_scoring.score(docs).collect())
    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", 20)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in lm_scoring.score(docs).collect()) == whole


def test_model_beats_a_uniform_byte_model(spark):
    draw = random.Random(8)
    words = [prose(i, 1).rstrip(".") for i in range(200)]
    docs = spark.createDataFrame([(i, " ".join(draw.choices(words, k=200))) for i in range(120)], "doc_id bigint, text string")
    held = [r for r in lm_scoring.score(docs).collect() if r.held_out]
    chars = {i: t for i, t in docs.collect()}
    bits = sum(-r.score / math.log10(2) for r in held) / sum(len(chars[r.doc_id]) + 1 for r in held)
    assert bits < 2


def test_every_training_pair_reaches_a_predictor(spark):
    # so many words seen once that a bound on the pairs of the model would drop them; they begin alike
    words, own = [f"qzqz{i * 7919 % (1 << 24):06x}" for i in range(620_000)], 10_000
    docs = spark.createDataFrame([(i, " ".join(words[i * own:(i + 1) * own])) for i in range(62)], "doc_id bigint, text string")
    rows = lm_scoring.score(docs.repartition(4)).collect()
    assert any(r.held_out for r in rows) and all(r.score / r.n_tokens > -10 for r in rows)  # -26.5 where all bits are even


def test_an_occurrence_is_left_out_of_the_counts_that_predict_it():
    mixer = Mixer.start(np.ones(256))
    mixer.learn_odds([b"once", b"twice"], np.zeros(2, np.int64), np.array([1.0, 2.0]))
    for word, known in ((b"once", False), (b"twice", True)):
        s = steps([word], np.zeros(1, np.int64))
        step, node, bit = mixer.bits(s)
        last = step == s.taken[len(word)]
        assert (mixer.inputs(s, step, node, bit)[0][3][last] != 0).all() == known
        assert (mixer.inputs(s, step, node)[0][3][last] != 0).all()


def test_passages_near_another_shared_run_are_found(spark):
    draw, rows, shapes = random.Random(12), [], [(55, 22, 19), (60, 25, 30), (55, 22, 12)]
    own = lambda n: [f"w{draw.random()}" for _ in range(n)]
    for n in range(30):
        head, gap, tail = shapes[n % 3]
        same, also = own(head), own(tail)
        rows += [(2 * n + i, " ".join(own(40) + same + own(gap) + also + own(40))) for i in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {min(r.doc_id, r.other_id) // 2: (r.first_word, r.end_word, r.equal_words)
             for r in substring_dedup.passages(docs).collect()}
    assert found == {n: (40, 40 + shapes[n % 3][0], shapes[n % 3][0]) for n in range(30)}


def test_a_passage_that_stands_twice_is_found_twice(spark):
    draw = random.Random(13)
    own = lambda n: [f"w{draw.random()}" for _ in range(n)]
    rows = []
    for n in range(4):  # whichever of the two has the smaller key
        same, other = own(70), own(70)
        rows += [(2 * n, " ".join(own(20) + same + own(30) + same + own(50) + other)), (2 * n + 1, " ".join(own(10) + same + own(10)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = set()
    for r in substring_dedup.passages(docs).collect():
        sides = (r.doc_id, r.first_word, r.end_word), (r.other_id, r.other_first_word, r.other_end_word)
        found |= {side for side in sides if side[0] % 2 == 0}
    assert found == {(2 * n, first, first + 70) for n in range(4) for first in (20, 120)}


def test_line_dedup_finds_blocks_that_no_earliest_holder_of_a_line_has(spark):
    a, b, c = "first short line", "second short line", "third"
    texts = {1: a, 2: b, 3: c} | {i: f"{prose(60 + i, 30)}\n{a}\n{b}\n{c}" for i in range(4, 16)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in line_dedup.clean(docs).collect()}
    assert got == {i: t if i < 5 else prose(60 + i, 30) for i, t in texts.items()}


def test_shortest_runs_cover_every_long_enough_block():
    draw = random.Random(14)
    for _ in range(50):
        block = [(b"s%d" % i, draw.randint(1, 14)) for i in range(draw.randint(3, 9))]
        sides = [[(b"%d" % draw.getrandbits(60), 9) for _ in range(4)] + block + [(b"%d" % draw.getrandbits(60), 9)] for _ in (0, 1)]
        shared = line_dedup.runs(sides[0], 30) & line_dedup.runs(sides[1], 30)
        assert bool(shared) == (sum(n for _, n in block) >= 30)


def test_passages_are_found_though_others_hold_each_of_their_runs(spark):
    draw, rows = random.Random(15), []
    own = lambda n: [f"w{draw.random()}" for _ in range(n)]
    for n in range(10):
        runs = [own(25) for _ in range(3)]
        shared = lambda: own(20) + runs[0] + own(1) + runs[1] + own(1) + runs[2] + own(20)
        rows += [(100 * n + i, " ".join(shared())) for i in (0, 1)]
        rows += [(100 * n + 10 + 5 * r + i, " ".join(own(30) + runs[r] + own(30))) for r in range(3) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {frozenset((r.doc_id, r.other_id)): r.equal_words for r in substring_dedup.passages(docs).collect()}
    assert found == {frozenset((100 * n, 100 * n + 1)): 75 for n in range(10)}


def test_matches_in_parts_and_of_crowded_seeds(monkeypatch):
    """Every document is matched with one of its class, every class with the first one, however the rows are cut."""
    draw = random.Random(16)
    rows = sorted({(seed, draw.randrange(60 if seed else 3), draw.randrange(40), draw.randrange(9))
                   for seed in range(4) for _ in range(400 if seed < 2 else 12)})
    table = pa.table([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(),) * 3 + (pa.int32(),))],
                     ["seed", "context", "key", "place"])
    for held in (10 ** 6, 50):
        monkeypatch.setattr(substring_dedup, "HELD", held)
        out = pa.Table.from_batches(list(substring_dedup._classes(table.to_batches(37)))).to_pylist()
        stands = sorted((r["seed"], r["key"], r["place"]) for r in out if r["other"] is None)
        assert {r[0] for r in stands} == {0, 1, 2, 3} and all(r["key"] != r["other"] for r in out)
        at = {(s, k, p) for s, _, k, p in rows}
        assert at == {(r["seed"], r["key"], r["place"]) for r in out}
        sides = pa.table([pa.array(c, k) for c, k in zip(zip(*stands), (pa.int64(),) * 2 + (pa.int32(),))],
                         ["seed", "key", "place"])
        met = pa.Table.from_batches(list(substring_dedup._paired(sides.to_batches(37)))).to_pylist()
        assert all(r["key"] != r["other"] for r in met)
        few = [(k, p) for s, k, p in stands if s == 3]
        pairs = {frozenset(((r["key"], r["place"]), (r["other"], r["there"]))) for r in met}
        first = {k: min(p for j, p in few if j == k) for k, _ in few}
        assert len(few) <= substring_dedup.FEW and all(
            frozenset((a, b)) in pairs for a in few for b in few if a[0] != b[0] and first[b[0]] == b[1])


def test_passages_of_crowded_seeds_are_found_between_all(spark, monkeypatch):
    """Two documents share a changed passage whose every seed stands in many others as well, each in words of its own."""
    draw = random.Random(21)
    own = lambda n: [f"w{draw.random()}" for _ in range(n)]
    runs = [own(21) for _ in range(4)]
    shared = lambda: [w for run in runs for w in run + own(1)]
    rows = [(i, " ".join(own(30) + shared() + own(30))) for i in (1, 2)]
    rows += [(10 + 500 * r + i, " ".join(own(40) + run + own(40))) for r, run in enumerate(runs) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    table = lambda: sorted(map(tuple, substring_dedup.passages(docs).collect()))
    found = table()
    assert {frozenset(r[:2]) for r in found} == {frozenset((1, 2))} and [r[6] for r in found] == [84]
    monkeypatch.setattr(substring_dedup, "CROWD", 70)
    monkeypatch.setattr(substring_dedup, "HANDED", 500)
    monkeypatch.setattr(substring_dedup, "AT_ONCE", 200_000)
    assert table() == found


def test_first_look_drops_no_passage():
    draw, rows = random.Random(17), []
    for _ in range(600):
        base = np.array([draw.randrange(1 << 30) for _ in range(200)], np.uint32)
        other = base.copy()
        for i in range(200):
            if draw.random() < draw.choice((0.02, 0.1, 0.3)):
                other[i] = draw.randrange(1 << 30)
        if draw.random() < 0.5:
            other = np.delete(other, draw.randrange(200))
        x = draw.randrange(20, 160)
        other[x:x + substring_dedup.K] = base[x:x + substring_dedup.K]
        a, b = base[draw.randrange(20):draw.randrange(170, 200)], other
        x0 = int(np.flatnonzero(a == base[x])[0])
        # one seed, or several of which the later ones may lie on another diagonal or beyond changed words
        chain = [(x0 + 64, x + 128)]
        while draw.random() < 0.5:
            chain.append((chain[-1][0] + draw.randrange(1, 9), chain[-1][1] + draw.randrange(1, 9)))
            if draw.random() < 0.8:
                chain[-1] = (chain[-1][0], chain[-1][0] + chain[0][1] - chain[0][0])
        chain = [c for n, c in enumerate(chain) if c[0] - 64 + 8 <= len(a) and c[1] - 128 + 8 <= len(b) and (
            not n or c[0] > chain[n - 1][0] and c[1] > chain[n - 1][1])]
        rows.append((1, 2, 3, 4, 64, 128, a.tobytes(), b.tobytes(), np.array(chain, np.int32).tobytes()))
    kinds = (pa.int64(),) * 4 + (pa.int32(),) * 2 + (pa.binary(),) * 3
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [str(i) for i in range(9)])
    kept, sure = set(substring_dedup.hopeful(batch.slice(5), 50).tolist()), 0
    for n, (*_, low, there, a, b, ends) in enumerate(rows[5:]):
        chain = np.frombuffer(ends, np.int32).reshape(-1, 2) - np.array([low, there], np.int32)
        found = list(substring_dedup.passing(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32), chain, 50, 0.8))
        assert not found or n in kept
        sure += n not in kept
    assert sure > 20


def test_materialised_steps_leave_no_shuffle_behind(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {name for name in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in name}
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("a")).count()
    before = held()
    kept = materialise(counted)
    until = time.monotonic() + 20  # they go in the background
    while held() - before and time.monotonic() < until:
        time.sleep(0.1)
    assert held() <= before and sorted(kept.collect()) == sorted(counted.collect())
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_runs_of_lines_are_made_once(docs):
    plan = line_dedup.deletions(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("MapInArrow" in line and "run#" in line for line in plan.split("\n")) == 1


def test_tallies_of_many_pairs_hold_the_bits_of_few():
    draw = np.random.default_rng(2)
    words = sorted({bytes(w) for w in draw.integers(97, 123, (100_000, 9), np.uint8)})
    gates, times = draw.integers(0, 7, len(words)), draw.integers(1, 9, len(words)).astype(float)
    mixer = Mixer.start(np.ones(256), 20)

    def peak(tallies):
        tracemalloc.start()
        slots = [(slot.sum(), counts.sum()) for slot, counts in tallies]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return slots, most

    (whole, most), (parts, less) = peak(mixer.tallies(words, gates, times)), peak(
        lm_scoring.tallied(mixer, words, gates, times))
    assert parts == whole and less < 0.75 * most


def test_seeds_of_many_texts_are_those_of_each():
    draw = np.random.default_rng(4)
    words = [draw.integers(0, 1 << 62, n).astype(np.uint64) for n in (50, 51, 400, 63, 50)]
    words += [np.concatenate([words[0], words[2]]), np.full(90, 7, np.uint64)]
    got = substring_dedup.all_seeds(words, 50)
    each = [(*substring_dedup.seeds(w), substring_dedup.contexts(w, substring_dedup.seeds(w)[1])) for w in words]
    assert got[3].tolist() == [len(e[1]) for e in each]
    assert all((g == np.concatenate(e)).all() for g, e in zip(got, zip(*each)))


def test_passages_of_whole_chains_are_aligned_together(monkeypatch):
    draw, rows, want = np.random.default_rng(6), [], []
    for n in range(400):
        base = draw.integers(0, 1 << 30, 300).astype(np.uint32)
        other = np.where(draw.random(300) < draw.choice([0.0, 0.03, 0.1]), draw.integers(0, 1 << 30, 300), base).astype(np.uint32)
        if n % 3 == 0:
            other = np.delete(other, [60, 61] if n % 2 else [200])
        a, b = base[20:280], other[draw.integers(0, 30):]
        x = 100
        y = int(np.flatnonzero(np.isin(b, a[x]))[0]) if a[x] in b else 110
        chain = [(x + i, y + i + (i > 20) * int(draw.integers(0, 2))) for i in (0, 9, 25, 60)]
        found = substring_dedup.aligned(a, b, np.array(chain))
        want.append([int(v) for v in found])
        rows.append((1, 2, None if n % 7 else 3, 4, 64, 128, a.tobytes(), b.tobytes(),
                     (np.array(chain, np.int32) + np.array([64, 128], np.int32)).tobytes()))
    kinds = (pa.int64(),) * 4 + (pa.int32(),) * 2 + (pa.binary(),) * 3
    names = ["key", "other", "doc_id", "other_id", "low", "other_low", "words", "other_words", "ends"]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    assert substring_dedup.all_aligned(batch.slice(3))[0].T.tolist() == want[3:]
    passing = [w for w in want if min(w[1] - w[0], w[3] - w[2]) >= 50 and w[4] >= 0.8 * max(w[1] - w[0], w[3] - w[2])]
    assert 50 < len(passing) < 400

    def never(*_):
        raise AssertionError("aligned by itself")
    monkeypatch.setattr(substring_dedup, "aligned", never)
    keep = [n for n, w in enumerate(want) if w in passing]
    out = pa.Table.from_batches(list(substring_dedup._found(iter([batch.take(pa.array(keep))]), 50, 0.8))).to_pylist()
    assert [[r["first_word"] - 64, r["end_word"] - 64, r["other_first_word"] - 128, r["other_end_word"] - 128,
             r["equal_words"]] for r in out] == [want[n] for n in keep]
    assert [r["doc_id"] for r in out] == [rows[n][2] for n in keep]


def test_scoring_leaves_no_sent_tables_behind(spark, docs):
    held = lambda: set(os.listdir(spark.sparkContext._temp_dir))
    before = held()
    scores = lm_scoring.score(docs)
    assert held() <= before and all(r.score < 0 for r in scores.collect())
