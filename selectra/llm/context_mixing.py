"""Logistic mixing of hashed-context bit predictors: the part of the language model that works on arrays.

A word is spelled as its bytes and an end mark, each byte as the bits of a prefix code. A predictor keeps, for each
hashed pair of context and place in the code, how often the bit was unset and set, which gives the log odds of a set
bit. The log odds are added with weights out of the set that the gate names, and the sum is refined by an adaptive map
from coarse to observed odds. The tables hold every training pair, so an occurrence is left out of the counts that
predict it while weights and map are learned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from selectra.llm.shingles import mixed

#: states of the gate from earlier words; least slots of a predictor (as bits); smoothing of its counts
GATES, SLOTS, PRIOR = 7, 16, 0.2
#: counts that a slot's byte stands for: exact up to 15, then by sevenths of a doubling, up to 3e11
LEVELS = np.concatenate([np.arange(16.0), 15 * 2 ** (np.arange(1, 241) / 7)])
ORDERS = ("gate and two bytes", "gate and three bytes", "gate and five bytes", "word so far", "gate and word so far")
#: places in a word that have weights of their own, by two states of what is known of the word so far
PLACES, MAP_CELLS = 4, 32
SPACE, END = b" ", b"\n"
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def levels(counts: np.ndarray) -> np.ndarray:
    """The nearest level of each count, by ratio."""
    edges = np.concatenate([np.arange(15) + 0.5, np.sqrt(LEVELS[15:-1] * LEVELS[16:])])
    return np.searchsorted(edges, counts).astype(np.uint8)


def prefix_code(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a prefix code (Huffman) over the 256 bytes."""
    heap = [(int(c) + 1, b, (b,)) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    lengths = np.zeros(256, np.int64)
    while len(heap) > 1:
        (n, b, left), (m, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        lengths[list(left + right)] += 1
        heapq.heappush(heap, (n + m, b, left + right))
    values, value, before = np.zeros(256, np.uint64), 0, 0
    for b in np.lexsort((np.arange(256), lengths)):
        value <<= int(lengths[b]) - before
        values[b], before = value, int(lengths[b])
        value += 1
    return lengths, values


@dataclass
class Steps:
    """Distinct (context, next byte) steps of a list of words, and which of them each word takes."""

    contexts: np.ndarray  # one row per predictor
    byte: np.ndarray
    place: np.ndarray
    taken: np.ndarray  # per byte of the words: its step
    first: np.ndarray  # per word: its first byte


def steps(words: list[bytes], gates: np.ndarray) -> Steps:
    spelled = [w if w == END else w + SPACE for w in words]
    lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
    data = np.frombuffer(b"".join(spelled), np.uint8).astype(np.uint64) + np.uint64(1)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(data)) - np.repeat(first, lengths)
    back = []
    for by in (1, 2, 3, 4, 5):
        shifted = np.zeros(len(data), np.uint64)
        shifted[by:] = data[:-by]
        shifted[place < by] = 0
        back.append(shifted)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(place.max(initial=0)) + 1, _K[0]))
        total = np.cumsum(data * powers[place])
        before = np.concatenate([np.zeros(1, np.uint64), total])
        so_far = mixed(before[:-1] - np.repeat(before[first], lengths) + place.astype(np.uint64) * _K[1])
        gate = np.repeat(gates.astype(np.uint64), lengths)
        key = mixed(so_far + (gate * np.uint64(257) + data) * _K[2])
        _, chosen, taken = np.unique(key, return_index=True, return_inverse=True)
        back = [b[chosen] for b in back]
        own = gate[chosen] * _K[3]
        two = back[0] + (back[1] << np.uint64(9))
        three = two + (back[2] << np.uint64(18))
        five = three + (back[3] << np.uint64(27)) + (back[4] << np.uint64(36))
        contexts = np.stack([mixed(two * _K[1] + own), mixed(three * _K[2] + own), mixed(five * _K[3] + own + _K[2]),
                             so_far[chosen], mixed(so_far[chosen] + own + _K[1])])
    return Steps(contexts, (data[chosen] - np.uint64(1)).astype(np.int64), np.minimum(place[chosen], PLACES - 1), taken,
                 first)


@dataclass
class Mixer:
    """The prefix code, a table of counts (as levels) per predictor and bit, gated weights, and the adaptive map."""

    lengths: np.ndarray
    values: np.ndarray
    counted: np.ndarray
    weights: np.ndarray
    refined: np.ndarray

    @staticmethod
    def start(byte_counts: np.ndarray, slots: int = SLOTS) -> Mixer:
        lengths, values = prefix_code(byte_counts)
        return Mixer(lengths, values, np.zeros((2, len(ORDERS), 1 << slots), np.uint8),
                     np.full((PLACES * 2, len(ORDERS)), 0.3), np.zeros((PLACES, MAP_CELLS)))

    def bits(self, s: Steps) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per bit of all steps: its step, its place in the code, its value."""
        n = self.lengths[s.byte]
        step = np.repeat(np.arange(len(n)), n)
        depth = np.arange(len(step)) - np.repeat(np.cumsum(n) - n, n)
        code, left = self.values[s.byte][step], (n[step] - depth).astype(np.uint64)
        node = (np.uint64(1) << depth.astype(np.uint64)) | (code >> left)
        bit = (code >> (left - np.uint64(1))) & np.uint64(1)
        return step, node, bit.astype(np.float64)

    def slots(self, contexts: np.ndarray, step: np.ndarray, node: np.ndarray) -> np.ndarray:
        bits = self.counted.shape[2].bit_length() - 1
        with np.errstate(over="ignore"):
            return (mixed(contexts[step] + node * _K[0]) >> np.uint64(64 - bits)).astype(np.int64)

    def tallies(self, words: list[bytes], gates: np.ndarray, times: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each predictor the slots of counted (gate, word) pairs in order, and how often each was (unset, set)."""
        s = steps(words, gates)
        step, node, bit = self.bits(s)
        n = np.bincount(s.taken, np.repeat(times, np.diff(np.append(s.first, len(s.taken)))))[step]
        for contexts in s.contexts:
            slot, at = np.unique(self.slots(contexts, step, node), return_inverse=True)
            ones = np.bincount(at, n * bit, len(slot))
            yield slot, np.stack([np.bincount(at, n, len(slot)) - ones, ones])

    def learn_odds(self, words: list[bytes], gates: np.ndarray, times: np.ndarray) -> None:
        """Set the tables from counted (gate, word) pairs."""
        for k, (slot, counts) in enumerate(self.tallies(words, gates, times)):
            self.counted[:, k, slot] = levels(counts)

    def inputs(self, s: Steps, step: np.ndarray, node: np.ndarray, own: np.ndarray | None = None
               ) -> tuple[np.ndarray, np.ndarray]:
        """The log odds of each predictor and the set of weights; ``own`` are bits to be left out of the counts once."""
        odds = np.zeros((len(ORDERS), len(step)))
        for k in range(len(ORDERS)):
            slot = self.slots(s.contexts[k], step, node)
            unset, ones = LEVELS[self.counted[0, k, slot]], LEVELS[self.counted[1, k, slot]]
            if own is not None:
                unset, ones = np.maximum(unset - (1 - own), 0), np.maximum(ones - own, 0)
            odds[k] = np.log((ones + PRIOR) / (unset + PRIOR))
            if k == 3:
                known = (unset + ones > 0).astype(np.int64)
        return odds, s.place[step] * 2 + known

    def cells(self, mix: np.ndarray) -> np.ndarray:
        return np.clip(mix * 2 + MAP_CELLS / 2, 0, MAP_CELLS - 1).astype(np.int64)

    def train(self, words: list[bytes], gates: np.ndarray, times: np.ndarray, seen: np.ndarray, rate: float) -> None:
        """Online steps over the bits of counted pairs; ``seen`` gathers (ones, all) of the adaptive map."""
        s = steps(words, gates)
        step, node, bit = self.bits(s)
        n = np.bincount(s.taken, np.repeat(times, np.diff(np.append(s.first, len(s.taken)))))[step]
        odds, gate = self.inputs(s, step, node, bit)
        for at in range(0, len(bit), 16_384):
            part = slice(at, at + 16_384)
            mix = (self.weights[gate[part]].T * odds[:, part]).sum(0)
            error = (bit[part] - 1 / (1 + np.exp(-np.clip(mix, -30, 30)))) * n[part]
            cell = s.place[step[part]] * MAP_CELLS + self.cells(mix)
            seen[0] += np.bincount(cell, n[part] * bit[part], seen.shape[1])
            seen[1] += np.bincount(cell, n[part], seen.shape[1])
            for k in range(len(ORDERS)):
                push = np.bincount(gate[part], error * odds[k, part], len(self.weights))
                mass = np.bincount(gate[part], n[part], len(self.weights))
                self.weights[:, k] += rate * push / np.maximum(mass, 1e-9)

    def log10(self, words: list[bytes], gates: np.ndarray) -> np.ndarray:
        """The log10 probability of each word after its gate."""
        if not words:
            return np.zeros(0)
        s = steps(words, gates)
        step, node, bit = self.bits(s)
        odds, gate = self.inputs(s, step, node)
        mix = np.einsum("ki,ki->i", self.weights.T[:, gate], odds)
        mix = np.clip((mix + mix + self.refined[s.place[step], self.cells(mix)]) / 3, -30, 30)
        cost = np.logaddexp(0, np.where(bit > 0, -mix, mix))
        per_step = np.bincount(step, cost, len(s.byte))
        return -np.add.reduceat(per_step[s.taken], s.first) / np.log(10)


def refine(mixer: Mixer, seen: np.ndarray) -> None:
    """The adaptive map from what was seen: observed log odds of each cell, its own middle where little was seen."""
    middle = np.tile((np.arange(MAP_CELLS) + 0.5 - MAP_CELLS / 2) / 2, PLACES)
    p = 1 / (1 + np.exp(-middle))
    odds = np.log((seen[0] + 8 * p) / (seen[1] - seen[0] + 8 * (1 - p)))
    mixer.refined[...] = odds.reshape(PLACES, MAP_CELLS)
