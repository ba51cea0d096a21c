"""Hashed words and word shingles of whole texts, and connected components of a table of links."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from selectra.session import materialise

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    """64-bit hash of a word, kept for the next time; emptied at a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def word_hashes(text: str | None) -> np.ndarray:
    """One hash per word, with A-Z in lower case."""
    words = (text or "").encode().lower().split()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * _B
        return values ^ (values >> np.uint64(31))


def rolled(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words; with fewer words, of the whole sequence as one run; without words, nothing."""
    if not len(words):
        return words
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        value = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            value = value * _A + words[i:len(words) - n + 1 + i]
            value ^= value >> np.uint64(29)
    return mixed(value)


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over undirected links (a, b); nodes without a link are absent.

    Alternates large-star and small-star steps: each node points its larger neighbours, then its smaller ones, at the
    smallest it knows. The table never holds more rows than links; each round is kept in the shared folder.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .distinct())
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        new = materialise(small.select("u", F.col("m").alias("v")).union(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        # settled when every node points at one node, and no such node points further
        again = new.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() or new.join(
            new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        edges = new
        if not again:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
