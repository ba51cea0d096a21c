"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams (that of their hashes) is cut into fragments. Two sets whose Jaccard similarity reaches t
differ in at most a (1 - t) / t elements, a being the smaller size; cut into more fragments than that, they agree in at
least one whole fragment. Equal fragments therefore find every linked pair. For the pairs found, the overlap of each
fragment is counted separately and summed per pair, which decides the link exactly.

Sizes fall into classes of a constant ratio that fix the number of fragments; a set signs for its own class and, if a
smaller partner may lie there, for the class below. A set with so many empty fragments that only those might agree
signs under further orders too. Equal sets are one node. Sets that share a fragment are compared with one of them; once
components are known, only pairs between different components are compared further. Where many share a fragment, sets
that cannot link are taken out first: an n-gram that no other set of such a crowd has adds to no overlap there.

What no such centre brings together meets in blocks of bounded size as sketches, one bit per bucket of hashes that tells
whether the set has an odd number of n-grams there. Two sets differ in at least as many n-grams as their sketches in
bits, so a sketch rules pairs out for certain and only the few that remain are counted by fragments. A block that finds
many goes on with pairs that would join what it holds (a forest); what lies between components then meets once more.

Cases: texts without words (null, empty, blank) have the empty set and link with nothing: they are their own component;
fewer than n words are one n-gram; repeated rows and equal texts are one node with all their ids; a null id is never
the smallest (a component of null ids alone has a null id); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from selectra.llm.shingles import components, mixed, rolled, word_hashes
from selectra.session import materialise, spread

#: ratio of neighbouring size classes; orders tried by sets with many empty fragments; fragments of the overlap count
RATIO, ORDERS, FRAGMENTS = 1.5, 8, 8
#: rounds in which a group is compared with a single member, before what is left meets in blocks
STAR_ROUNDS = 1
#: bits of a sketch per n-gram at least, the fewest bits, bytes of sketches of a block, pairs per set that are many
SKETCH_BITS, LEAST_BITS, BLOCK_BYTES, MANY = 4, 512, 1 << 21, 4
#: sets with a common fragment are a crowd above so many; times that sets which cannot link are taken out of crowds
CROWD, SIFTINGS = 8, 2


@dataclass(frozen=True)
class Likeness:
    """Words per n-gram, and the similarity num / den from which two sets link."""

    n: int = 5
    num: int = 4
    den: int = 5

    def most_different(self, size: int) -> int:
        """Elements in which a set of this size and a linked one that is not smaller differ at most."""
        return size * (self.den - self.num) // self.num

    def size_class(self, size: int) -> int:
        c = int(np.log(size) / np.log(RATIO))
        while self.lower(c + 1) <= size:
            c += 1
        while self.lower(c) > size:
            c -= 1
        return c

    @staticmethod
    def lower(c: int) -> int:
        return int(np.ceil(RATIO ** c))

    def fragments(self, c: int) -> int:
        """More than the differences in this class, with a margin for empty fragments."""
        most = self.most_different(self.lower(c + 1) - 1)
        return most + 1 + most // 16


def gram_set(text: str | None, n: int) -> np.ndarray:
    """The distinct n-gram hashes in the global order."""
    return np.unique(rolled(word_hashes(text), n))


def node_of(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _number(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def signatures(grams: np.ndarray, like: Likeness) -> np.ndarray:
    """A hash of every non-empty fragment, for each size class in which a partner may be."""
    size, out = len(grams), []
    own = like.size_class(size)
    smallest = -(-size * like.num // like.den)
    for c in (own, own - 1):
        if c < own and smallest >= like.lower(own):
            break
        count = like.fragments(c)
        bound = like.most_different(min(size, like.lower(c + 1) - 1))
        for order in range(ORDERS):
            ordered = grams if order == 0 else np.sort(mixed(grams + np.uint64(order)))
            edges = np.linspace(0, 2.0 ** 64, count + 1)[1:-1].astype(np.uint64)
            cuts = np.concatenate([[0], np.searchsorted(ordered, edges), [size]])
            with np.errstate(over="ignore"):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(ordered))])
                content = sums[cuts[1:]] - sums[cuts[:-1]]
                filled = np.diff(cuts) > 0
                heavy = count - int(filled.sum()) >= count - bound
                if heavy and order == ORDERS - 1:
                    filled[:] = True  # the last resort: empty fragments sign as well
                tag = np.arange(count, dtype=np.uint64) + np.uint64((c * ORDERS + order) << 32)
                out.append(mixed(mixed(content + tag * np.uint64(0x9E3779B97F4A7C15)) + tag)[filled])
            if not heavy:
                break
    return np.concatenate(out)


def sketch(grams: np.ndarray) -> bytes:
    """A bit per bucket of hashes: whether an odd number of the n-grams lie there."""
    bits = LEAST_BITS
    while bits < SKETCH_BITS * len(grams):
        bits *= 2
    # buckets of the low bits, so that the two halves of a sketch laid on each other are the sketch of half the bits
    counts = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def narrowed(bits: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of bytes) laid on themselves until they are ``width`` bytes wide."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _signed(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """Size, key and number of each text's set, and its signatures where a task meets the set for the first time."""
    seen: set[int] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part, size, key, node, signs = batch.slice(at, 1000), [], [], [], []
            for text in part.column(part.num_columns - 1):
                grams = gram_set(text.as_py(), like.n)
                size.append(len(grams))
                key.append(node_of(grams) if len(grams) else None)
                node.append(_number(key[-1]) if len(grams) else None)
                if node[-1] is None or node[-1] in seen:
                    signs.append(None)
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(node[-1])
                signs.append(signatures(grams, like).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(node, pa.int64()),
                 pa.array(signs, pa.list_(pa.int64()))],
                [*part.schema.names[:-1], "_size", "_key", "_node", "_signs"])


def _cut(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The fragments of a set as rows of (node, key, size, fragment, grams), the first with the sketch of the set."""
    seen: set[bytes] = set()
    for batch in batches:
        rows = []
        for text in batch.column(0):
            grams = gram_set(text.as_py(), n)
            key = node_of(grams)
            if key in seen:
                continue
            if len(seen) >= 500_000:
                seen.clear()
            seen.add(key)
            part = (grams >> np.uint64(61)).astype(np.int64)
            cuts = np.searchsorted(part, np.arange(FRAGMENTS + 1))
            rows += [(_number(key), key, len(grams), f, grams[cuts[f]:cuts[f + 1]].view(np.int64),
                      None if f else sketch(grams)) for f in range(FRAGMENTS)]
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)],
                                         ["node", "key", "size", "fragment", "grams", "sketch"])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared = [len(np.intersect1d(a.values.to_numpy(), b.values.to_numpy(), True))
                  for a, b in zip(batch.column(4), batch.column(5))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shared, pa.int64())],
                                         ["a", "b", "a_size", "b_size", "shared"])


def verified(pairs: DataFrame, parts: DataFrame, like: Likeness) -> DataFrame:
    """The pairs of nodes (a, b) that link: partial overlaps by fragment, summed per pair."""
    side = lambda s: parts.select(F.col("node").alias(s), F.col("key").alias(f"{s}_key"),
                                  F.col("size").alias(f"{s}_size"), "fragment", F.col("grams").alias(f"{s}_grams"))
    met = (pairs.join(side("a"), "a").join(side("b"), ["b", "fragment"])
           .where(like.num * F.greatest("a_size", "b_size") <= like.den * F.least("a_size", "b_size"))
           .select("a", "b", "a_size", "b_size", "a_grams", "b_grams"))
    counted = met.mapInArrow(_overlaps, "a bigint, b bigint, a_size bigint, b_size bigint, shared bigint")
    summed = counted.groupBy("a", "b", "a_size", "b_size").agg(F.sum("shared").alias("shared"))
    union = F.col("a_size") + F.col("b_size") - F.col("shared")
    return summed.where(like.den * F.col("shared") >= like.num * union).select("a", "b")


def sifted(parts: DataFrame, like: Likeness) -> DataFrame:
    """(node, size, met) of the sets that may link with one of the others given: an overlap holds only the ``met``
    n-grams that occur in two of them at least, and a link needs num / den of the union."""
    for _ in range(SIFTINGS):
        single = (parts.select("node", F.explode("grams").alias("gram")).groupBy("gram")
                  .agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
                  .groupBy("node").agg(F.count("*").alias("single")))
        met = materialise(parts.groupBy("node").agg(F.min("size").alias("size")).join(single, "node", "left").select(
            "node", "size", (F.col("size") - F.coalesce("single", F.lit(0))).alias("met"))
            .where(like.den * F.col("met") >= like.num * F.col("size")))
        parts = parts.join(met.select("node"), "node", "left_semi")
    return met


def can_link(like: Likeness, met: Column, both_sizes: Column) -> Column:
    """Whether an overlap of at most ``met`` is enough for two sets of these sizes together."""
    return (like.num + like.den) * met >= like.num * both_sizes


def near_pairs(table: pa.Table, like: Likeness, whole: bool) -> pa.Table:
    """(a, b): the pairs of two blocks (or of one) that sizes, ``met`` and sketches allow to link and that lie in
    different components. Unless ``whole``, those beyond ``MANY`` a set only if they join two components of the blocks,
    and a row of nulls then tells that some were left out."""
    block, node, size, met = (table.column(c).to_numpy() for c in ("block", "node", "size", "met"))
    label = np.unique(table.column("component").to_numpy(), return_inverse=True)[1]
    sketches = table.column("sketch").to_pylist()
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    wide = np.array([len(x) for x in sketches])
    rows_of, bits_of = {}, {}
    for w in np.unique(wide).tolist():  # every sketch that is as wide or wider, narrowed
        rows_of[w] = np.cumsum(wide >= w) - 1
        bits_of[w] = np.concatenate([narrowed(np.frombuffer(x, np.uint8)[None], w) for x in sketches if len(x) >= w]
                                    ).view(np.uint64)
    there = np.flatnonzero(block == high)
    out, left_out = [], False
    for r in np.flatnonzero(block == low):
        other = there[(there > r) if low == high else slice(None)]
        other = other[label[other] != label[r]]
        both = size[other] + size[r]
        need = -(-like.num * both // (like.num + like.den))  # the least overlap that links
        fits = np.minimum(met[other], met[r]) >= need
        other, most = other[fits], (both - 2 * need)[fits]
        apart = np.zeros(len(other), np.int64)
        for w in np.unique(np.minimum(wide[other], wide[r])).tolist():
            mine = np.minimum(wide[other], wide[r]) == w
            bits = bits_of[w]
            apart[mine] = np.bitwise_count(bits[rows_of[w][other[mine]]] ^ bits[rows_of[w][r]]).sum(1, dtype=np.int64)
        other, apart = other[apart <= most], apart[apart <= most]
        if not whole and len(out) + len(other) > MANY * len(node):
            left_out = True
            other = other[np.argsort(apart, kind="stable")]
            other = other[np.unique(label[other], return_index=True)[1]]  # the nearest of each component
            label[np.isin(label, label[other])] = label[r]
        out += [(node[r], node[o]) for o in other]
    pairs = np.sort(np.array(out, np.int64).reshape(-1, 2), 1)
    found = pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})
    none = pa.table({"a": pa.array([None], pa.int64()), "b": pa.array([None], pa.int64())})
    return pa.concat_tables([found, none]) if left_out else found


def left_pairs(rest: DataFrame, sketches: DataFrame, like: Likeness, whole: bool) -> DataFrame:
    """The pairs (a, b) of members of a group that may still link, and a pair of nulls if more are left. A group is dealt to blocks of about ``BLOCK_BYTES``
    of sketches and every two of its blocks meet in a task."""
    sizes = rest.join(sketches.select("node", F.length("sketch").alias("bytes")), "node")
    blocks = sizes.groupBy("sign").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("blocks"))
    dealt = rest.join(blocks, "sign").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "sign", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "node",
        "component", "size", "met").join(sketches, "node")
    return spread(met, "sign", "low", "high").groupBy("sign", "low", "high").applyInArrow(lambda t: near_pairs(t, like, whole), "a bigint, b bigint")


def node_components(texts: DataFrame, nodes: DataFrame, like: Likeness) -> DataFrame:
    """(node, component) of the nodes that link with another one. ``texts`` has doc_id and text, ``nodes`` has
    doc_id, _text (a hash of the text), _key, _node and _signs of the same rows."""
    width = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = (nodes.where("_signs IS NOT NULL").select(F.explode("_signs").alias("sign"), F.col("_node").alias("node"))
              .repartition(width, "sign"))
    groups = signed.groupBy("sign").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    members = materialise(signed.join(groups, "sign").select("sign", "node").distinct())
    involved = members.select(F.col("node").alias("_node")).distinct()
    # one row of each set involved: the one with the smallest id
    first = (nodes.join(involved, "_node", "left_semi").groupBy("_key")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_text")).alias("row")))
    chosen = first.select(F.col("row.doc_id").alias("_id"), F.col("row._text").alias("_text")).distinct()
    sets = texts.join(chosen, [F.xxhash64("text") == F.col("_text"), F.col("doc_id").eqNullSafe(F.col("_id"))],
                      "left_semi")
    parts = materialise(
        sets.select("text").mapInArrow(lambda b: _cut(b, like.n),
                                       "node bigint, key binary, size bigint, fragment int, grams array<bigint>, sketch binary")
        .groupBy("key", "fragment").agg(F.first("node").alias("node"), F.first("size").alias("size"),
                                        F.first("grams").alias("grams"), F.first("sketch").alias("sketch")))
    crowds = members.groupBy("sign").agg((F.count("*") > CROWD).alias("crowded"))
    placed = materialise(members.join(crowds, "sign"))
    # partners in a crowd are all in crowds, so what those share bounds the overlap there
    crowd = placed.where("crowded").select("sign", "node")
    known = sifted(parts.join(crowd.select("node").distinct(), "node", "left_semi"), like)
    crowd = crowd.join(known, "node").select("sign", "node", "size", "met")
    smallest = crowd.groupBy("sign").agg(F.min("size").alias("least"))
    crowd = crowd.join(smallest, "sign").where(can_link(like, F.col("met"), F.col("size") + F.col("least")))
    sizes = parts.groupBy("node").agg(F.min("size").alias("size"))
    few = placed.where("NOT crowded").join(sizes, "node").select("sign", "node", "size", F.col("size").alias("met"))
    members = materialise(crowd.select("sign", "node", "size", "met").union(few))
    links = parts.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    sketches = parts.where("fragment = 0").select("node", "sketch")
    found, done = links, None
    for turn in range(STAR_ROUNDS + 2):
        if done is None:
            labelled = members.withColumn("component", F.col("node"))
        else:
            labelled = (members.join(done, "node", "left")
                        .withColumn("component", F.coalesce("component", F.col("node"))))
        open_groups = labelled.groupBy("sign").agg(
            F.min("component").alias("low"), F.max("component").alias("high"),
            # first the set with the fewest n-grams of its own, which is likest to all others, then any
            F.min(F.struct((F.col("size") - F.col("met") if turn == 0 else F.xxhash64("node", F.lit(turn))).alias("by"),
                           "node", "component", "size", "met")).alias("centre")).where("low <> high")
        rest = labelled.join(open_groups.select("sign", "centre"), "sign")
        if turn < STAR_ROUNDS:
            pairs = rest.where("component <> centre.component").where(can_link(
                like, F.least("met", "centre.met"), F.col("size") + F.col("centre.size"))).select(
                F.least("node", "centre.node").alias("a"), F.greatest("node", "centre.node").alias("b"))
        else:
            pairs = left_pairs(rest.drop("centre"), sketches, like, whole=turn > STAR_ROUNDS)
        pairs = materialise(pairs.distinct())
        more = turn < STAR_ROUNDS or not pairs.where("a IS NULL").isEmpty()
        pairs = pairs.where("a IS NOT NULL")
        if not pairs.isEmpty():
            new = materialise(verified(pairs, parts, like))
            if not new.isEmpty():
                found = materialise(found.union(new).distinct())
                done = materialise(components(found))
        if not more:
            break
    return done if done is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component"))


def join_groups(docs: DataFrame, like: Likeness) -> DataFrame:
    """One row per document: doc_id, n_shingles, _key of its set, component_id (the smallest doc_id of its group)."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nodes = materialise(
        texts.select("doc_id", F.xxhash64("text").alias("_text"), "text")
        .mapInArrow(lambda b: _signed(b, like), "doc_id bigint, _text bigint, _size bigint, _key binary, _node bigint, "
                                                "_signs array<bigint>"))
    linked = node_components(texts, nodes, like)
    # per set its smallest id, then per component, then back; a set is one row here however many copies it has
    by_set = nodes.where("_key IS NOT NULL").groupBy("_key", "_node").agg(F.min("doc_id").alias("least"))
    grouped = by_set.join(linked.select(F.col("node").alias("_node"), "component"), "_node", "left").withColumn(
        "group", F.coalesce(F.col("component").cast("string"), F.hex("_key")))
    smallest = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    by_key = grouped.join(smallest, "group").select("_key", "component_id")
    return nodes.join(by_key, "_key", "left").select(
        "doc_id", F.col("_size").alias("n_shingles"), "_key", "_text",
        F.when(F.col("_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, like: Likeness) -> DataFrame:
    """The documents without those that have a near duplicate of smaller id; rows without words all stay.

    The one kept is the row whose id is the smallest of its group; of several such rows, the one of the smallest text
    hash, once. Groups of one row are not looked at again."""
    groups = materialise(join_groups(docs, like))
    text = F.xxhash64(F.col("text").cast("string"))
    same_id = F.col("doc_id").eqNullSafe(F.col("component_id"))
    kept = (groups.where("n_shingles > 0").groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("_key")
                                                                          ).alias("_alone"))
            .agg(F.min(F.when(same_id, F.col("_text"))).alias("_text")))
    rows = groups.where("n_shingles > 0").join(
        kept, [groups["component_id"].eqNullSafe(kept["component_id"]), groups["_text"] == kept["_text"]], "left_semi"
    ).where(same_id).groupBy("doc_id", "_text").agg(F.count("*").alias("_rows"))
    chosen = rows.select(F.col("doc_id").alias("_chosen_id"), F.col("_text").alias("_chosen_text"),
                         (F.col("_rows") > 1).alias("_chosen_twice"))
    empty = groups.where("n_shingles = 0").select(
        F.col("doc_id").alias("_chosen_id"), F.coalesce("_text", F.lit(0)).alias("_chosen_text"),
        F.lit(False).alias("_chosen_twice")).distinct()
    wanted = chosen.union(empty)
    found = docs.join(wanted, [F.col("doc_id").cast("bigint").eqNullSafe(F.col("_chosen_id")),
                               text == F.col("_chosen_text")])
    once = found.where(~F.col("_chosen_twice")).select(*docs.columns)
    again = found.where("_chosen_twice").dropDuplicates(["_chosen_id", "_chosen_text"]).select(*docs.columns)
    return once.union(again)
