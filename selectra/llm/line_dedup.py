"""Line dedup by pairwise alignment: patience diff between documents that share lines.

Lines are compared by a hash. A line that several documents share links each of them to the earliest one that has it,
so links grow with the lines, not with the square of a group. So does the shortest run of lines from each line on, and
up to each line, that is long enough to be deleted: two late documents with a block in common may have no line whose
earliest holder has the block. Each linked pair is aligned by patience diff over its shared lines, and the aligned common blocks are deleted from the later
document. The earliest document of a line always keeps it.

The order of documents is that of their ids (null last), then of their texts; rows equal in both count as one document
and get the same result. Blank lines are no anchors; they go with a deleted block when they lie inside it.

Cases: null texts stay null, empty ones empty; repeated lines of one document are left to other operators unless they
lie in an aligned block; ties in the alignment go to the earliest lines; an empty table gives no rows; other columns of
the input are kept by ``clean`` whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from selectra.session import materialise

#: a block is deleted from so many non-blank characters on
LEAST_CHARS = 30


def document_key() -> Column:
    """Orders documents and tells them apart: the id, then a digest of the text."""
    number = F.coalesce(F.lpad(F.hex(F.col("doc_id").cast("bigint")), 16, "0"), F.lit("~"))
    return F.concat(number, F.lit(":"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, numbers, hashes, sizes = [], [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for number, line in enumerate((text.as_py() or "").split("\n")):
                bare = "".join(line.split())
                if bare:
                    keys.append(key)
                    numbers.append(number)
                    hashes.append(xxhash.xxh3_128_digest(line.strip()))
                    sizes.append(len(bare))
            if len(keys) >= 50_000:
                yield _batch(keys, numbers, hashes, sizes)
                keys, numbers, hashes, sizes = [], [], [], []
        yield _batch(keys, numbers, hashes, sizes)


def runs(lines: list[tuple[bytes, int]], least: int) -> set[bytes]:
    """Hashes of the shortest runs of (hash, characters) that reach ``least``: from each line on, and up to each line."""
    reach = np.concatenate([[0], np.cumsum([size for _, size in lines], dtype=np.int64)])
    ends = np.searchsorted(reach, reach[:-1] + least)  # of the run from each line on
    begins = np.searchsorted(reach, reach[1:] - least, "right") - 1  # of the run up to each line
    pairs = {(i, j) for i, j in enumerate(ends.tolist()) if j <= len(lines)}
    pairs |= {(i, j + 1) for j, i in enumerate(begins.tolist()) if i >= 0}
    hashes = [h for h, _ in lines]
    return {xxhash.xxh3_128_digest(b"".join(hashes[i:j])) for i, j in pairs}


def _batch(keys, numbers, hashes, sizes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(numbers, pa.int32()),
                                       pa.array(hashes, pa.binary()), pa.array(sizes, pa.int32())],
                                      ["key", "number", "line", "chars"])


def _runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, found = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            bare = ((line.strip(), len("".join(line.split()))) for line in (text.as_py() or "").split("\n"))
            own = runs([(xxhash.xxh3_128_digest(line), size) for line, size in bare if size], least)
            keys += [key] * len(own)
            found += own
            if len(keys) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.binary())], ["key", "run"])
                keys, found = [], []
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.binary())], ["key", "run"])


def patience(later: list, earlier: list) -> list[tuple[int, int]]:
    """Aligned positions of equal entries: unique common entries in their longest common order, the runs around them,
    and the same again between two anchors."""
    aligned, todo = [], [(0, len(later), 0, len(earlier))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and later[a0] == earlier[b0]:
            aligned.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and later[a1 - 1] == earlier[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            aligned.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(later[a0:a1]), Counter(earlier[b0:b1])
        place = {earlier[j]: j for j in range(b0, b1) if once_b[earlier[j]] == 1}
        unique = [(i, place[later[i]]) for i in range(a0, a1) if once_a[later[i]] == 1 and later[i] in place]
        anchors = _rising(unique)
        if not anchors:
            anchors = _in_turn(later, earlier, a0, a1, b0, b1)
        for i, j in anchors:
            aligned.append((i, j))
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)] if anchors else []
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if i + 1 < k and j + 1 < m]
    return sorted(aligned)


def _in_turn(later: list, earlier: list, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Without a unique entry: each entry with the next place of its equal beyond the last aligned one."""
    places: dict = {}
    for j in range(b0, b1):
        places.setdefault(earlier[j], []).append(j)
    out, at = [], b0
    for i in range(a0, a1):
        own = places.get(later[i], ())
        n = bisect_left(own, at) if own else 0
        if n < len(own):
            out.append((i, own[n]))
            at = own[n] + 1
    return out


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence whose second parts rise (patience sorting)."""
    tops, at, before = [], [], [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        before[n] = at[pile - 1] if pile else -1
        tops[pile:pile + 1], at[pile:pile + 1] = [j], [n]
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def common_blocks(later: list[dict], earlier: list[dict], least: int = LEAST_CHARS) -> list[tuple[int, int]]:
    """(first, last) line numbers of the later document's aligned blocks of enough characters.

    Blank lines between two aligned lines do not break a block; lines without a partner do. Shared lines are listed by
    position among the document's non-blank lines, so that a gap shows on either side."""
    blocks, run, chars = [], [], 0
    pairs = patience([x["line"] for x in later], [x["line"] for x in earlier])
    for i, j in [*pairs, (None, None)]:
        follows = run and i is not None and (later[i]["place"] == later[run[-1][0]]["place"] + 1
                                             and earlier[j]["place"] == earlier[run[-1][1]]["place"] + 1)
        if run and not follows:
            if chars >= least:
                blocks.append((later[run[0][0]]["number"], later[run[-1][0]]["number"]))
            run, chars = [], 0
        if i is not None:
            run.append((i, j))
            chars += later[i]["chars"]
    return blocks


def _aligned(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, blocks = [], []
        for row in batch.to_pylist():
            found = common_blocks(row["later_lines"], row["earlier_lines"], least)
            if found:
                keys.append(row["later"])
                blocks.append([{"first": a, "last": b} for a, b in found])
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(blocks, kind)], ["key", "blocks"])


def deletions(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """Per document key (see ``document_key``) the blocks of line numbers to delete."""
    texts = docs.select(document_key().alias("key"), F.col("text").cast("string").alias("text"))
    lines = texts.mapInArrow(_lines, "key string, number int, line binary, chars int")
    holders = lines.groupBy("line", "key").agg(F.lit(1).alias("one"))
    counted = holders.groupBy("line").agg(F.count("*").alias("holders"), F.min("key").alias("owner"))
    shared = counted.where(F.col("holders") > 1)
    in_document = Window.partitionBy("key").orderBy("number")
    placed = lines.dropDuplicates(["key", "number"]).withColumn("place", F.row_number().over(in_document))
    held = materialise(placed.join(shared, "line").select("key", "number", "place", "line", "chars", "owner", "holders"))
    owned = held.where(F.col("owner") != F.col("key")).select(F.col("key").alias("later"), F.col("owner").alias("earlier"))
    begun = texts.mapInArrow(lambda b: _runs(b, least), "key string, run binary")
    first = F.min("key").over(Window.partitionBy("run"))  # a window, so that the runs are made and shuffled once
    blocks = begun.withColumn("earlier", first).where("key <> earlier").select(F.col("key").alias("later"), "earlier")
    pairs = owned.union(blocks).distinct()
    listed = held.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("number", "place", "line", "chars"))).alias("all"))
    joined = (pairs.join(listed.select(F.col("key").alias("later"), F.col("all").alias("later_lines")), "later")
              .join(listed.select(F.col("key").alias("earlier"), F.col("all").alias("earlier_lines")), "earlier")
              .select("later", "later_lines", "earlier_lines"))
    found = joined.mapInArrow(lambda b: _aligned(b, least), "key string, blocks array<struct<first: int, last: int>>")
    return found.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks"))


def clean(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """The rows of ``docs`` with their text after deletion, and _deleted: the number of lines deleted."""
    blocks = deletions(docs, least).select(F.col("key").alias("_key"), F.col("blocks").alias("_blocks"))
    lines = F.split(F.col("text").cast("string"), "\n")
    kept = F.filter(lines, lambda line, i: ~F.exists("_blocks", lambda b: (b["first"] <= i) & (i <= b["last"])))
    marked = docs.withColumn("_key", document_key()).join(blocks, "_key", "left")
    return marked.select(
        *[F.col(c) if c != "text" else
          F.when(F.col("_blocks").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text")
          for c in docs.columns],
        F.when(F.col("_blocks").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(kept)).alias("_deleted"))
