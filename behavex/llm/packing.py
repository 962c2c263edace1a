"""Best-fit packing by large-item matching.

Pieces of at most `capacity` tokens fill sequences. How many pieces of each length there are
(a histogram of at most `capacity` rows, whatever the corpus) decides the packing: pieces above
one third of the capacity stand at most twice in a sequence and are matched greedily, largest
first with the largest partner that fits; then smaller pieces, largest first, go where the gap is
smallest. Runs of equal sequences are handled at once, so the plan is a few thousand slots: the
pieces of one length with ranks from..to stand at one offset of consecutive sequences. Pieces get
their rank within their length by per-bucket counts and prefix sums, and meet their slot in a
broadcast join.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from behavex.llm.common import Scratch, cut, table
from behavex.llm.tokens import encoder, tokenizer_path

END = 2


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, ranks, first sequence, offset) for counts pieces of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    slots: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, how many)
    sizes: list[int] = []  # gaps that have runs, ascending
    sequences = 0

    def put(n: int, count: int, first: int, offset: int) -> None:
        slots.append((n, rank[n], count, first, offset))
        rank[n] += count
        left[n] -= count

    def leave(gap: int, first: int, count: int) -> None:
        if gap:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, count))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            partner = next((m for m in large if m <= n and n + m <= capacity and left[m] > (m == n)), None)
            count = left[n] if partner is None else left[n] // 2 if partner == n else min(left[n], left[partner])
            put(n, count, sequences, 0)
            if partner is not None:
                put(partner, count, sequences, n)
            leave(capacity - n - (partner or 0), sequences, count)
            sequences += count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(sizes, n)
            if at == len(sizes):  # no gap is large enough: as many new sequences as these pieces need
                new = -(-left[n] // (capacity // n))
                leave(capacity, sequences, new)
                sequences += new
                continue
            gap = sizes[at]
            first, there = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                sizes.pop(at)
            count = min(left[n], there)
            put(n, count, first, capacity - gap)
            leave(gap - n, first, count)
            if count < there:
                leave(gap, first + count, there - count)
    return slots


def _cut(path: str, capacity: int, end: int, with_ids: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for rb in it:
            cols: list[list] = [[], [], [], [], [], [], []]
            for doc, row, text in zip(rb.column("doc_id"), rb.column("row"), rb.column("text"), strict=True):
                ids = np.array([*enc.encode(text.as_py() or ""), end], dtype="<u4")
                head = len(ids) % capacity or capacity
                edges = [0, *range(head, len(ids) + 1, capacity)]
                for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    for c, v in zip(cols, (doc.as_py(), row.as_py(), i, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].astype(np.int32) if with_ids else None), strict=True):
                        c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def pack(docs: DataFrame, path: str, capacity: int = 1024, end: int = END, with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]).

    Each document is its token ids and `end`; null and empty text is `end` alone. One longer than
    the capacity is cut: the first piece takes the remainder, the others are full. Repeated rows
    and null ids are packed like any other; an empty table gives none. With with_ids the token
    ids come along, so that concatenating a sequence's pieces by offset gives its content."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
        pieces = rows.mapInArrow(_cut(path, capacity, end, with_ids), "doc_id long, row long, piece int, start long, length long, ids_crc32 long, ids array<int>")
        pieces = cut(pieces if with_ids else pieces.drop("ids"), "pieces")
        bucket = pieces.withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(1024)).cast("int"))
        counts = bucket.groupBy("length", "bucket").agg(F.count("*").alias("n"))
        counts = counts.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
        counts = cut(counts.select("length", "bucket", "n", F.coalesce("before", F.lit(0)).alias("before")), "counts")  # at most 1024 rows a length
        histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
        slots = spark.createDataFrame(plan(histogram, capacity), "length long, low long, ranks long, first long, offset long")
        ranked = bucket.withColumn("r", F.row_number().over(W.partitionBy("length", "bucket").orderBy("row", "piece")) - 1)
        ranked = ranked.join(counts.select("length", "bucket", "before"), ["length", "bucket"]).withColumn("r", F.col("r") + F.col("before"))
        slots = F.broadcast(slots.withColumnRenamed("length", "slot_length"))
        placed = ranked.join(slots, (F.col("length") == F.col("slot_length")) & (F.col("r") >= F.col("low")) & (F.col("r") < F.col("low") + F.col("ranks")))
        out = placed.withColumn("sequence_id", F.col("first") + F.col("r") - F.col("low"))
        return scratch.result(out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])), "packed")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the sequences of what is left."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))
