"""Toxicity by FTRL-proximal logistic regression (McMahan et al., 2013) over hashed word n-grams and skip-grams.

A text's features are which of its n-grams occur: single words, two and three in a row, two with one or two words between them, and
beginnings of single words (their first 4, 6, 8 and 10 bytes), so that word forms never seen in training still count. Each is hashed to one of 2^20 coordinates. Every coordinate has its own learning rate, and the L1 penalty leaves most weights at exactly zero:
what is broadcast for scoring is the few thousand that are not.

Training takes at most `LABELLED` labelled rows, those with the smallest hash of doc_id. Their features are written once, dealt to a fixed
number of shards and in the order of their hashes; in each epoch, a pass over that table without a shuffle, the shards train side by side from the common state, which then becomes the mean over the shards that
touched a coordinate. The result depends neither on the number of executors nor on the order of rows. Scoring is one pass over whole texts
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from behavex.llm.common import LOWER, Scratch, blocks, mix, new_path, span_hashes, table, word_spans

#: Bound of the training sample; how many shards train at a time.
LABELLED, SHARDS, EPOCHS = 12_000, 4, 4
BITS, THRESHOLD = 20, 0.3
#: Learning rate's scale and offset, L1 and L2 penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 1.0

#: Offsets of the words of one gram from its first; bytes of the words' beginnings.
GRAMS = ((0,), (0, 1), (0, 1, 2), (0, 2), (0, 3))
BEGINNINGS = (4, 6, 8, 10)

_NOT_WORD = np.ones(256, dtype=bool)
_NOT_WORD[48:58] = _NOT_WORD[65:91] = _NOT_WORD[97:123] = _NOT_WORD[128:] = False
_ODD = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def grams(held: list[bytes], bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, coordinate) of every gram of every text, one kind at a time; a gram may come repeatedly."""
    buf = LOWER[np.frombuffer(b"".join(held), dtype=np.uint8)]
    at = np.zeros(len(held) + 1, dtype=np.int64)
    np.cumsum([len(b) for b in held], out=at[1:])
    starts, ends = word_spans(buf, at[:-1], _NOT_WORD)
    doc = np.searchsorted(at, starts, side="right") - 1
    words = span_hashes(buf, starts, ends)

    def place(h: np.ndarray, kind: int) -> np.ndarray:
        return (mix(h * _ODD[40 + kind]) >> np.uint64(64 - bits)).astype(np.int64)

    with np.errstate(over="ignore"):
        for kind, offsets in enumerate(GRAMS):
            span = offsets[-1]
            n = max(0, len(words) - span)
            total = np.full(n, _ODD[kind], dtype=np.uint64)
            for i, o in enumerate(offsets):
                total += words[o : o + n] * _ODD[20 + i]
            same = doc[:n] == doc[span : span + n]
            yield doc[:n][same], place(total[same], kind)
        for kind, size in enumerate(BEGINNINGS, len(GRAMS)):
            longer = ends - starts > size
            yield doc[longer], place(span_hashes(buf, starts[longer], starts[longer] + size), kind)


def coordinates(held: list[bytes], bits: int = BITS) -> list[np.ndarray]:
    """The distinct coordinates of each text, ascending."""
    pairs = [d * (1 << bits) + x for d, x in grams(held, bits)]
    found = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, dtype=np.int64)
    return [x & ((1 << bits) - 1) for x in np.split(found, np.searchsorted(found, np.arange(1, len(held)) << bits))]


class Ftrl:
    """State of the optimiser: z and n of each coordinate; the last coordinate is the constant, without an L1 penalty."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1, dtype=np.float32), np.zeros(size + 1, dtype=np.float32)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at].astype(np.float64), self.n[at].astype(np.float64)
        l1 = np.full(len(z), self.l1)
        l1[-1] = 0.0  # the constant is always the last of those asked for
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, x: np.ndarray, y: int) -> None:
        """One row: its distinct coordinates and its label."""
        at = np.append(x, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at].astype(np.float64)
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += (g - sigma * w).astype(np.float32)
        self.n[at] += np.float32(g * g)


def _in_hash_order(doc_id: str = "doc_id") -> list[Column]:
    return [F.xxhash64(doc_id), F.col(doc_id)]


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string") if isinstance(doc_id, str) else doc_id) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, toxic) of the labelled rows to learn from: not held out, one text an id (that of the smallest hash), the largest of several labels."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    here = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    chosen = here.orderBy(*_in_hash_order()).limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).join(F.broadcast(chosen), "doc_id")  # at most `most` rows
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "toxic"), F.xxhash64("text")).alias("x")).select("doc_id", "x.text", "x.toxic")


def _with_coordinates(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in it:
        for at, held in blocks(rb.column("text")):
            x = pa.array([c.astype(np.int32).tobytes() for c in coordinates(held)], type=pa.binary())
            yield pa.RecordBatch.from_arrays([rb.column("doc_id").slice(at, len(held)), rb.column("toxic").slice(at, len(held)), x], names=["doc_id", "toxic", "x"])


def _epoch(state: Broadcast, size: int):
    """Each shard's rows in their order, from the common state (z and n) -> (shard, rows, the coordinates it touched, their state)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows, last, model, touched = None, 0, None, None, None

        def done() -> pa.RecordBatch:
            at = np.flatnonzero(touched).astype(np.int32)
            parts = (pa.array([x.tobytes()], pa.binary()) for x in (at, model.z[at], model.n[at]))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([rows], pa.int64()), *parts], names=["shard", "rows", "at", "z", "n"])

        for rb in it:
            for s, place, y, x in zip(*(rb.column(c).to_pylist() for c in ("shard", "place", "toxic")), rb.column("x"), strict=True):
                if s != shard:
                    if shard is not None:
                        yield done()
                    model, touched = Ftrl(size), np.zeros(size + 1, dtype=bool)
                    model.z[:], model.n[:] = state.value
                    touched[size] = True
                    shard, rows, last = s, 0, place
                if place < last:
                    raise ValueError("a shard's rows are out of order")
                at = np.frombuffer(x.as_buffer(), dtype=np.int32)
                touched[at] = True
                model.learn(at, int(y > 0))
                rows, last = rows + 1, place
        if shard is not None:
            yield done()

    return run


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = LABELLED, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float] | float:
    """(coordinates, weights, constant) of what is not zero; where labels have one class only (or there are none), their share of ones.

    What reaches the driver is the shards' states, at most 12 bytes a coordinate and shard."""
    size = 1 << BITS
    with Scratch(docs.sparkSession) as scratch:
        place = F.xxhash64("doc_id")
        sample = _sample(docs, labels, most_labelled).repartition(4 * SHARDS, "doc_id").mapInArrow(_with_coordinates, "doc_id long, toxic int, x binary")
        dealt = sample.select(F.pmod(place, F.lit(SHARDS)).alias("shard"), place.alias("place"), "doc_id", "toxic", "x").repartition(SHARDS, "shard").sortWithinPartitions("shard", "place", "doc_id")
        path = new_path(docs.sparkSession, "features")
        scratch.paths.append(path)
        dealt.write.option("parquet.block.size", 1 << 30).parquet(path)  # a shard is one row group, which one task reads from first to last
        rows = docs.sparkSession.read.schema(dealt.schema).parquet(path)
        classes = rows.agg(F.count("*"), F.sum((F.col("toxic") > 0).cast("long"))).first()
        if not classes[0] or classes[1] in (0, classes[0]):
            return float(classes[1] or 0) / max(1, classes[0])
        model = Ftrl(size)
        for _ in range(epochs):
            total, seen, shards = np.zeros((2, size + 1)), np.zeros(size + 1), {}
            state = docs.sparkSession.sparkContext.broadcast((model.z, model.n))  # 8 bytes a coordinate, at any size of the input
            epoch = rows.select("shard", "place", "x", "toxic").mapInArrow(_epoch(state, size), "shard long, rows long, at binary, z binary, n binary")
            for r in epoch.toLocalIterator():
                at = np.frombuffer(r.at, dtype=np.int32)
                total[0, at] += np.frombuffer(r.z, dtype=np.float32)
                total[1, at] += np.frombuffer(r.n, dtype=np.float32)
                seen[at] += 1
                shards[r.shard] = shards.get(r.shard, 0) + 1
            state.destroy()
            if set(shards.values()) != {1}:
                raise RuntimeError("a shard was read in several pieces")
            now = seen > 0
            model.z[now], model.n[now] = (total[:, now] / seen[now]).astype(np.float32)
    w = model.weights()
    at = np.flatnonzero(w[:-1])
    return at, w[at], float(w[-1])


def _scorer(model: tuple[np.ndarray, np.ndarray, float] | float, bits: int = BITS):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if isinstance(model, float):
            for rb in it:
                yield pa.RecordBatch.from_arrays([rb.column("doc_id"), rb.column("held_out"), pa.array(np.full(rb.num_rows, model))], names=["doc_id", "held_out", "score"])
            return
        at, w, constant = model
        dense = np.zeros(1 << bits)
        dense[at] = w
        for rb in it:
            for first, held in blocks(rb.column("text")):
                found = [np.zeros(0, dtype=np.int64)]
                for doc, x in grams(held, bits):
                    good = dense[x] != 0  # few: the weights are sparse
                    found.append((doc[good] << bits) + x[good])
                pairs = np.unique(np.concatenate(found))  # a gram counts once a text
                z = constant + np.bincount(pairs >> bits, weights=dense[pairs & ((1 << bits) - 1)], minlength=len(held))
                yield pa.RecordBatch.from_arrays([rb.column("doc_id").slice(first, len(held)), rb.column("held_out").slice(first, len(held)), pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))], names=["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | float, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, held_out, score, predicted), a row for each row of docs.

    The score depends on the text alone. Null, empty and wordless texts get the constant's score. A null id is not held out. Rows of equal text have
    equal scores; other columns are ignored. Without labels of both classes every score is the labels' share of ones (0 without labels)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    scored = rows.mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
