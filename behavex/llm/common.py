"""Storage, text hashing and the Arrow plumbing that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextvars import ContextVar
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from behavex.sources.files import shared_folder

#: Bytes of text hashed at a time; bounds the scratch memory of a Python worker.
BLOCK_BYTES = 1 << 20

_rng = np.random.default_rng(20240101)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_POSITION = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space as in [\x20\x09-\x0D].
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


class Scratch:
    """Tables that an operator writes on its way; they go when it is done, or when it fails. Each thread has its own, so that
    operators may run side by side in one session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self._outer, self._token = spark, [], None, None

    def __enter__(self) -> Scratch:
        self._outer = _scratch.get()
        self._token = _scratch.set(self)
        return self

    def __exit__(self, *_) -> None:
        _scratch.reset(self._token)
        for path in self.paths:
            remove(self.spark, path)

    def result(self, df: DataFrame, name: str = "result") -> DataFrame:
        """Writes the operator's result, which outlives the scratch tables (an enclosing operator's Scratch has it in turn)."""
        path = new_path(self.spark, name)
        if self._outer:
            self._outer.paths.append(path)
        return _stored(df, path)


_scratch: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes a frame to the shared folder and reads it again: lineage ends there, the frame
    is computed once, and a lost executor costs a read."""
    path = new_path(df.sparkSession, name)
    if inner := _scratch.get():
        inner.paths.append(path)
    return _stored(df, path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Deletes what cut() or a Scratch's result() wrote, given the frame that it returned, once no later plan reads it."""
    remove(df.sparkSession, df.stored_at)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        size = max(n, 2 * BLOCK_BYTES)
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            _powers[key] = np.cumprod(out, dtype=np.uint64)
    return _powers[key][:n]


def word_spans(buf: np.ndarray, doc_start: np.ndarray, is_sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the words of concatenated texts; no word goes over a text's start."""
    word = ~is_sep[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cuts = doc_start[doc_start < len(buf)]
    first[cuts] = word[cuts]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = cuts[cuts > 0]
    last[inner - 1] = word[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges of buf."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[buf] * _power(_P, len(buf)), out=total[1:])
        raw = (total[ends] - total[starts]) * _power(_P_INV, len(buf))[starts]
        return mix(raw ^ (ends - starts).astype(np.uint64) * _POSITION[15])


def blocks(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) of blocks of about BLOCK_BYTES; null counts as empty."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = (t.as_py() or "").encode("utf-8", "surrogatepass")
        held.append(b)
        size += len(b)
        if size >= BLOCK_BYTES:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def hashed_words(held: list[bytes], is_sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words start (one more than texts)."""
    buf = LOWER[np.frombuffer(b"".join(held), dtype=np.uint8)]
    at = np.zeros(len(held) + 1, dtype=np.int64)
    np.cumsum([len(b) for b in held], out=at[1:])
    starts, ends = word_spans(buf, at[:-1], is_sep)
    return span_hashes(buf, starts, ends), np.searchsorted(starts, at)


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of k consecutive words; of fewer words, one of the whole sequence."""
    n = len(words)
    if not n:
        return words
    with np.errstate(over="ignore"):
        if n < k:
            return mix((words * _POSITION[:n]).sum(keepdims=True) + np.uint64(n))
        out = words[: n - k + 1] * _POSITION[0]
        for j in range(1, k):
            out = out + words[j : n - k + 1 + j] * _POSITION[j]
        out = mix(out)
    out.sort()
    keep = np.ones(len(out), dtype=bool)
    np.not_equal(out[1:], out[:-1], out=keep[1:])
    return out[keep]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fits_broadcast(df: DataFrame, most_rows: int) -> bool:
    """Whether a frame has at most so many rows; it counts no further than one row more."""
    return df.limit(most_rows + 1).count() <= most_rows


def semi(left: DataFrame, ids: DataFrame, on: str | list[str], most_rows: int = 1_000_000, how: str = "left_semi") -> DataFrame:
    """left_semi (or left_anti) by broadcast while the key list has a checked size, else by shuffle."""
    return left.join(F.broadcast(ids) if fits_broadcast(ids, most_rows) else ids, on, how)


def lookup(left: DataFrame, right: DataFrame, key: str, most_rows: int = 1_000_000, salts: int = 16, how: str = "left") -> DataFrame:
    """left joined to the few columns that right, whose key is unique, has for the key, null where it has none (how="inner": without such rows). By broadcast
    while right has a checked size; else each row of right is repeated for each salt, so that a hot key of left is spread."""
    if fits_broadcast(right, most_rows):
        return left.join(F.broadcast(right), key, how)
    salt = free_name(left, "salt")
    spread = left.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return spread.join(right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [key, salt], how).drop(salt)


def lookup_counted(left: DataFrame, right: DataFrame, key: str | list[str], n: str = "n") -> DataFrame:
    """Inner join with a right side of unique keys that also says how many rows of left each key has. Keys of more than a
    100,000th of all of them (so 100,000 at most) are broadcast; none of those that are shuffled is large for a task."""
    most = (right.agg(F.sum(n)).first()[0] or 0) // 100_000
    hot = right.where(F.col(n) > max(most, 10_000))
    rare = left.join(F.broadcast(hot.select(*[key] if isinstance(key, str) else key)), key, "left_anti").join(right.where(F.col(n) <= max(most, 10_000)), key)
    return left.join(F.broadcast(hot), key).unionByName(rare)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have (names are compared without case)."""
    have = {c.lower() for c in df.columns}
    while f"_{name}" in have:
        name = f"_{name}"
    return f"_{name}"


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """A document's key as two hashes: rows agree in both if they agree in id and text, null or not. Ids alone may repeat."""
    return [F.xxhash64(F.lit(i), F.col(doc_id).isNull(), F.col(doc_id).cast("long"), F.col(text).isNull(), text) for i in (1, 2)]


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the documents whose row_key gone has as (r1, r2)."""
    names = [free_name(docs, "r1"), free_name(docs, "r2")]
    keyed = reduce(lambda df, x: df.withColumn(*x), zip(names, row_key(), strict=True), docs)
    return semi(keyed, gone.select(F.col("r1").alias(names[0]), F.col("r2").alias(names[1])), names, how="left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
