"""Substring dedup: paragraph MinHash banding.

A passage may stand anywhere in a line, so paragraphs are cut by content: a border stands before
each word pair whose hash is the strict minimum of its neighbourhood of RADIUS pairs on both
sides, which depends on the words around it alone; a passage of more than fifty words that stands
in two texts is cut alike in both but for its ends. Where words recur with a short period no minimum
is strict; there equal minima are borders, about STRETCH words apart. Each paragraph's shingle set gives BANDS keys of ROWS
MinHash values (with 4 bands of 2, paragraphs of similarity 0.8 meet with probability 0.98, equal
ones always). Colliding paragraphs are verified by exact Jaccard; components of the links are the
clusters, and all but the first paragraph of a cluster can be removed.

Equal paragraphs are one node, so that copies in any number cost one row each. Band keys are written
with the occurrences; only paragraphs of keys with different paragraphs are looked at again, in one
more pass over the texts, for their shingles. Documents are told apart by row, since ids may repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from behavex.llm.common import _POSITION, Scratch, blocks, cut, free_name, hashed_words, lookup_counted, mix, row_key, semi, table
from behavex.llm.components import components, connect

RADIUS, LEAST_WORDS = 5, 6
#: Words between borders in a stretch of few words said over and over.
STRETCH = 10
#: Repeated paragraphs count where they follow one another over at least so many words, or lie with LEAST_WORDS words or
#: more in so many words that stand elsewhere too. (A parameter of repeated_passages; 1 gives every repeated paragraph.)
LEAST_RUN = 20
BANDS, ROWS = 4, 2
HOT, SALTS = 64, 4
_FAR = np.uint64(0xFFFFFFFFFFFFFFFF)
_KEYS = [f"k{b}" for b in range(BANDS)]
#: A row's id, its number and its key.
_OWN = ["doc_id", "row", "r1", "r2"]


def _power(n: int) -> np.ndarray:
    out = np.full(n, np.uint64(0xD6E8FEB86659FD93), dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _periodic(tied: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of the places of equal minima those that are borders: from the first place of a stretch on, one in each STRETCH words."""
    of = doc[tied]
    new = np.ones(len(tied), dtype=bool)
    new[1:] = (np.diff(tied) > RADIUS) | (of[1:] != of[:-1])
    step = (tied - tied[new][np.cumsum(new) - 1]) // STRETCH
    new[1:] |= step[1:] != step[:-1]
    return tied[new]


def paragraphs(words: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, ...]:
    """Of the texts' word hashes (text i has words at[i]:at[i+1]): (text, first word in words, words, id, distinct shingles' hashes flat,
    their borders) of each paragraph of LEAST_WORDS words or more."""
    docs, n = len(at) - 1, len(words)
    none = np.zeros(0, dtype=np.int64)
    if n < LEAST_WORDS:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none
    doc = np.repeat(np.arange(docs), np.diff(at))
    with np.errstate(over="ignore"):
        pair = np.full(n, _FAR)
        pair[1:] = mix(words[:-1] * _POSITION[7] + words[1:] * _POSITION[8])
        first = np.zeros(n, dtype=bool)
        first[at[:-1][np.diff(at) > 0]] = True
        pair[first] = _FAR
        padded = np.full(n + RADIUS * (docs + 1), _FAR)
        spot = np.arange(n) + RADIUS * (doc + 1)
        padded[spot] = pair
        windows = np.lib.stride_tricks.sliding_window_view(padded, RADIUS)
        least = windows.min(1)
        left, right = least[spot - RADIUS], np.r_[least, np.full(RADIUS, _FAR)][spot + 1]
        border = (pair < left) & (pair < right)
        tied = np.flatnonzero((pair <= left) & (pair <= right) & ~border & (pair != _FAR))
        if len(tied):
            border[_periodic(tied, doc)] = True
        start = np.flatnonzero(border | first)
        size = np.diff(np.r_[start, n])
        keep = size >= LEAST_WORDS
        start, size = start[keep], size[keep]
        long = np.diff(at)
        short = np.flatnonzero((long >= LEAST_WORDS) & (long < 2 * LEAST_RUN))  # a short text is a paragraph as a whole too
        short = short[~np.isin(at[:-1][short] * (2 * LEAST_RUN) + long[short], start[size < 2 * LEAST_RUN] * (2 * LEAST_RUN) + size[size < 2 * LEAST_RUN])]
        start, size = np.r_[start, at[:-1][short]], np.r_[size, long[short]]
        if not len(start):
            return none, none, none, none.view(np.uint64), none.view(np.uint64), none
        local = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        flat = np.repeat(start, size) + local
        whole = mix(np.add.reduceat(words[flat] * _power(int(size.max()))[local], np.cumsum(size) - size) + size.astype(np.uint64))
        count = size - k + 1
        local = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        flat = np.repeat(start, count) + local
        sh = words[flat] * _POSITION[0]
        for j in range(1, k):
            sh = sh + words[flat + j] * _POSITION[j]
    return doc[start], start, size, whole, mix(sh), np.cumsum(count) - count


def band_keys(sh: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
    """BANDS keys of each paragraph."""
    out = []
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            key = np.full(len(cuts), np.uint64(b))
            for r in range(ROWS):
                key = mix(key ^ np.minimum.reduceat(mix(sh ^ _POSITION[b * ROWS + r]), cuts))
            out.append(key)
    return out


def _occurrences(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in it:
        for first, held in blocks(rb.column("text")):
            words, at = hashed_words(held)
            doc, start, size, whole, sh, cuts = paragraphs(words, at)
            if len(whole):
                back = np.flatnonzero(np.diff(start) <= 0)  # short texts as a whole come last; they meet equal ones only
                without = np.arange(len(start)) > (back[0] if len(back) else len(start))
                keys = [pa.array(k.view(np.int64), mask=without) for k in band_keys(sh, cuts)]
                own = [rb.column(c).take(pa.array(first + doc)) for c in _OWN]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(at)[doc], type=pa.int32()), pa.array(start - at[doc], type=pa.int32()), pa.array(size, type=pa.int32()), pa.array(whole.view(np.int64)), *keys], names=[*_OWN, "total", "start", "n_words", "id", *_KEYS])


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each paragraph's shingles, repeated ones too, in one buffer a block."""
    for rb in it:
        for _, held in blocks(rb.column("text")):
            words, at = hashed_words(held)
            *_, whole, sh, cuts = paragraphs(words, at)
            if len(whole):
                edges = (np.r_[cuts, len(sh)] * 8).astype(np.int64)
                parts = pa.Array.from_buffers(pa.large_binary(), len(whole), [None, pa.py_buffer(edges), pa.py_buffer(sh)])
                yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), parts.cast(pa.binary())], names=["id", "shingles"])


def _distinct(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, distinct shingles, their 64-bit parity sketch)."""
    for rb in it:
        sets = [np.unique(np.frombuffer(x.as_py(), dtype=np.uint64)) for x in rb.column("shingles")]
        parity = np.array([np.bitwise_xor.reduce(np.uint64(1) << (x >> np.uint64(58))) for x in sets], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([rb.column("id"), pa.array([x.tobytes() for x in sets], type=pa.binary()), pa.array(parity)], names=["id", "shingles", "parity"])


def _surroundings(least_run: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, at, window): the hashes of the least_run words from each place on that have LEAST_WORDS words of a marked paragraph."""
        for rb in it:
            rows, marks = rb.column("row"), rb.column("marks")
            for first, held in blocks(rb.column("text")):
                words, at = hashed_words(held)
                for i in range(len(held)):
                    w = words[at[i] : at[i + 1]]
                    if len(w) < least_run:
                        continue
                    ms = marks[first + i].as_py()
                    last = len(w) - least_run + 1
                    edges = np.zeros(last + 1, dtype=np.int64)
                    for m in ms:
                        a, b = max(0, m["start"] + LEAST_WORDS - least_run), min(last, m["start"] + m["n_words"] - LEAST_WORDS + 1)
                        if a < b:
                            edges[a] += 1
                            edges[b] -= 1
                    place = np.flatnonzero(np.cumsum(edges[:-1]))
                    if len(place):
                        with np.errstate(over="ignore"):
                            power = _power(least_run)
                            windows = mix(np.concatenate([(w[np.add.outer(part, np.arange(least_run))] * power).sum(1, dtype=np.uint64) for part in np.array_split(place, len(place) // 4096 + 1)]))
                        yield pa.RecordBatch.from_arrays([pa.array([rows[first + i].as_py()] * len(place), type=pa.int64()), pa.array(place, type=pa.int32()), pa.array(windows.view(np.int64))], names=["row", "at", "window"])

    return run


def _within_longer(texts: DataFrame, out: DataFrame, least_run: int, across: bool) -> DataFrame:
    """The rows of out in runs of fewer than least_run words whose passage goes on beyond its borders to least_run words or more.

    All occurrences of such a run's clusters are compared, also those in longer runs, by the windows around them, never pair by pair."""
    short = cut(out.where(F.col("length") < least_run), "short")
    marked = semi(out, short.select("cluster_id").distinct(), "cluster_id")
    marks = cut(marked.groupBy("row", "r1", "r2").agg(F.collect_set(F.struct("start", "n_words")).alias("marks")), "marks")
    held = semi(texts, marks.select("r1", "r2").distinct(), ["r1", "r2"]).select("r1", "r2", "text").dropDuplicates(["r1", "r2"])
    windows = cut(held.join(marks, ["r1", "r2"]).mapInArrow(_surroundings(least_run), "row long, at int, window long"), "windows")
    place = F.col("row") if across else F.struct("row", "at")
    shared = windows.groupBy("window").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("window")
    hits = windows.join(shared, "window", "left_semi").groupBy("row").agg(F.array_sort(F.collect_set("at")).alias("hits"))
    low, high = F.col("start") + (LEAST_WORDS - least_run), F.col("start") + F.col("n_words") - LEAST_WORDS
    return short.join(hits, "row").where(F.exists("hits", lambda x: (x >= low) & (x <= high))).select(out.columns)


def _similar(num: int, den: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            good = []
            for a, b in zip(rb.column("sx"), rb.column("sy"), strict=True):
                p, q = np.frombuffer(a.as_py(), dtype=np.uint64), np.frombuffer(b.as_py(), dtype=np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(den * both >= num * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([rb.column(c) for c in "xy"], names=["x", "y"]).filter(pa.array(good, type=pa.bool_()))

    return run


def repeated_passages(docs: DataFrame, num: int = 80, den: int = 100, least_run: int = LEAST_RUN, across: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, copy, start, n_words, cluster_id, keeper_doc_id, keeper_start, removed, across, r1, r2): a row for each
    occurrence of a paragraph whose cluster has more than one. start counts the text's words from 0; across says whether the
    cluster has occurrences in several documents.

    Of a text, only runs of adjoining repeated paragraphs of least_run words or more are given, runs that are the whole text, and paragraphs of shorter
    runs whose passage has so many words with those before and after it, so that a short common line at a text's edge is
    none. A text of LEAST_WORDS to 2 * LEAST_RUN - 1 words is a paragraph as a whole as well, so that equal short texts are given; least_run=1 gives every repeated paragraph. With across=True, repeats within one document alone are left out.
    The cluster's first occurrence by (doc_id, start, row) is kept, the others are removed. Null ids come
    last; texts of fewer than LEAST_WORDS words, empty and null ones have no paragraphs. Each row is a document, whatever its id: rows that
    repeat doc_id and text are told apart by copy (from 0), others by (r1, r2), their row_key. Other columns are ignored."""
    with Scratch(docs.sparkSession) as scratch:
        keyed = [c.alias(f"r{i}") for i, c in enumerate(row_key(), 1)]
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"), *keyed)
        found = cut(texts.mapInArrow(_occurrences, "doc_id long, row long, r1 long, r2 long, total int, start int, n_words int, id long" + "".join(f", {k} long" for k in _KEYS)), "occurrences")
        joined = components(_similar_paragraphs(texts, found, num, den))

        place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "start", "row")
        each = found.groupBy("id").agg(F.count("*").alias("n"), F.min(place).alias("keeper"), F.min("row").alias("low"), F.max("row").alias("high"))
        each = each.join(joined, "id", "left").where("n > 1 or component is not null")
        each = cut(each.withColumn("cluster_id", F.coalesce("component", "id")), "each")
        whole = each.groupBy("cluster_id").agg(F.sum("n").alias("all"), F.min("keeper").alias("keeper"), (F.min("low") != F.max("high")).alias("across")).where("all > 1" + (" and across" if across else ""))
        each = cut(each.select("id", "n", "cluster_id").join(whole.drop("all"), "cluster_id"), "members")
        out = lookup_counted(found.drop(*_KEYS), each, "id").drop("n")
        out = out.withColumn("removed", (F.col("keeper.row") != F.col("row")) | (F.col("keeper.start") != F.col("start")))
        end = F.col("start") + F.col("n_words")
        by = W.partitionBy("row").orderBy("start", "n_words")
        out = out.withColumn("new", F.coalesce(F.col("start") > F.max(end).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(True)).cast("int"))
        out = out.withColumn("run", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
        run = W.partitionBy("row", "run")
        length = F.max(end).over(run) - F.min("start").over(run)
        out = out.withColumn("length", F.when(length == F.col("total"), 1 << 30).otherwise(length))
        out = cut(out.select(*_OWN, "start", "n_words", "cluster_id", F.col("keeper.doc_id").alias("keeper_doc_id"), F.col("keeper.start").alias("keeper_start"), "removed", "across", "length"), "runs")
        good = out.where(F.col("length") >= least_run)
        if least_run > 1:
            good = good.unionByName(_within_longer(texts, out, least_run, across))
        again = cut(texts.groupBy("r1", "r2").agg(F.count("*").alias("m")).where("m > 1").select("r1", "r2"), "again")
        copies = semi(good.select("r1", "r2", "row").distinct(), again, ["r1", "r2"])
        # numbered within each part of the scan, from where the parts before it end, so that very many copies are spread over tasks
        held = cut(semi(found.select("r1", "r2", "row"), again, ["r1", "r2"]).distinct().withColumn("part", F.shiftright("row", 33)), "copied")
        before = F.sum("m").over(W.partitionBy("r1", "r2").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
        parts = held.groupBy("r1", "r2", "part").agg(F.count("*").alias("m")).withColumn("before", F.coalesce(before, F.lit(0))).drop("m")
        within = held.withColumn("i", F.row_number().over(W.partitionBy("r1", "r2", "part").orderBy("row")) - 1)
        number = within.join(parts, ["r1", "r2", "part"]).select("row", (F.col("before") + F.col("i")).cast("int").alias("copy"))
        copies = copies.select("row").join(number, "row")
        good = good.join(cut(copies, "copies"), "row", "left").withColumn("copy", F.coalesce("copy", F.lit(0)))
        return scratch.result(good.select("doc_id", "copy", "start", "n_words", "cluster_id", "keeper_doc_id", "keeper_start", "removed", "across", "r1", "r2"), "passages")


def _similar_paragraphs(texts: DataFrame, found: DataFrame, num: int, den: int) -> DataFrame:
    """Verified links (u, v) of unequal paragraphs that connect what all links of colliding ones connect."""
    banded = found.select(F.explode(F.array(*_KEYS)).alias("key"), "id").where("key is not null")
    keys = cut(banded.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("key"), "keys")
    met = cut(semi(banded, keys, "key").distinct(), "met")
    sets = semi(texts.select("text").mapInArrow(_sets, "id long, shingles binary"), met.select("id").distinct(), "id").dropDuplicates(["id"])
    sets = cut(sets.mapInArrow(_distinct, "id long, shingles binary, parity long"), "sets")
    count = met.groupBy("key").agg(F.count("*").alias("n"))
    salt = F.when(F.col("n") > HOT, F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).cast("int")
    kept = cut(met.select("key", "id").join(count, "key").select("key", F.col("id").alias("doc"), salt.alias("salt")), "kept")

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s{c}"))
        return pairs.join(side("x"), "x").join(side("y"), "y").mapInArrow(_similar(num, den), "x long, y long")

    def near(a: str, b: str) -> Column:
        """Sizes allow the similarity, and so does the parity sketches' Hamming distance, a lower bound of the difference."""
        p, q = F.col(f"{a}.n"), F.col(f"{b}.n")
        apart = F.bit_count(F.col(f"{a}.parity").bitwiseXOR(F.col(f"{b}.parity")))
        return (p * den >= q * num) & (q * den >= p * num) & (apart * (den + num) <= (p + q) * (den - num))

    lengths = sets.select(F.col("id").alias("doc"), (F.length("shingles") / 8).cast("int").alias("n"), "parity")
    return connect(kept, verify, lengths, near)


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or adjoin as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_passages(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """docs with text less the paragraphs that repeats (of the same docs) marks as removed, each row by its own marks. Of rows that
    repeat doc_id and text it is not said which is which copy."""
    marks = repeats.where("removed").groupBy("r1", "r2", "copy").agg(F.collect_set(F.struct("start", "n_words")).alias("marks"))
    names = {c: free_name(docs, c) for c in ("r1", "r2", "copy", "marks")}
    marks = marks.select(*(F.col(c).alias(n) for c, n in names.items()))
    key = [names["r1"], names["r2"]]
    keyed = docs.withColumns(dict(zip(key, row_key(), strict=True)))
    again = marks.where(F.col(names["copy"]) > 0).select(*key).distinct()
    number = (F.row_number().over(W.partitionBy(*key).orderBy(*key)) - 1).cast("int")
    numbered = semi(keyed, again, key).withColumn(names["copy"], number).unionByName(semi(keyed, again, key, how="left_anti").withColumn(names["copy"], F.lit(0)))

    @F.pandas_udf("string")
    def clean(text, marks):
        out = []
        for t, ms in zip(text, marks, strict=True):
            if t is not None and ms is not None and len(ms):
                spans = [(m.start(), m.end()) for m in _WORD.finditer(t)] + [(len(t), len(t))]
                for a, b in reversed(_merged((m["start"], m["start"] + m["n_words"]) for m in ms)):
                    t = t[: spans[a][0]] + t[spans[min(b, len(spans) - 1)][0] :]
            out.append(t)
        return type(text)(out)

    joined = numbered.join(marks, [*key, names["copy"]], "left")
    return joined.withColumn("text", F.when(F.col(names["marks"]).isNull(), F.col("text")).otherwise(clean("text", names["marks"]))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents."""
    return repeated_passages(table(spark, sf_dir, "documents"), across=True)
