"""Nearest neighbours by stable projections and kd-trees (after SRS, Sun et al., VLDB 2014).

Largest inner product becomes smallest distance by one more coordinate: x -> (x/M, sqrt(1 -
|x|^2/M^2)) with M the largest norm, q -> (q/|q|, 0). Gaussian (2-stable) directions, made orthogonal,
project to `dims` dimensions; projected^2 / true^2 then has no heavier a tail than chi-square with as many
degrees. A kd-tree over the projected points has its upper levels split the data into cells, which are
partitions, and its lower levels in each cell, whose leaves are left out where even their border is too
far. In a cell a query's points are verified with the original vectors in the order of their projected
distance until the chi-square test says that a better one would have been met with probability
STOP. A query starts in its own cell; then, with what it found, it visits those other cells that the
same test does not rule out.

Equal vectors are one point with its K + 1 smallest ids, which is all that any result can use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from behavex.llm.common import Scratch, cut, fits_broadcast, table

DIMS = 32
STOP = 0.87
LEAF, CELL = 256, 32768
#: Points verified at a time, and queries that meet a cell in one task.
BATCH, ASKS = 256, 1024
#: Rankings are broadcast to their queries' rows if they are no more; beyond, they are joined with salts.
FEW = 20_000
#: Rows on which the upper levels of the tree are fitted; every row is indexed.
SAMPLE = 20_000


def dims_of(d: int) -> int:
    """Projected dimensions for vectors of d components: an even number, DIMS at most."""
    return min(DIMS, (d + 1) // 2 * 2)


def chi2_cdf(x: float, m: int) -> float:
    """Chi-square distribution for an even number of degrees."""
    h = min(x / 2, 700.0)
    term = total = 1.0
    for i in range(1, m // 2):
        term *= h / i
        total += term
    return 1 - float(np.exp(-h)) * total


def chi2_quantile(p: float, m: int) -> float:
    low, high = 0.0, 10.0 * m + 100
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, m) < p else (low, mid)
    return high


def matrix(d: int, seed: int = 7) -> np.ndarray:
    """Orthogonal Gaussian directions, of such a length that a projected squared distance is on average dims_of(d) times the true one."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d + 1, dims_of(d))))
    return q * np.sqrt(d + 1)


def points(x: np.ndarray, top: float) -> np.ndarray:
    y = x / top
    return np.column_stack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))])


def queries(q: np.ndarray) -> np.ndarray:
    return np.column_stack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q))])


def split(p: np.ndarray, depth: int, least: int = 16) -> list:
    """A kd-tree as nested [axis, value, left, right]; None is a leaf."""
    if depth == 0 or len(p) < 2 * least:
        return None
    axis = int(np.argmax(np.ptp(p, axis=0)))
    value = float(np.median(p[:, axis]))
    low = p[:, axis] < value
    if not low.any() or low.all():
        return None
    return [axis, value, split(p[low], depth - 1, least), split(p[~low], depth - 1, least)]


def cells(tree: list, p: np.ndarray) -> np.ndarray:
    out, todo, n = np.zeros(len(p), dtype=np.int32), [(tree, np.arange(len(p)))], 0
    while todo:  # depth first, so that leaves are numbered alike each time
        node, rows = todo.pop()
        if node is None:
            out[rows] = n
            n += 1
        else:
            low = p[rows, node[0]] < node[1]
            todo += [(node[3], rows[~low]), (node[2], rows[low])]
    return out


def leaves(p: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    out, todo = [], [np.arange(len(p))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        axis = int(np.argmax(np.ptp(p[rows], axis=0)))
        order = rows[np.argpartition(p[rows, axis], len(rows) // 2)]
        todo += [order[: len(rows) // 2], order[len(rows) // 2 :]]
    return out


def box_distance(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows) to boxes (columns)."""
    out = np.zeros((len(q), len(low)))
    for j in range(low.shape[1]):
        out += np.maximum(0, np.maximum(low[:, j][None] - q[:, j][:, None], q[:, j][:, None] - high[:, j][None])) ** 2
    return out


def _kth(score: np.ndarray, k: int, norm: float, top: float) -> float:
    """Squared distance of the k-th best score (4, the largest there is, where there are fewer)."""
    return max(0.0, 2 - 2 * float(score.min()) / (norm * top)) if len(score) == k else 4.0


def search_cell(x: np.ndarray, first_id: np.ndarray, q: np.ndarray, known: list[np.ndarray], top: float, k: int) -> tuple[list[np.ndarray], int]:
    """Rows of x that may be among each query's k best points, nearest first, and how many pairs were verified. known: best scores met before."""
    proj, c = matrix(x.shape[1]), chi2_quantile(STOP, dims_of(x.shape[1]))
    px, pq, norm = points(x, top) @ proj, queries(q) @ proj, np.linalg.norm(q, axis=1)
    parts = leaves(px)
    order = np.concatenate(parts)
    x, px, first_id, size = x[order], px[order].astype(np.float32), first_id[order], np.array([len(r) for r in parts])
    cuts = np.cumsum(size) - size
    far = box_distance(np.minimum.reduceat(px, cuts), np.maximum.reduceat(px, cuts), pq)
    xx, out, verified = (px * px).sum(1), [], 0
    for a in range(0, len(q), 128):
        some = pq[a : a + 128].astype(np.float32)
        close = xx[None] + (some * some).sum(1)[:, None] - 2 * some @ px.T
        for i in range(len(some)):
            v, near = q[a + i], close[i]
            score, rows = np.sort(known[a + i])[::-1][:k], np.full(min(k, len(known[a + i])), -1)
            kth = _kth(score, k, norm[a + i], top)
            near[np.repeat(far[a + i] >= c * kth, size)] = np.inf
            todo = np.argpartition(near, min(BATCH, len(near)) - 1)[:BATCH] if kth == 4.0 else np.flatnonzero(near < c * kth)
            while True:
                todo = todo[np.argsort(near[todo])]
                for b in range(0, len(todo), BATCH):
                    now = todo[b : b + BATCH]
                    now = now[near[now] < c * kth]
                    if not len(now):
                        break
                    verified += len(now)
                    s = x[now] @ v
                    near[now] = np.inf
                    good = s >= score.min() if len(score) == k else np.ones(len(s), dtype=bool)
                    score, rows = np.r_[score, s[good]], np.r_[rows, now[good]]
                    keep = np.lexsort((np.where(rows < 0, -1, first_id[rows]), -score))[:k]
                    score, rows = score[keep], rows[keep]
                    kth = _kth(score, k, norm[a + i], top)
                todo = np.flatnonzero(near < c * kth)
                if not len(todo):
                    break
            out.append(order[rows[rows >= 0]])
    return out, verified


def _visit(top: float, k: int):
    def run(key, data: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(data) and len(asks):
            x, ids = np.stack(data["embedding"].to_numpy()).astype(np.float64), [np.sort(i) for i in data["ids"]]
            q, nodes = np.stack(asks["embedding"].to_numpy()).astype(np.float64), data[["n1", "n2"]].to_numpy()
            found, _ = search_cell(x, np.array([i[0] for i in ids]), q, list(asks["known"]), top, k)
            for q1, q2, v, rows in zip(asks["q1"], asks["q2"], q, found, strict=True):
                scores = (x[rows] * v).sum(1)
                best = sorted((-s, int(i), r) for s, r in zip(scores, rows, strict=True) for i in ids[r])[:k]
                out += [(q1, q2, i, -s, *nodes[r]) for s, i, r in best]
        kinds = {"q1": "int64", "q2": "int64", "vec_id": "int64", "score": "float64", "n1": "int64", "n2": "int64"}
        return pd.DataFrame(out, columns=list(kinds)).astype(kinds)

    return run


_FOUND = "q1 long, q2 long, vec_id long, score double, n1 long, n2 long"


def _best(found: DataFrame, k: int) -> DataFrame:
    """(q1, q2, best): the k best rows of each query point, in order. Few rows of a query leave a task."""
    by = W.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id", "n1", "n2")
    few = found.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k)
    return few.groupBy("q1", "q2").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score", "n1", "n2"))).alias("best"))


def _search(ok: DataFrame, d: int, k: int, every: int) -> DataFrame:
    """nearest() among vectors of d components."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, c: a + c * c))
    hashed = ok.withColumns({"n1": F.xxhash64("embedding"), "n2": F.xxhash64(F.lit(1), "embedding")})
    rank = F.row_number().over(W.partitionBy("n1", "n2").orderBy("vec_id"))
    few = hashed.withColumn("r", rank).where(F.col("r") <= k + 1)  # a hot vector's rows are dropped before they are shuffled
    nodes = few.groupBy("n1", "n2").agg(F.first("embedding").alias("embedding"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    top = float(ok.agg(F.max(norm)).first()[0]) * (1 + 1e-12)

    def project(it: Iterator[pa.RecordBatch], is_query: bool) -> Iterator[pa.RecordBatch]:
        for rb in it:
            if rb.num_rows:
                x = np.array(rb.column("embedding").to_pylist(), dtype=np.float64)
                p = (queries(x) if is_query else points(x, top)) @ matrix(d)
                yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(list(p.astype(np.float32)), type=pa.list_(pa.float32()))], names=[*rb.schema.names, "p"])

    nodes = cut(nodes.mapInArrow(lambda it: project(it, False), "n1 long, n2 long, embedding array<double>, ids array<long>, p array<float>"), "nodes")
    count = nodes.count()
    sample = nodes.orderBy("n1", "n2").limit(SAMPLE).select("p").collect() if count > CELL else []
    tree = split(np.array([r.p for r in sample]).reshape(-1, dims_of(d)), max(0, int(np.ceil(np.log2(max(1, count / CELL))))))

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            if rb.num_rows:
                p = np.array(rb.column("p").to_pylist(), dtype=np.float64)
                yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(cells(tree, p))], names=[*rb.schema.names, "cell"])

    data = cut(nodes.mapInArrow(place, "n1 long, n2 long, embedding array<double>, ids array<long>, p array<float>, cell int"), "cells")
    asked = hashed.where(F.pmod("vec_id", F.lit(every)) == 0)
    asks = asked.select(F.col("n1").alias("q1"), F.col("n2").alias("q2"), "embedding").dropDuplicates(["q1", "q2"])
    asks = asks.mapInArrow(lambda it: project(it, True), "q1 long, q2 long, embedding array<double>, p array<float>")
    asks = cut(asks.mapInArrow(place, "q1 long, q2 long, embedding array<double>, p array<float>, cell int"), "asks")
    edges = data.groupBy("cell").agg(*(f(F.col("p")[j]).alias(f"{n}{j}") for n, f in (("l", F.min), ("h", F.max)) for j in range(dims_of(d)))).collect()  # a row for each cell
    names = np.array([r.cell for r in edges], dtype=np.int32)
    boxes = [np.array([[r[f"{n}{j}"] for j in range(dims_of(d))] for r in edges], dtype=np.float64) for n in "lh"]

    def visit(to: DataFrame) -> DataFrame:
        """Each group is a cell with ASKS of its queries or so."""
        to = cut(to, "to")
        parts = to.groupBy("cell").agg(F.ceil(F.count("*") / ASKS).alias("parts"))  # a row for each cell
        there = data.join(F.broadcast(parts), "cell").select("cell", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), "n1", "n2", "ids", "embedding")
        to = to.join(F.broadcast(parts), "cell").select("cell", F.pmod(F.xxhash64("q1", "q2"), "parts").alias("part"), "q1", "q2", "embedding", "known")
        return cut(there.groupBy("cell", "part").cogroup(to.groupBy("cell", "part")).applyInPandas(_visit(top, k + 1), _FOUND), "found")

    first = visit(asks.select("cell", "q1", "q2", "embedding", F.array().cast("array<double>").alias("known")))
    if len(names) == 1:
        return _own(asked, first, k)
    c = chi2_quantile(STOP, dims_of(d))

    def more(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            if rb.num_rows:
                x, p = (np.array(rb.column(n).to_pylist(), dtype=np.float64) for n in ("embedding", "p"))
                known, home = rb.column("known"), rb.column("cell").to_numpy(zero_copy_only=False)
                kth = np.array([_kth(np.array(s.as_py()), k + 1, n, top) for s, n in zip(known, np.linalg.norm(x, axis=1), strict=True)])
                i, j = np.nonzero((box_distance(*boxes, p) < c * kth[:, None]) & (names[None] != home[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(names[j]), *(rb.column(n).take(pa.array(i)) for n in ("q1", "q2", "embedding", "known"))], names=["cell", "q1", "q2", "embedding", "known"])

    got = _best(first, k + 1).select("q1", "q2", F.col("best.score").alias("known"))
    again = asks.join(got, ["q1", "q2"], "left").select("q1", "q2", "embedding", "cell", "p", F.coalesce("known", F.array().cast("array<double>")).alias("known"))
    return _own(asked, first.unionByName(visit(again.mapInArrow(more, "cell int, q1 long, q2 long, embedding array<double>, known array<double>"))), k)


def _own(asked: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Each query row's ranking from its point's: its own row goes."""
    best = cut(_best(found, k + 1), "best").withColumnRenamed("q1", "n1").withColumnRenamed("q2", "n2")
    rows = asked.select(F.col("vec_id").alias("query_id"), "n1", "n2")
    if fits_broadcast(best, FEW):
        rows = rows.join(F.broadcast(best), ["n1", "n2"])
    else:  # a hot vector's queries are spread
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(16))).join(best.withColumn("salt", F.explode(F.expr("sequence(0L, 15L)"))), ["n1", "n2", "salt"])
    own = F.array_position(F.transform("best", lambda x: (x["vec_id"] == F.col("query_id")) & (x["n1"] == F.col("n1")) & (x["n2"] == F.col("n2"))), True)
    rows = rows.withColumn("own", own)
    left = F.slice(F.filter("best", lambda x, i: i + 1 != F.col("own")), 1, k)
    return rows.select("query_id", F.posexplode(left).alias("r", "x")).select("query_id", (F.col("r") + 1).alias("rank"), "x.vec_id", "x.score")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> (query_id, rank, vec_id, score): for each row whose vec_id is divisible by
    `every`, the k other rows with the largest inner products, found with high probability.

    Ties go to the smaller vec_id; with fewer than k other rows all are given. Null vectors, zero vectors, vectors with null or non-finite
    components and rows without vec_id take no part. Vectors meet those of their own length. Rows that share a vec_id,
    repeated rows too, are rows of their own, as queries and as candidates. An empty table gives an empty result."""
    spark = vectors.sparkSession
    ok = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null and size(embedding) > 0")
    ok = ok.where(F.forall("embedding", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))) & F.exists("embedding", lambda c: c != 0))
    with Scratch(spark) as scratch:
        out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        for (d,) in ok.select(F.size("embedding")).distinct().collect():  # a table has one length as a rule
            out = out.unionByName(_search(ok.where(F.size("embedding") == d), d, k, every))
        return scratch.result(out, "nearest")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
