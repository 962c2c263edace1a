"""Toxicity, sort-means and the prefix trie against brute force, with nulls, ties, repeated rows and empty tables."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from behavex.llm import prefix_trie, sort_means, toxicity
from behavex.llm.common import Scratch, cut

rng = random.Random(5)
DATA = "/root/testdata/sf0.01"


# --- sort-means ---------------------------------------------------------------------------------


def brute_means(rows, k=8, rounds=10):
    """rows of (vec_id, 64 floats) -> sorted rows of the operator's columns, by full search in Python integers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [p for _, p in first]

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(p)[1] for _, p in kept]
        for j in range(len(centroids)):
            mine = [p for (_, p), c in zip(kept, of, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [(i, *nearest(p)) for i, p in kept]
    total, each = sum(d for _, d, _ in last), Counter()
    for _, d, j in last:
        each[j] += d
    return sorted(((i, j, d, each[j], total, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in last), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "c", 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster string, point int, sums int")


def got_means(spark, rows):
    return sorted((tuple(r) for r in sort_means.sort_means(vectors(spark, rows)).collect()), key=repr)


def test_sort_means(spark):
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    near = lambda: [float(np.float32(x + rng.gauss(0, 0.3))) for x in rng.choice(centres)]
    rows = [(i, near()) for i in range(300)]
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, near()), (400, None), (401, [1.0] * 63), (402, [1.0] * 65), (403, [None] + [1.0] * 63), (404, [math.nan] + [1.0] * 63), (405, [math.inf] * 64), (406, []), (407, [0.0] * 64)]
    rows += [(500 + i, rows[5][1]) for i in range(150)]  # a group of equal vectors
    got = got_means(spark, rows)
    assert got == brute_means(rows)
    assert len(got) == 300 + 2 + 1 + 1 + 150


def test_sort_means_of_few_or_equal_rows(spark):
    one = [0.5] * 64
    for rows in ([], [(1, None)], [(1, one)], [(i, one) for i in range(20)], [(i, [float(i % 3)] * 64) for i in range(5)]):
        assert got_means(spark, rows) == brute_means(rows)


def test_sort_means_ties_and_ends_exactly_where_it_may():
    """Points on a line between centroids: equal distances go to the smaller number, also from a start with a larger one."""
    centroids = np.array([[0], [4], [8], [2]])
    apart, rest = sort_means.order_of(centroids)
    points = np.arange(-3, 12)[:, None]
    full = ((points[:, None, :] - centroids[None]) ** 2).sum(2)
    for start in range(4):
        cluster, distance, made = sort_means.assign(points, np.full(len(points), start), centroids, apart, rest)
        assert cluster.tolist() == full.argmin(1).tolist() and distance.tolist() == full.min(1).tolist()
        assert made <= full.size
    settled = sort_means.assign(points, full.argmin(1), centroids, apart, rest)
    assert settled[2] < full.size / 1.4  # most of the others are never looked at


# --- the prefix trie -----------------------------------------------------------------------------


def brute_trie(rows):
    """rows of (conv_id, turn, role, text) -> sorted rows of the operator's columns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    full = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + t[h:]
    members = defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[tuple(full[c][:d])].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1]) if n else 0
    out = []
    for n, m in members.items():
        ends = ",".join(str(c) for c in m if len(full[c]) == len(n))
        out.append((m[0], len(n), members[n[:-1]][0] if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, b"y") for r in rows], "conv_id long, turn long, role string, text string, node string, family int, digest binary")


def check_trie(spark, rows):
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(conversations(spark, rows)).collect()), key=repr)
    assert got == brute_trie(rows)
    return got


@pytest.mark.parametrize("seed", range(3))
def test_prefix_trie(spark, seed, monkeypatch):
    """Families with and without a base, shared starts across families, and chunks of ends that are smaller than a node's."""
    monkeypatch.setattr(prefix_trie, "TOGETHER", 2)
    rng = random.Random(seed)
    common = [("user", "hello"), ("bot", "hi ✓"), ("user", "go on")]
    rows = []
    for c in rng.sample(range(1200), 150) + [100, 200, 300]:
        talk = list(common[: rng.randrange(4)]) if rng.random() < 0.7 else []
        talk += [(rng.choice(["user", "bot"]), rng.choice(["", "a", "bb", "日本", "😀x"])) for _ in range(rng.randrange(5))]
        rows += [(c, t, *x) for t, x in enumerate(talk)] or [(c, 0, "user", "only")]
    rng.shuffle(rows)
    check_trie(spark, rows)


def test_prefix_trie_of_odd_rows(spark):
    """Nulls in every column, ties, repeated rows, ids below 0, turnless conversations, long texts and conversations, one common conversation."""
    rows = [(100, None, "user", "first"), (100, 1, None, None), (100, 1, "", ""), (100, 2, "user", "x" * 300_000), (100, 2, "user", "x" * 300_000)]
    rows += [(None, 0, "user", "nobody"), (-5, 0, "user", "below"), (0, 0, "user", "zero"), (0, 1, "bot", "one"), (7, 0, "user", "below"), (-250, 3, "bot", "q"), (1 << 62, 0, "user", "large id")]
    rows += [(c, 0, "user", "alone") for c in range(1000, 1100)]  # short ones: what is left of many is the base's turn or nothing
    rows += [(c, t, "user", f"same {t}") for c in range(5000, 5400) for t in range(6)]
    rows += [(9000, t, "bot", str(t % 3)) for t in range(3000)]
    check_trie(spark, rows)
    assert check_trie(spark, []) == []
    assert len(check_trie(spark, [(3, 0, "a", "b")])) in (1, 2)


def test_long_lists_of_ends_are_hashed_as_a_stream(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "TOGETHER", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        check_trie(spark, [(c, t, "user", "all alike") for c in range(0, 1500, 3) for t in range(2)])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# --- toxicity ------------------------------------------------------------------------------------


def test_grams_against_brute_force():
    texts = ["One two, three one-two FOUR five six seven éêèë eighteen", "", "single", "a b", "...", "two three"]
    held = [t.encode() for t in texts]
    seen: dict[int, set] = {}
    for i, x in enumerate(toxicity.coordinates(held)):
        plain = "".join(ch if ch.isalnum() or ord(ch) > 127 else " " for ch in texts[i].lower()).split()
        want = {(k, *(plain[j + o] for o in offsets)) for k, offsets in enumerate(toxicity.GRAMS) for j in range(len(plain) - offsets[-1])}
        want |= {(size, w.encode()[:size]) for w in plain for size in toxicity.BEGINNINGS if len(w.encode()) > size}
        assert len(x) == len(want)  # no two of so few collide
        seen[i] = set(x.tolist())
    assert seen[5] < seen[0] | seen[3]
    assert not seen[1] and not seen[4]


def test_ftrl_weights():
    """One coordinate by hand, and weights that the penalty keeps at zero."""
    m = toxicity.Ftrl(2, alpha=1.0, beta=1.0, l1=0.3, l2=0.0)
    m.learn(np.array([0]), 1)
    assert m.z[0] == pytest.approx(-0.5) and m.n[0] == pytest.approx(0.25)
    assert m.weights()[:2] == pytest.approx([(0.5 - 0.3) / (1 + 0.5), 0.0])
    strict = toxicity.Ftrl(2, l1=10.0)
    for _ in range(5):
        strict.learn(np.array([0, 1]), 1)
    assert strict.weights()[:2].tolist() == [0.0, 0.0] and strict.weights()[2] > 0


def made_texts(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 80))]
        bad = i % 4 == 0
        for _ in range(3 * bad):  # a bad word in many forms, and a pair that is bad with a word between only
            w.insert(rng.randrange(len(w)), "badword" + rng.choice(["er", "ing", "s", f"x{rng.randrange(999)}"]))
        out.append((i, " ".join(w), bad))
    return out


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "s", "en", 1, 0.5, True) for i, t, _ in rows], "doc_id long, text string, source string, lang string, n_chars long, score double, held_out boolean")
    labels = spark.createDataFrame([(i, 1, int(y)) for i, _, y in rows if y is not None], "doc_id long, quality int, toxic int")
    return docs, labels


def test_toxicity_is_learned_from_the_other_rows_only(spark):
    rows = made_texts(900, 1)
    docs, labels = frames(spark, rows)
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == set(held)
    right = [got[i].predicted == int(y) for i, _, y in rows if i in held]
    assert sum(right) >= 0.97 * len(right)
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    again = {r.doc_id: r for r in toxicity.score(docs.repartition(7), toxicity.fit(docs.repartition(7), flipped)).collect()}
    assert all(again[i].score == r.score for i, r in got.items())  # held-out labels have no part, nor has the order of rows
    assert len(model[0]) < 3000  # few of a million weights are not zero


def test_toxicity_of_odd_rows(spark):
    rows = made_texts(200, 2)
    extra = [(1000, None, None), (1001, "", None), (1002, " .,; ", None), (None, rows[0][1], None), (3, "another text of the same id", None), (3, rows[3][1], None), (1003, rows[0][1] + " w1" * 200_000, None)]
    docs, labels = frames(spark, rows + extra)
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 1), (0, 1, None), (5, None, 0), (77_777, 1, 1)], labels.schema))
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(out) == len(rows) + len(extra) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert len({by[i][0].score for i in (1000, 1001, 1002)}) == 1
    assert by[None][0].score == by[0][0].score and by[None][0].held_out is False
    assert [r.score for r in by[3]].count(by[3][0].score) in (1, 2, 3) and len(by[3]) == 3
    for rows_of_labels, share in (([], 0.0), ([(i, 1, 1) for i in range(50)], 1.0), ([(i, 1, 0) for i in range(50)], 0.0)):
        one = spark.createDataFrame(rows_of_labels, labels.schema)
        assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, one)).collect()} == {share}
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_toxicity_bound_of_the_sample(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    assert toxicity._sample(docs, labels, 50).count() == 50
    assert not toxicity._sample(docs, labels, 10**6).where(toxicity.held_out()).count()


def test_scratch_of_two_threads(spark):
    """Operators side by side in one session don't delete each other's tables."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    meet = Barrier(2)

    def work(n):
        with Scratch(spark) as scratch:
            mine = cut(spark.range(n))
            meet.wait()
            assert len(scratch.paths) == 1
            if n == 10:
                meet.wait()
                return mine.count()
        meet.wait()
        return n

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(work, (10, 20))) == [10, 20]
