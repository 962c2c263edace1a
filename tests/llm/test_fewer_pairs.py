"""The same links from fewer rows: pairs meet once, and what cannot link is told apart inside the join."""

import random

from pyspark.sql import functions as F

from behavex.llm import jaccard_join
from behavex.llm.components import BEFORE, across, connect
from behavex.llm.jaccard_join import FINE, _fine, jaccard_components
from tests.llm.test_llm import brute_components, frame, words


def test_pairs_that_share_many_keys_meet_once(spark):
    docs = range(40)
    rows = [(k, d, d) for k in range(30) for d in docs]
    labelled = spark.createDataFrame(rows, "key long, doc long, c long")
    heads = spark.createDataFrame([(k, [0]) for k in range(30)], "key long, heads array<long>")
    got = across(labelled, heads, None, None).collect()
    assert len(got) == 39 * 38 // 2 and {(r.x, r.y) for r in got} == {(x, y) for x in docs for y in docs if x > y > 0}


def test_pairs_with_few_keys_of_many_in_common_all_meet(spark):
    r = random.Random(5)
    keys = {d: sorted(r.sample(range(60), 20)) for d in range(25)}  # more than BEFORE
    assert all(len(k) > BEFORE for k in keys.values())
    kept = spark.createDataFrame([(k, d, 0) for d, own in keys.items() for k in own], "key long, doc long, salt int")
    met = set()

    def verify(pairs):
        met.update((p.x, p.y) for p in pairs.collect())
        return pairs.where(F.lit(False))

    connect(kept, verify).collect()
    assert met == {(x, y) for x in keys for y in keys if x > y and set(keys[x]) & set(keys[y])}


def test_long_texts_of_a_passage_are_not_verified(spark, monkeypatch):
    """Sets of 1,500 shingles that share a fifth; 512 bits cannot tell them apart."""
    verified, pairs = jaccard_join.verified, []

    def counted(rest, *more):
        pairs.append(rest.count())
        return verified(rest, *more)

    monkeypatch.setattr(jaccard_join, "verified", counted)
    passage = words(300)
    texts = [" ".join([*words(600), *passage, *words(600)]) for _ in range(20)]
    for i in (2, 9, 15):
        w = texts[i].split()
        w[700:720] = words(20)
        texts.append(" ".join(w))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts) and len({c for _, c in got.values()}) == 20
    assert sum(pairs) <= 6


def test_links_at_the_threshold_by_commonest_keys_left_out(spark):
    """Texts of all sizes with a common passage and links close to the threshold, in families whose keys differ in how common they are."""
    r, common, texts = random.Random(8), words(40), []
    for size in (30, 60, 150, 300, 700):
        base = [*words(size), *common]
        for _ in range(12):
            w = list(base)
            for _ in range(r.randint(0, max(1, size // 45))):
                w[r.randrange(len(w))] = f"y{r.random()}"
            texts.append(" ".join(w))
        texts += [" ".join([*words(size), *common]) for _ in range(4)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_components(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_fine_sketches_never_exceed_the_difference():
    import numpy as np

    fresh = lambda n, seed: np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64)
    assert _fine(fresh(FINE[-1][0] - 1, 0)) is None
    for size in (300, 1000, 2500, 5000):
        a = fresh(size, size)
        for other in (a[size // 20 :], np.r_[a, fresh(size // 5, 1)]):
            p, q = _fine(a), _fine(other)
            if q is not None and len(p) == len(q):
                assert np.bitwise_count((p ^ q).view(np.uint64)).sum() <= len(np.setxor1d(a, other))
        p, q = _fine(a), _fine(fresh(size, size + 1))
        assert np.bitwise_count((p ^ q).view(np.uint64)).sum() * 180 > 2 * size * 20  # unrelated sets are told apart
