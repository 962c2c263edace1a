"""Equal short texts of every length, very many copies, and overlapping marks."""

import random

from pyspark.sql import functions as F

from behavex.llm import passages

rng = random.Random(9)
SCHEMA = "doc_id long, text string"


def text(n):
    return " ".join(f"v{rng.randrange(10**9)}" for _ in range(n))


def test_equal_texts_of_all_lengths(spark):
    """Of pairs of equal texts of 6 to 60 words both are found, whatever their borders; others are left alone."""
    rows, want = [], set()
    for n in range(1, 61):
        for _ in range(4):
            t = text(n)
            if n >= passages.LEAST_WORDS:
                want |= {len(rows), len(rows) + 1}
            rows += [(len(rows), t), (len(rows) + 1, t)]
    rows += [(len(rows) + i, text(n)) for i, n in enumerate(range(1, 61))]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = passages.repeated_passages(docs, across=True)
    assert {r.doc_id for r in found.select("doc_id").distinct().collect()} == want
    left = {r.doc_id: r.text for r in passages.without_passages(docs, found).collect()}
    removed = {r.doc_id for r in found.where("removed").select("doc_id").distinct().collect()}
    assert all(left[i] == t for i, t in rows if i not in removed)
    short = [i for i, t in rows if i in removed and len(t.split()) < 2 * passages.LEAST_RUN]
    assert short and all(not left[i].strip() for i in short)


def test_many_copies_are_numbered_over_tasks(spark):
    t = text(30)
    docs = spark.createDataFrame([(1, t)] * 500 + [(2, text(30))], SCHEMA).repartition(7)
    found = passages.repeated_passages(docs)
    copies = found.groupBy("copy").agg(F.max("removed").alias("gone")).collect()
    assert sorted(r.copy for r in copies) == list(range(500)) and sum(not r.gone for r in copies) == 1
    assert sorted(r.text for r in passages.without_passages(docs, found).collect())[:499] == [""] * 499


def test_overlapping_marks_are_one_span():
    assert passages._merged([(5, 9), (0, 6), (12, 14), (9, 10)]) == [(0, 10), (12, 14)]
