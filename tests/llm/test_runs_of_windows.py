"""Benchmark windows that neighbour each other are verified as one run, once for all documents that have it."""

import random

import pytest

from behavex.llm import decontaminate
from behavex.llm.decontaminate import contamination
from tests.llm.test_llm import frame


@pytest.mark.parametrize("few", [200_000, 0])
def test_a_passage_of_many_documents_is_verified_once(spark, monkeypatch, few):
    monkeypatch.setattr(decontaminate, "FEW_WINDOWS", few)
    runs, plain = [], decontaminate.verified_runs

    def counted(met, windows):
        runs.append(met.count())
        return plain(met, windows)

    monkeypatch.setattr(decontaminate, "verified_runs", counted)
    item = [f"q{i}" for i in range(200)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[50:70])), (3, "the")], "item_id long, text string")
    texts = [" ".join([f"p{i}", *item, "the", "the", f"s{i}"]) for i in range(50)] + ["clean", None, " ".join(item[3:17] + ["x"] + item[50:70])]
    got = {r.doc_id: r for r in contamination(frame(spark, texts), bench).collect()}
    assert len(got) == 53 and all((got[i].n_words, got[i].n_hit, sorted(got[i]["items"])) == (204, 202, ["1", "2", "3"]) for i in range(50))
    assert [(got[i].n_words, got[i].n_hit, sorted(got[i]["items"])) for i in (50, 51, 52)] == [(1, 0, []), (0, 0, []), (35, 34, ["1", "2"])]
    assert [(h.pos, h.len) for h in got[52].hits] == [(0, 13), (1, 13), *((p, 13) for p in range(15, 23))]
    assert runs[0] <= 12  # three parts of the item, the short item twice, two in the last text, and what the bit table lets through


def test_runs_of_every_length(spark):
    r = random.Random(2)
    item = [f"z{i}" for i in range(3 * decontaminate.RUN)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    sizes = [12, 13, 14, decontaminate.RUN + 11, decontaminate.RUN + 12, decontaminate.RUN + 13, 2 * decontaminate.RUN + 12, 2 * decontaminate.RUN + 13, len(item)]
    at = [r.randrange(len(item) - n + 1) for n in sizes]
    texts = [" ".join(["a", *item[i : i + n], "b", *item[i : i + n]]) for i, n in zip(at, sizes, strict=True)]
    got = {x.doc_id: x.n_hit for x in contamination(frame(spark, texts), bench).collect()}
    assert [got[i] for i in range(len(sizes))] == [2 * n if n >= 13 else 0 for n in sizes]
