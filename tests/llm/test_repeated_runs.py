"""A window that a text repeats with others between leaves the text once, and what the bit table lets through by chance does not come out of the join."""

import pytest

from behavex.llm import decontaminate
from behavex.llm.decontaminate import contamination, remove_spans
from tests.llm.test_llm import frame


def counting(monkeypatch):
    joined, plain = [], decontaminate.lookup

    def counted(left, right, *more, **named):
        out = plain(left, right, *more, **named)
        joined.append((left.count(), out.count()))
        return out

    monkeypatch.setattr(decontaminate, "lookup", counted)
    return joined


@pytest.mark.parametrize("few", [200_000, 0])
def test_a_word_pair_repeated_through_a_text(spark, monkeypatch, few):
    monkeypatch.setattr(decontaminate, "FEW_WINDOWS", few)
    joined = counting(monkeypatch)
    bench = spark.createDataFrame([(1, " ".join(["is", "on"] * 6 + ["is"])), (2, "of the")], "item_id long, text string")
    pairs = [" ".join(["is", "on"] * 150 + [f"s{i}"]) for i in range(40)]
    got = {r.doc_id: r for r in contamination(frame(spark, [*pairs, "of the x of the", "clean", None]), bench).collect()}
    assert len(got) == 43
    for i in range(40):
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (301, 299, ["1"])
        assert [(h.pos, h.len) for h in got[i].hits] == [(p, 13) for p in range(0, 287, 2)]
    assert [(got[i].n_words, got[i].n_hit, got[i]["items"]) for i in (40, 41, 42)] == [(5, 4, ["2"]), (1, 0, []), (0, 0, [])]
    assert [(h.pos, h.len) for h in got[40].hits] == [(0, 2), (3, 2)]
    assert joined[0][0] <= 43 and joined[0][1] == 41  # 5,762 where each place is a row


def test_windows_met_by_chance_leave_the_join(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BITS", 6)  # so few that every window passes
    joined = counting(monkeypatch)
    bench = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(300)))], "item_id long, text string")
    texts = [" ".join(f"w{i}_{j}" for j in range(90)) for i in range(30)]
    texts += [" ".join(["a", *(f"q{j}" for j in range(20)), "b"]), "", None, " ".join(["c"] * 500)]
    got = {r.doc_id: r for r in contamination(frame(spark, texts), bench).collect()}
    assert len(got) == 34 and sum(r.n_hit for r in got.values()) == 20 == got[30].n_hit
    assert [(got[i].n_words, got[i]["items"], got[i].hits) for i in (0, 31, 32, 33)] == [(180, [], []), (0, [], []), (0, [], []), (500, [], [])]
    assert [(h.pos, h.len) for h in got[30].hits] == [(p, 13) for p in range(1, 9)]
    assert joined[0][1] == 1  # of the runs of 32 texts


def test_every_place_of_a_repeated_window_is_removed(spark):
    item = " ".join(f"q{i}" for i in range(13))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = remove_spans(frame(spark, [f"a {item} b {item} c", "kept"]), bench)
    assert {r.doc_id: r.text for r in got.select("doc_id", "text").collect()} == {0: "a b c", 1: "kept"}
