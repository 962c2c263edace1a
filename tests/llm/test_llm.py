"""Operators against brute force on small inputs, with nulls, empty and repeated rows, empty tables
and columns of clashing names."""

import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from behavex.llm import ann, decontaminate, html_extract, line_dedup, packing, passages, quality, sharding, token_counts
from behavex.llm import components as components_module
from behavex.llm.components import components
from behavex.llm.decontaminate import contamination, drop_contaminated, is_contaminated, remove_spans
from behavex.llm.jaccard_join import WIDE_FROM, Bands, _apart, _wide, jaccard_components, keep_one
from behavex.llm.tokens import encoder, tokenizer_path

DOCS = "doc_id long, text string, source string, lang string, n_chars long, key string, id long, row int, n int, hits int"
rng = random.Random(3)


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "s", "en", len(t or ""), "k", 1, 2, 3, 4) for i, t in zip(ids, texts, strict=True)], DOCS)


def words(n, vocabulary=5000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near_copies():
    out = [None, "", "  \n ", "one two", "one two", "One  TWO", "a b c d e", "b0 b1 b2 b3 b4 b5 b6 b7", "b0 b1 b2 b3 b4 b5 b6 b7 b8"]
    for size in (12, 40, 120, 400):
        base = words(size)
        for _ in range(6):
            w = list(base)
            for _ in range(max(1, size // 40)):
                w[rng.randrange(size)] = "changed" + str(rng.random())
            out.append(" ".join(w))
        out += [" ".join(base), " ".join(base)]
    return out


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 80 * len(a | b) and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return [(len(s), r) for s, r in zip(sets, root, strict=True)]


def test_jaccard_components(spark):
    texts = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)
    assert jaccard_components(frame(spark, [])).count() == 0 and keep_one(spark, frame(spark, []), "").count() == 0
    odd = jaccard_components(frame(spark, ["a b c", "a b c", "x"], [None, 4, 4])).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in odd) == [(0, 4), (4, 4), (4, 4)]
    assert jaccard_components(frame(spark, ["a b c", "a b c"], [None, None])).where("component_id is null").count() == 2


def brute_rows(rows):
    """(shingles, component) of each (doc_id, text): links are between texts, the component is the smallest id reached."""
    found = brute_components([t for _, t in rows])
    ids: dict = {}
    for (i, _), (n, root) in zip(rows, found, strict=True):
        ids.setdefault(root if n else None, []).append(i)
    return [(n, min((x for x in ids[root] if x is not None), default=None) if n else i) for (i, _), (n, root) in zip(rows, found, strict=True)]


@pytest.mark.parametrize("seed", range(2))
def test_shared_ids_repeated_rows_and_null_ids(spark, seed):
    r = random.Random(seed)
    texts = near_copies()
    t1, t2 = texts[9], "other words " + texts[20]
    rows = [(3, t1), (5, t1), (5, t2), (7, t2 + " tail")] if seed == 0 else [(r.choice([None, *range(25)]), r.choice(texts)) for _ in range(60)]
    rows += rows[:8]
    df = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    want = brute_rows(rows)
    got = jaccard_components(df).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] is None, x[2] or 0)
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=key) == sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=key)
    # one row of each class stays, the one with the smallest id; texts without words all stay
    classes: dict = {}
    for (i, t), (n, root) in zip(rows, brute_components([t for _, t in rows]), strict=True):
        classes.setdefault(root, []).append((i, t))
    kept = sorted(((x.doc_id, x.text) for x in keep_one(spark, df, "").collect()), key=repr)
    words_of = [[x for x in members if x[1] and x[1].strip()] for members in classes.values()]
    blank = [(i, t) for i, t in rows if not (t and t.strip())]
    assert len(kept) == len(blank) + sum(bool(m) for m in words_of)
    for m in filter(None, words_of):
        least = min((i is None, i or 0) for i, _ in m)
        assert sum(x in m for x in kept) == 1 and any(x in m and (x[0] is None, x[0] or 0) == least for x in kept)


def test_large_group_of_near_copies(spark):
    base, texts = words(100), []
    for _ in range(150):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(100)] = f"x{rng.random()}"
        texts.append(" ".join(w))
    texts += [" ".join([*base[:60], *words(60)]) for _ in range(80)]  # share a passage, but link with nothing
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_sketch_bands_meet_every_link():
    bands = Bands()
    for size in (8, 10, 20, 90, 600):
        for _ in range(20):
            a = np.sort(np.random.default_rng(rng.randrange(10**9)).integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            b = np.sort(np.r_[a[: size - size // 10], a[:0], np.random.default_rng(rng.randrange(10**9)).integers(0, 1 << 63, size // 10, dtype=np.uint64)])
            key, place, *_ = bands.keys([a, b])
            assert set(key[place == 0]) & set(key[place == 1])
    for size in range(4, 40):  # one more element, while that still links
        for _ in range(20):
            b = np.sort(np.random.default_rng(rng.randrange(10**9)).integers(0, 1 << 63, size + 1, dtype=np.uint64))
            key, place, *_ = bands.keys([b[1:], b] if rng.random() < 0.5 else [b[:-1], b])
            assert set(key[place == 0]) & set(key[place == 1])


def test_wide_sketches_never_exceed_the_difference():
    assert _wide(np.zeros(WIDE_FROM - 1, dtype=np.uint64)) is None
    fresh = lambda n: np.random.default_rng(rng.randrange(10**9)).integers(0, 1 << 63, n, dtype=np.uint64)
    for size in (WIDE_FROM, 1000, 1024, 1025, 5000):
        a = fresh(size)
        for other in (a, a[size // 10 :], np.r_[a, fresh(size // 5)], np.r_[a[: size // 2], fresh(size)]):
            if len(other) >= WIDE_FROM:
                assert _apart(_wide(a), _wide(other)) <= len(np.setxor1d(a, other))
        assert _apart(_wide(a), _wide(fresh(size))) * 180 > 2 * size * 20  # unrelated sets are told apart


def test_long_texts_and_shared_ids(spark):
    base = words(1200)
    near = [*base[:1150], *words(50)]
    half = [*base[:600], *words(600)]
    texts = [" ".join(t) for t in (base, near, half, [*half[:1180], *words(20)], ["short", *words(20)])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts) and got[1][1] == 0 and got[3][1] == 2
    # id 7 has a short and a long text; both link
    shared = [texts[4], texts[4] + " tail", texts[0], texts[1]]
    rows = jaccard_components(frame(spark, shared, [7, 3, 7, 5])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(3, 3), (5, 5), (7, 3), (7, 5)]  # a link is one of texts, not of ids


@pytest.mark.parametrize("few", [0, 10**6])
def test_components(spark, few, monkeypatch):
    monkeypatch.setattr(components_module, "FEW", few)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(5, 5), (None, 3)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[1000 + i] == 1000 for i in range(41))
    for u, v in edges:
        if u is not None and u != v:
            assert got[u] == got[v] <= min(u, v)


def test_contamination(spark, monkeypatch):
    item = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item, "x"), (2, "short item", "x"), (3, None, "x"), (4, "", "x")], "item_id long, text string, doc_id string")
    texts = [None, "", "nothing here", "a " + item.upper() + " b", " ".join(item.split()[2:15]), "Short, ITEM!", " ".join(["pad"] * 600) + " " + item]
    got = {r.doc_id: r for r in contamination(frame(spark, texts), bench).withColumn("bad", is_contaminated()).collect()}
    assert [(got[i].n_words, got[i].n_hit, sorted(got[i]["items"])) for i in range(7)] == [(0, 0, []), (0, 0, []), (2, 0, []), (22, 20, ["1"]), (13, 13, ["1"]), (2, 2, ["2"]), (620, 20, ["1"])]
    assert [got[i].bad for i in range(7)] == [False, False, False, True, True, True, False]
    cleaned = {r.doc_id: r.text for r in remove_spans(frame(spark, texts), bench).collect()}
    assert cleaned[3] == "a b" and cleaned[0] is None and cleaned[2] == "nothing here"
    assert contamination(frame(spark, texts), bench.limit(0)).where("n_hit > 0").count() == 0
    # rows that share an id, repeated rows and null ids are judged by their own text; a benchmark row without id hits as well
    odd = bench.unionByName(spark.createDataFrame([(None, "nothing here", "y")], bench.schema))
    rows = [(1, texts[3]), (1, "quite clean"), (1, texts[3]), (None, texts[3]), (None, "quite clean"), (9, texts[2])]
    df = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    found = sorted(((r.doc_id or 0, r.n_hit, len(r["items"])) for r in contamination(df, odd).collect()))
    assert found == [(0, 0, 0), (0, 20, 1), (1, 0, 0), (1, 20, 1), (1, 20, 1), (9, 2, 0)]
    monkeypatch.setattr(decontaminate, "table", lambda *_: bench)
    left = drop_contaminated(spark, df, "")
    assert sorted(((r.doc_id or 0, r.text) for r in left.collect())) == [(0, "quite clean"), (1, "quite clean"), (9, texts[2])] and left.columns == df.columns
    assert sorted(r.text for r in remove_spans(df, bench).where("doc_id = 1").collect()) == ["a b", "a b", "quite clean"]


@pytest.mark.parametrize("bits, few", [(27, 200_000), (10, 0)])
def test_contamination_against_brute_force(spark, monkeypatch, bits, few):
    """Also with a bit table that is far too small, which only costs time, and with windows that are not broadcast."""
    monkeypatch.setattr(decontaminate, "MOST_BITS", bits)
    monkeypatch.setattr(decontaminate, "FEW_WINDOWS", few)
    r = random.Random(4)
    some = lambda n: [r.choice(["a", "B", "c", "é", "d7"]) for _ in range(n)]
    items = [some(r.choice([1, 2, 5, 12, 13, 14, 30])) for _ in range(25)]
    texts = []
    for _ in range(60):
        w = some(r.randint(0, 40))
        item = r.choice(items)
        a = r.randrange(len(item))
        texts.append(r.choice([" ", ", ", "--"]).join(w + item[a : a + r.randint(1, 30)]))
    low = [[x.lower() if x.isascii() else x for x in i] for i in items]
    windows: dict = {}
    for n, w in enumerate(low):
        k = min(13, len(w))
        for a in range(len(w) - k + 1):
            windows.setdefault(tuple(w[a : a + k]), set()).add(str(n))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(items)], "item_id long, text string")
    got = {x.doc_id: (x.n_words, x.n_hit, set(x["items"])) for x in contamination(frame(spark, texts), bench).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit.update(range(a, a + k))
                    found |= windows[tuple(w[a : a + k])]
        assert got[i] == (len(w), len(hit), found)


def test_line_dedup(spark):
    a, b = [f"line {i}" for i in range(8)], [f"other {i}" for i in range(5)]
    texts = ["\n".join(a), "\n".join([*b[:2], *a[2:7], b[2]]), "\n".join([*b[3:], a[0], a[1]]), None, "", "\n".join(["x", "x", "x", "x", "x"]), "\n".join(a)]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    assert got[0] == (texts[0], 0)
    assert got[1] == ("\n".join(b[:3]), 5)
    assert got[2] == (texts[2], 0)  # a run of two is shorter than the guarantee
    assert got[3] == (None, 0) and got[4] == ("", 0)
    assert got[5] == ("x", 4)
    assert got[6] == ("", 8)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_winnowing_leaves_no_long_run(spark, seed):
    r = random.Random(seed)
    pool = [f"p{i}" for i in range(40)]
    texts = []
    for _ in range(12):
        lines = [f"u{r.random()}" for _ in range(r.randint(0, 6))]
        for _ in range(r.randint(0, 2)):
            at, n = r.randrange(36), r.randint(1, 8)
            lines[len(lines) // 2 : len(lines) // 2] = pool[at : at + n]
        texts.append("\n".join(lines))
    out = {x.doc_id: x.text.split("\n") for x in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):  # what stays is a subsequence, and first occurrences stay somewhere
        it = iter(t.split("\n"))
        assert all(any(x == y for y in it) for x in out[i] if x)
    assert {x for t in texts for x in t.split("\n")} == {x for t in out.values() for x in t} | {""} & {x for t in texts for x in t.split("\n")}


def brute_lines(texts, least, most=None):
    """What is left of texts: lines go that lie in a span of so many lines, or of more than so many words, that stood earlier."""
    out, seen = [], set()
    for t in texts:
        lines = t.split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for a in range(len(full)):
            for b in range(a + 1, min(len(full), a + least) + 1):
                span = tuple(lines[i].rstrip(" ") for i in full[a:b])
                if b - a == least or (most and sum(len(x.split()) for x in span) > most):
                    gone.update(full[a:b] if span in seen else ())
                    seen.add(span)
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_every_later_run_of_lines_goes(spark, seed):
    """Also one whose fingerprint first stood elsewhere, as two lines that open many documents."""
    r = random.Random(seed)
    hot, pool = ["header", "licence"], [f"p{i}" for i in range(12)]
    texts = ["\n".join([*hot, "first"])]
    for i in range(60):
        lines = [*hot, f"body {i // 2}", *(r.choice(pool) for _ in range(r.randint(0, 5))), "", *hot[: r.randint(0, 2)], f"end {i // 3}"]
        texts.append("\n".join(lines[r.randint(0, 1) :]))
    for k, window in ((2, 2), (1, 3), (2, 4)) if seed == 0 else ((2, 2),):
        got = {x.doc_id: x.text for x in line_dedup.dedup_lines(frame(spark, texts), k, window).collect()}
        assert [got[i] for i in range(len(texts))] == brute_lines(texts, k + window - 1)


@pytest.mark.parametrize("seed", range(2))
def test_later_runs_of_many_words_go(spark, seed):
    """Also of one or two lines, and documents that are no more than that."""
    r = random.Random(seed)
    pool = [" ".join(f"v{r.random()}" for _ in range(n)) for n in (1, 5, 24, 25, 26, 27, 49, 50, 51, 60)]
    texts = [pool[-1], pool[-1], pool[-3], pool[-3], f"{pool[3]}\n\n{pool[4]}", f"{pool[3]} \n{pool[4]}"]
    texts += ["\n".join(r.choice(pool) for _ in range(r.randint(1, 4))) for _ in range(40)]
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts, 3, 50)
    assert got[1] == "" and got[3] == texts[3] and got[5] == ""


def test_line_dedup_of_odd_rows(spark):
    """Repeated rows, shared and null ids, very long texts, and columns of the names that the operator uses."""
    run, other = "l1\nl2\nl3", "\n".join(f"long {i}" for i in range(20000))
    rows = [(1, run), (1, run), (1, "x\n" + run), (None, run), (2, other), (3, other), (None, None)]
    df = frame(spark, [t for _, t in rows], [i for i, _ in rows]).withColumns({"k1": F.lit(1), "gone": F.lit(2), "n_lines": F.lit("a")})
    out = line_dedup.dedup_lines(df)
    got = sorted(((r.doc_id or 0, r.text or "", r.n_lines, r.n_removed) for r in out.collect()))
    rest = [(0, "", 3, 3), (2, other, 20000, 0), (3, "", 20000, 20000), (0, "", 0, 0)]
    either = [(1, run, 3, 0), (1, run, 3, 0), (1, "x", 4, 3)], [(1, "", 3, 3), (1, "", 3, 3), (1, "x\n" + run, 4, 0)]  # of one id, the smaller hash is first
    assert got in [sorted(rest + x) for x in either]
    assert set(df.columns) < set(out.columns)
    kept = line_dedup.without_repeats(spark, df, "")
    assert kept.columns == df.columns and kept.where("doc_id = 3").count() == 0 and kept.where("text is null").count() == 1


def test_packing(spark):
    texts = [None, "", "hello world", " ".join(words(3000)), *(" ".join(words(rng.randint(1, 500))) for _ in range(60)), "a <|endoftext|> b", "é" * 50]
    path = tokenizer_path("byte_bpe_50k.json")
    got = packing.pack(frame(spark, texts), path, capacity=256, with_ids=True).collect()
    ids = [[*encoder(path).slow.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    by_sequence: dict = {}
    for p in got:
        assert p.ids == ids[p.doc_id][p.start : p.start + p.length]
        assert zlib.crc32(np.array(p.ids, dtype="<u4").tobytes()) == p.ids_crc32
        assert p.length == 256 or p.piece == 0
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by_sequence.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 256
    assert sum(p.length for p in got) == sum(map(len, ids))
    assert len(by_sequence) <= 1.1 * -(-sum(map(len, ids)) // 256) + 1
    assert packing.pack(frame(spark, []), path).count() == 0
    odd = packing.pack(frame(spark, ["a b", "a b", "a b", None], [None, 5, 5, 5]), path).collect()  # null and shared ids, repeated rows
    assert sorted((p.doc_id or 0, p.length) for p in odd) == [(0, 3), (5, 1), (5, 3), (5, 3)] and sorted(p.offset for p in odd)[0] == 0 and {p.sequence_id for p in odd} == {odd[0].sequence_id}


def brute_nearest(rows, k=20, every=20):
    """{(query_id, place of its row): [(score, vec_id)]}; candidates are all other rows of the vector's length."""
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for a, (i, v) in enumerate(ok):
        if i % every == 0:
            other = [(-float(v @ w), j) for b, (j, w) in enumerate(ok) if b != a and len(w) == len(v)]
            out[i, a] = [(-s, j) for s, j in sorted(other)[:k]]
    return out


def rankings(df):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


@pytest.mark.parametrize("cell", [10_000, 150])
def test_ann(spark, cell, monkeypatch):
    """Also over many cells, several groups of queries a cell, and with a very common vector."""
    monkeypatch.setattr(ann, "CELL", cell)
    monkeypatch.setattr(ann, "ASKS", 8)
    monkeypatch.setattr(ann, "FEW", 0 if cell == 150 else 20_000)
    r = np.random.default_rng(0)
    x = (r.standard_normal((600, 24)) + 3 * r.standard_normal((10, 24))[r.integers(0, 10, 600)]).astype(np.float32).astype(float)
    x[100:140] = x[99]
    rows = [*enumerate(x.tolist()), (601, None), (620, None), (602, [0.0] * 24), (640, [float("nan")] * 24), (604, [None] * 24), (660, [1.0]), (None, x[3].tolist())]
    got = rankings(ann.nearest(spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, best int")))
    want = brute_nearest(rows)
    hits = 0
    assert set(got) == {i for (i, _), w in want.items() if w}
    for (i, _), w in want.items():
        if w:
            assert sorted(x[0] for x in got[i]) == list(range(1, 21)) and i not in {x[1] for x in got[i]}
            hits += len({j for _, j in w} & {x[1] for x in got[i]})
    assert hits / 20 / len(got) >= 0.95
    if cell == 150:
        equal = sorted(got[120])  # forty-one equal vectors: ties go to the smaller id
        assert [j for _, j, s in equal] == [j for _, j in next(w for (i, _), w in want.items() if i == 120)]


def test_ann_few_rows_and_shared_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (20, [1.0, 1.0]), (5, [2.0, 0.0]), (40, [1.0]), (40, [3.0]), (60, [1.0, 2.0, 3.0])]
    got = rankings(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    want: dict = {}
    for (i, _), w in brute_nearest(rows).items():
        want[i] = want.get(i, []) + [(n + 1, j, s) for n, (s, j) in enumerate(w)]
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items() if v}
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_ann_verifies_a_part(spark):
    """With clusters and without: the chi-square test ends most searches early, and recall holds."""
    r = np.random.default_rng(5)
    for x in (r.standard_normal((8000, 64)), r.standard_normal((8000, 64)) + 4 * r.standard_normal((50, 64))[r.integers(0, 50, 8000)]):
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        q = x[:100]
        got, verified = ann.search_cell(x, np.arange(8000), q, [np.zeros(0)] * 100, 1.0, 21)
        best = np.argsort(-(q @ x.T), axis=1)[:, :21]
        assert np.mean([len(set(g) & set(b)) / 21 for g, b in zip(got, best, strict=True)]) >= 0.95
        assert verified / 100 / 8000 <= 0.35
    for p, m, want in ((0.95, 8, 15.507), (0.9, 32, 42.585), (0.5, 2, 1.386)):
        assert abs(ann.chi2_quantile(p, m) - want) < 1e-3


@pytest.fixture(scope="module")
def page_model():
    return html_extract.train()


@pytest.mark.parametrize("kind", ["semantic", "divs", "weblog", "tables"])
def test_html_blocks_of_held_out_pages(page_model, kind):
    right = total = 0
    for page, labels in html_extract.labelled_pages(100, seed=77, kinds=(kind,)):
        y = page_model.decode([fs for fs, _ in html_extract.blocks(page)])
        right += sum(a == int(c) for a, c in zip(y, labels, strict=True))
        total += len(labels)
    assert total > 500 and right / total > 0.98


#: Layouts that the generator does not make, with the text to be found.
PAGES = [
    ('<div id="header"><h1><a href="/">My Blog</a></h1></div><div id="page"><div class="hentry"><h2>A day at the sea</h2><p>We went to the sea and it was good. The sun was out all day long.</p><p>In the evening we went home again, tired but happy.</p></div><ol class="commentlist"><li><p>Nice post, thank you for it!</p></li><li><p>I was there as well, and it rained.</p></li></ol></div><div id="sidebar"><ul><li><a href=1>Archives</a></li><li><a href=2>About</a></li></ul></div>',
     "A day at the sea We went to the sea and it was good. The sun was out all day long. In the evening we went home again, tired but happy."),
    ("<table><tr><td><a href=1>Home</a> <a href=2>News</a></td><td><h1>Title of it</h1><p>This is the first paragraph of the article, and it has a few words.</p><p>This is the second one. It is shorter.</p></td></tr></table>",
     "Title of it This is the first paragraph of the article, and it has a few words. This is the second one. It is shorter."),
    ('<article><h1>Heading</h1><p>The article begins here with a sentence. Then there is another one.</p><p>And it goes on for a while, as they do.</p><div class="reader-notes"><p>I do not agree with this at all.</p><p>Neither do I, to be honest.</p></div></article>',
     "Heading The article begins here with a sentence. Then there is another one. And it goes on for a while, as they do."),
    ('<nav><a href=1>Home</a></nav><main><h1>Heading</h1><p>The text begins with one paragraph that has no link in it.</p><p><a href="x">A long link that makes up nearly all of this paragraph</a> here.</p><p>It ends with this one.</p></main><footer>(c) us</footer>',
     "Heading The text begins with one paragraph that has no link in it. A long link that makes up nearly all of this paragraph here. It ends with this one."),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_html_of_other_layouts(page_model, page, text):
    assert html_extract.main_text(f"<html><body>{page}</body></html>", page_model) == text


@pytest.mark.parametrize("piece", ["<a ", "<div>x", '<a "', "<p class='\"x>", "<!", "<b>x", '<div class="a b">x<p>', "<script>", "<ul><li>", "</p", "<a href=\"x>y' ", "<!-- ", "&amp", "<td><th>x"])
def test_broken_pages_take_linear_time(page_model, piece):
    """A page of a megabyte that is broken all over; quadratic time would be hours."""
    began = time.process_time()
    html_extract.main_text(piece * (1_000_000 // len(piece)), page_model)
    assert time.process_time() - began < 30


def test_html(spark, page_model):
    page = "<html><body><nav><a href=x>Home</a></nav><article><h1>A &amp;amp; B</h1><p>one\n two<b>x</b><script>no</script>.</p></article><footer>&copy; me</footer>"
    df = spark.createDataFrame([(1, "u", page, 0), (1, "u", page, 0), (2, "u", None, 0), (3, None, "", 0), (None, "u", "<p", 0), (4, "u", "<div>" * 5000 + "x", 0)], "page_id long, url string, html string, text int")
    rows = html_extract.extract(df, page_model).collect()
    got = {r.page_id: (r.text, r.n_chars) for r in rows}
    assert got[1] == ("A &amp; B one twox.", 19) and got[2] == ("", 0) and got[3] == ("", 0) and len(rows) == 6
    assert html_extract.extract(df.limit(0), page_model).count() == 0


def test_quality(spark, monkeypatch):
    good, bad = [" ".join(words(60, 400)) for _ in range(240)], [" ".join(w + "***" for w in words(60, 400)) for _ in range(60)]
    toxic = [" ".join([*words(30, 400), "vile", *words(30, 400)]) for _ in range(60)]
    docs = frame(spark, good + bad + toxic + [None, " "])
    n = len(good)
    labels = [(i, int(not n <= i < n + 60), int(n + 60 <= i < n + 120)) for i in range(0, n + 120) if i % 3]
    got = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()}
    held = [i for i in range(n + 120) if i % 3 == 0]
    assert np.mean([got[i].accepted == (i < n) for i in held]) > 0.95
    assert not got[n + 120].accepted and got[n + 121].quality_score == 0
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert quality.score(docs, none).where("accepted").count() == n + 120
    assert quality.score(docs.limit(0), none).count() == 0
    table = lambda *_: spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality, "table", table)
    kept = quality.accepted(spark, docs, "")  # the stage keeps whole rows, and those that the scores accept
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.accepted}
    odd = docs.limit(2).withColumns({c: F.lit(None).cast(t) for c, t in (("doc_id", "long"), ("source", "string"), ("lang", "string"), ("n_chars", "long"))})
    models = quality.fit(docs, table())
    assert [r.accepted for r in quality.score(odd.unionByName(odd), models).collect()] == [True] * 4
    twice = docs.unionByName(docs.limit(50)).unionByName(docs.limit(20).withColumn("text", F.lit("another text of this id")))
    assert quality.score(twice, quality.fit(twice, table().unionByName(table()))).count() == docs.count() + 70


def test_metadata_features_are_distinct(spark):
    """Each source and language has a feature of its own, also those whose letters have one sum."""
    values = ["fr", "es", "en", "src12", "src21", "", None]
    hashes = np.array([r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(F.xxhash64("v")).collect()])
    pages = quality.Pages.of(hashes, hashes)
    assert len({tuple(x) for x in pages.features(hashes, hashes, np.full(7, 5)).tolist()}) == 7
    assert pages.features(hashes[:1] + 1, hashes[:1] + 1, np.array([-1])).sum() == 3  # what is not known shares one


def test_each_view_is_calibrated():
    """Among rows that a view gives a score of about s, a share of about s is positive."""
    r = np.random.default_rng(0)
    z = r.standard_normal(20000) * 2
    y = (r.random(20000) < 1 / (1 + np.exp(-(0.5 * z - 1)))).astype(float)
    a, b = quality._logistic((5 * z + 3)[:, None], y, np.array([1e-2]))
    p = 1 / (1 + np.exp(-(a * (5 * z + 3) + b)))
    for low in np.arange(0, 0.9, 0.1):
        some = (p >= low) & (p < low + 0.1)
        if some.sum() > 300:
            assert abs(y[some].mean() - p[some].mean()) < 0.05


def test_sharding(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=1 << 20, fan_in=3)
    docs = frame(spark, [None, "", *(" ".join(words(50)) for _ in range(200))]).unionByName(frame(spark, [""]))
    for _ in range(2):
        store.append(docs, arrivals=3)
    before = store.versions()[-1]
    small = len(store.manifest(before))
    after = store.compact()
    assert after > before and len(store.manifest()) < small
    pick = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    assert pick(store.read()) == pick(store.read(before)) == pick(docs.unionByName(docs))
    with pytest.raises(sharding.CommitConflict):
        store.commit(before - 1, [])
    store.SNAPSHOT = 4  # versions that list all shards and those that say what changes give the same
    other = sharding.ShardStore(spark, str(tmp_path / "t"), target_bytes=1 << 20, fan_in=3)
    other.SNAPSHOT = 4
    for _ in range(3):
        other.append(docs, arrivals=3)
    other.compact()
    assert pick(other.read()) == pick(docs.unionByName(docs).unionByName(docs)) and pick(other.read(3)) == pick(docs)
    empty = sharding.ShardStore(spark, str(tmp_path / "e"))
    assert empty.append(docs.limit(0)) == 1 and empty.manifest() == [] and empty.compact() == 1
    nested = docs.limit(5).select("doc_id", F.struct(F.create_map(F.lit("a"), "text").alias("m")).alias("s"))
    empty.append(nested, arrivals=2)
    assert empty.read().count() == 5
    only = sharding.ShardStore(spark, str(tmp_path / "o"))
    only.append(nested.select("s"), arrivals=2)
    assert only.read().count() == 5


def test_token_counts(spark, tmp_path):
    path = tokenizer_path("byte_bpe_50k.json")
    store = token_counts.Rollup(spark, str(tmp_path / "r"))
    schema = "op string, source string, lang string, text string, old_text string"
    batches = {"b1": [("insert", "s", "en", "one two three", None), ("insert", None, "en", None, None)], "b2": [("revise", "s", "en", "one", "one two three"), ("other", "s", "en", "x", None)], "b3": [("delete", "s", "en", None, "one")]}
    seen = []
    for name, rows in batches.items():
        d = token_counts.deltas(spark.createDataFrame(rows, schema), {"bpe": path})
        assert store.commit(name, d) and not store.commit(name, d)
        seen.append({(r.source, r.lang): (r.n_docs, r.n_tokens) for r in store.totals().collect()})
    assert seen[0] == {("s", "en"): (1, 3), (None, "en"): (1, 0)}
    assert seen[1] == {("s", "en"): (1, 1), (None, "en"): (1, 0)} and seen[2] == {(None, "en"): (1, 0)}


def test_two_writers_of_one_batch(spark, tmp_path, monkeypatch):
    """Both are past the first look when they commit: one wins, and the other's delta is nowhere."""
    delta = spark.createDataFrame([("s", "en", "v", 1, 5)], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
    a, b = (token_counts.Rollup(spark, str(tmp_path / "r")) for _ in range(2))
    monkeypatch.setattr(b, "batches", set)
    assert a.commit("x/1", delta) and not b.commit("x/1", delta) and a.batches() == {"x/1"}
    assert [tuple(r) for r in a.totals().collect()] == [("s", "en", "v", 1, 5)] and len(list((tmp_path / "r").glob("delta-*"))) == 1


def test_history_adds_up_to_the_table(spark, tmp_path):
    """op4's batches of inserts, drafts, revisions and deletions, against a recount by both tokenizers' own libraries."""
    texts = [None, "", "plain", "Ünïcode ✓ 漢字", *(" ".join(words(rng.randint(1, 40))) for _ in range(90)), " ".join(words(20000))]
    docs = frame(spark, texts).withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit("a")).when(F.col("doc_id") % 3 == 1, F.lit("b")))
    docs = docs.unionByName(docs.limit(10))
    paths = {v: tokenizer_path(f) for v, f in token_counts.VERSIONS.items()}
    store = token_counts.Rollup(spark, str(tmp_path / "r"))
    for _ in range(2):
        did = [store.commit(n, token_counts.deltas(b, paths)) for n, b in token_counts.changes(docs)]
    assert did == [False] * 4
    want: dict = {}
    slow = encoder(paths["byte_bpe_50k"]).slow
    for r in docs.collect():
        for v in paths:
            n = len(slow.encode(r.text or "", add_special_tokens=False).ids) if v == "byte_bpe_50k" else len(encoder(paths[v]).encode(r.text or ""))
            was = want.get((r.source, r.lang, v), (0, 0))
            want[r.source, r.lang, v] = (was[0] + 1, was[1] + n)
    assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in store.totals().collect()} == want
    none = token_counts.Rollup(spark, str(tmp_path / "n"))
    assert all(none.commit(n, token_counts.deltas(b, paths)) for n, b in token_counts.changes(docs.limit(0))) and none.totals().count() == 0


def test_passages(spark):
    passage = " ".join(words(60))
    texts = [None, "", "short", *(" ".join([*words(rng.randint(20, 80)), passage, *words(40)]) for _ in range(8)), *(" ".join(words(90)) for _ in range(8))]
    df = frame(spark, texts)
    found = passages.repeated_passages(df)
    ids = {r.doc_id for r in found.collect()}
    assert ids == set(range(3, 11))
    assert found.where("doc_id = 3 and removed").count() == 0 and found.where("doc_id = 10 and not removed").count() == 0
    cleaned = {r.doc_id: r.text for r in passages.without_passages(df, found).collect()}
    assert cleaned[3] == texts[3] and len(cleaned[10].split()) < len(texts[10].split()) - 20 and cleaned[12] == texts[12]
    assert passages.repeated_passages(frame(spark, [])).count() == 0 and passages.repeated_passages(frame(spark, [None, "", "a"])).count() == 0


def test_passages_of_rows_not_ids(spark):
    """Repeated rows, shared and null ids, short equal documents, and repeats within one document."""
    p, q, short, other = (" ".join(words(n)) for n in (60, 70, 15, 50))
    inner = " ".join(words(60))
    twice = f"{other} {inner} {' '.join(words(25))} {inner}"
    rows = [(4, p), (4, q), (4, p), (None, p), (None, short), (7, short), (8, twice), (9, "one two three"), (10, "one two three")]
    df = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    found = passages.repeated_passages(df)
    gone = sorted(((r.doc_id or 0, r.copy, r.start) for r in found.where("removed").collect()))
    assert {(i, c) for i, c, _ in gone} == {(4, 1), (0, 0), (8, 0)}
    assert all(r.across == (r.doc_id != 8) for r in found.collect())
    assert {r.doc_id for r in passages.repeated_passages(df, across=True).collect()} == {4, 7, None}
    left = sorted(((r.doc_id or 0, r.text) for r in passages.without_passages(df, found).collect()))
    assert (4, p) in left and (4, q) in left and (7, short) in left  # one copy stays, and so does what is no copy
    # what is left of a copy is no paragraph: fewer than LEAST_WORDS words at either end
    assert all(len(t.split()) < 2 * passages.LEAST_WORDS for i, t in left if i == 0 or i == 4 and t not in (p, q))
    assert len(left) == len(rows) and len(next(t for i, t in left if i == 8).split()) < len(twice.split()) - 15


@pytest.mark.parametrize("seed", range(1))
def test_passages_against_brute_force(spark, seed):
    """Every document that shares more than 50 words with another is found, most that share 20, and none without; similar passages are found as well."""
    r = random.Random(seed)
    some = lambda n: [f"y{r.randrange(20000)}" for _ in range(n)]
    pool, texts = [some(n) for n in (12, 19, 20, 21, 25, 35, 51, 52, 60, 200)], []
    for _ in range(70):
        w = some(r.randint(0, 60))
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(w))
            w[at:at] = r.choice(pool)
        texts.append(" ".join(w))
    near = some(300)
    for _ in range(2):
        texts.append(" ".join(x if r.random() < 0.98 else f"changed{r.random()}" for x in near))

    def sharing(n: int) -> set:
        held: dict = {}
        for i, t in enumerate(texts):
            w = t.split()
            for a in range(len(w) - n + 1):
                held.setdefault(tuple(w[a : a + n]), set()).add(i)
        return {i for v in held.values() if len(v) > 1 for i in v}

    same = {i for i, t in enumerate(texts) if len(t.split()) >= passages.LEAST_WORDS and texts.count(t) > 1}
    got = {x.doc_id for x in passages.repeated_passages(frame(spark, texts), across=True).collect()}
    assert sharing(51) | same | {70, 71} <= got <= sharing(20) | same | {70, 71}
    assert len(got & sharing(20)) >= 0.85 * len(sharing(20))
    everything = {x.doc_id for x in passages.repeated_passages(frame(spark, texts), least_run=1).collect()}
    assert got <= everything


def test_passages_of_recurring_words(spark):
    """No pair hash is a strict minimum there."""
    for period in (1, 2, 3, 5):
        passage = " ".join((words(period) * 60)[:56])
        df = frame(spark, [" ".join([*words(30), passage, *words(30)]) for _ in range(3)] + [" ".join(words(80)) for _ in range(3)])
        assert {r.doc_id for r in passages.repeated_passages(df).select("doc_id").collect()} == {0, 1, 2}


def test_passages_with_close_borders(spark):
    """The span between the borders within a shared passage can be far shorter than the passage, which counts."""
    hashed = lambda t: passages.hashed_words([t.encode()])
    r, texts = random.Random(11), []
    some = lambda n: [f"z{r.random()}" for _ in range(n)]
    while len(texts) < 12:
        passage = some(51)
        pair = [" ".join([*some(40), *passage, *some(40)]) for _ in range(2)]
        spans, sets = [], []
        for t in pair:
            _, start, size, whole, sh, cuts = passages.paragraphs(*hashed(t))
            spans.append({(int(w), int(s), int(n)) for w, s, n in zip(whole, start, size, strict=True)})
            sets.append([set(x.tolist()) for x in np.split(sh, cuts[1:])])
        both = spans[0] & spans[1]
        edges = [(a, b) for a in sets[0] for b in sets[1] if a != b]  # similar ones would lengthen the run
        if both and all(len(a & b) < 0.7 * len(a | b) for a, b in edges) and max(s + n for _, s, n in both) - min(s for _, s, n in both) < passages.LEAST_RUN:
            texts += pair
    texts += [" ".join([*some(30), *(f"common{i}" for i in range(12))]) for _ in range(4)]  # a short line at the edge
    found = {x.doc_id for x in passages.repeated_passages(frame(spark, texts)).select("doc_id").collect()}
    assert found == set(range(12))


def brute_contaminated(text, items):
    """The contract's rule, over windows of 13 words."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit = split(text), set()
    windows = {tuple(x[a : a + min(13, len(x))]) for x in map(split, items) for a in range(max(1, len(x) - 12)) if x}
    for n in {len(x) for x in windows}:
        for a in range(len(w) - n + 1):
            if tuple(w[a : a + n]) in windows:
                hit.update(range(a, a + n))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_pipeline(spark):
    """The stages' decisions on a whole small table, by brute force from what the classifier accepts."""
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    accepted = quality.score(docs, quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))).where("accepted").select("doc_id")
    rows = sorted((r.doc_id, r.text) for r in docs.join(accepted, "doc_id", "left_semi").collect())
    ids, texts = [i for i, _ in rows], brute_lines([t for _, t in rows], 3, 50)
    left = [(i, t) for i, t, (_, was) in zip(ids, texts, rows, strict=True) if t == was or t.strip(" ")]
    left = [x for n, (x, (_, root)) in enumerate(zip(left, brute_components([t for _, t in left]), strict=True)) if root == n]
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    left = [(i, t) for i, t in left if not brute_contaminated(t, items)]

    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} == {i for i, _ in left}
    slow, size, used = encoder(tokenizer_path("byte_bpe_50k.json")).slow, {}, {}
    for r in out:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.length
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert size == {i: len(slow.encode(t, add_special_tokens=False).ids) + 1 for i, t in left} and max(used.values()) <= 1024
