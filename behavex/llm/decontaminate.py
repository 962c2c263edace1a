"""Benchmark decontamination with DataFrame functions only.

The hashes of the benchmark's n-gram windows are a set that every task holds, as a table of bits of
a bounded size. A document's words are hashed once; each of its windows is probed first by the hash of its
two ends, and what passes by the hash of all its words. Only what passes that too (hits, and one in
thousands of the others) leaves the row as text, neighbouring windows as one run, and each different run of a
document once, with its places. Each different run is
verified once, by an equality join of its windows with the benchmark's, however many documents have it, and
the documents get those that hold a hit back by their text. So nothing but hits is shuffled, however large the benchmark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from behavex.llm.common import Scratch, cut, free_name, lookup, row_key, table, without_rows

#: Words are runs of digits, letters and non-ASCII characters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """A-Z lower-cased, split into words; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), SEPARATORS), lambda w: w != "")


#: The bit table has so many bits for each of its keys, and 2^MOST_BITS (16 MB) at most.
BITS_A_KEY, MOST_BITS = 32, 27
#: Windows are broadcast to the runs if they are no more than this, and verified runs to the documents if they are no more than a fourth.
FEW_WINDOWS = 200_000
#: A longer run is several of so many windows.
RUN = 64


def benchmark_windows(benchmark: DataFrame, n: int = 13) -> DataFrame:
    """(len, window, items): every window of n words, or the whole of a shorter item, and its items' ids as text."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    w = w.withColumn("len", F.least(F.size("w"), F.lit(n)))
    at = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1))
    w = w.withColumn("i", at).select("item_id", "len", F.array_join(F.expr("slice(w, i, len)"), " ").alias("window"))
    return w.groupBy("len", "window").agg(F.collect_set("item_id").alias("items"))


def _ends(h: str, at: str, n: int | str) -> str:
    return f"xxhash64(get({h}, {at}), get({h}, {at} + {n} - 1), {n})"


def _all(h: str, at: str, n: int | str) -> str:
    return f"xxhash64(slice({h}, {at} + 1, {n}), {n})"


def bit_table(windows: DataFrame, bits: int) -> DataFrame:
    """One row with an array of longs whose 2^bits bits say which hashes occur."""
    h = windows.select(F.transform(F.split("window", " "), lambda w: F.xxhash64(w)).alias("h"), "len")
    keys = h.select(F.explode(F.expr(f"array(pmod({_ends('h', '0', 'len')}, {1 << bits}L), pmod({_all('h', '0', 'len')}, {1 << bits}L))")).alias("k"))
    some = keys.groupBy(F.shiftright("k", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k % 64 as int))")).alias("b"))
    every = windows.sparkSession.range(1 << (bits - 6)).join(some, "id", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("b", F.lit(0)).alias("b")))), lambda x: x["b"]).alias("bits"))


def _runs(at: str, k: int) -> str:
    """(pos, len, run) of runs of neighbouring windows of k words, given the windows' places in the words s.w; a run begins with k as text."""
    first, last = (f"filter({at}, (p, i) -> coalesce(get({at}, i {d} 1) <> p {d} 1, true))" for d in "-+")
    text = f"concat('{k} ', array_join(slice(s.w, a + j + 1, least({RUN}, b - a + 1 - j) + {k} - 1), ' '))"
    return f"flatten(zip_with({first}, {last}, (a, b) -> transform(sequence(0, b - a, {RUN}), j -> named_struct('pos', a + j, 'len', {k}, 'run', {text}))))"


def _each_once(hits: Column) -> Column:
    """(len, run, places) of the different runs among (pos, len, run): a passage that a text repeats is one of them, with all its places."""

    def grouped(h: Column) -> Column:
        first = F.transform(h, lambda x, i: F.when(F.coalesce(F.get(h, i - 1)["run"] != x["run"], F.lit(True)), i))
        return F.get(F.transform(F.array(F.filter(first, lambda i: i.isNotNull())), lambda at: F.transform(at, lambda a, j: one(h, a, F.coalesce(F.get(at, j + 1), F.size(h))))), F.lit(0))

    def one(h: Column, a: Column, end: Column) -> Column:
        places = F.transform(F.slice(h, a + 1, end - a), lambda x: x["pos"])
        return F.struct(F.get(h, a)["len"].alias("len"), F.get(h, a)["run"].alias("run"), places.alias("places"))

    by_run = F.array_sort(F.transform(hits, lambda x: F.struct(x["run"].alias("run"), x["pos"].alias("pos"), x["len"].alias("len"))))
    return F.get(F.transform(F.array(by_run), grouped), F.lit(0))


def verified_runs(runs: DataFrame, windows: DataFrame) -> DataFrame:
    """runs(len, run), each once -> (run, at, items): places in the run where a benchmark's window begins, and the items of these."""
    w = runs.withColumn("w", F.expr("slice(split(run, ' '), 2, length(run))"))
    each = w.withColumn("i", F.explode(F.expr("sequence(0, size(w) - len)"))).select("run", "len", "i", F.expr("array_join(slice(w, i + 1, len), ' ')").alias("window"))
    found = each.join(windows, ["len", "window"]).groupBy("run").agg(F.collect_set("i").alias("at"), F.collect_set("items").alias("items"))
    return found.select("run", "at", F.array_distinct(F.flatten("items")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_words, n_hit, items array<string>, hits array<struct<pos, len>>, r1, r2), a row for
    each row of docs, also for repeated ones and null ids; r1 and r2 are its row_key.

    A word inside any occurrence of a benchmark window is hit. Null and blank text has no words
    and no hits; benchmark rows without words are ignored, those without id hit but are no item, and an empty benchmark hits
    nothing. Other columns are ignored."""
    with Scratch(docs.sparkSession) as scratch:
        windows = cut(benchmark_windows(benchmark, n), "windows")
        lengths = {r.len: r.n for r in windows.groupBy("len").agg(F.count("*").alias("n")).collect()}  # n rows at most
        total = sum(lengths.values())
        bits = min(MOST_BITS, max(10, (2 * BITS_A_KEY * total - 1).bit_length()))
        docs = docs.select("doc_id", "text", *(c.alias(f"r{i}") for i, c in enumerate(row_key(), 1))).withColumn("row", F.monotonically_increasing_id())

        each = []
        for k in sorted(lengths):
            has = lambda key: f"exists(array(pmod({key}, {1 << bits}L)), x -> (shiftrightunsigned(get(s.bits, cast(shiftright(x, 6) as int)), cast(x % 64 as int)) & 1L) = 1L)"
            at = f"filter(if(size(s.h) >= {k}, sequence(0, size(s.h) - {k}), cast(array() as array<int>)), i -> {has(_ends('s.h', 'i', k))} AND {has(_all('s.h', 'i', k))})"
            each.append(f"get(transform(array({at}), at -> {_runs('at', k)}), 0)")
        hits = f"concat({', '.join(each)})" if each else "cast(array() as array<struct<pos:int,len:int,run:string>>)"
        # words, their hashes and the bits are bound once a row, as variables of lambdas; the optimizer puts these projections into one
        docs = docs.withColumn("w", F.array(words(F.col("text"))))
        table_of_bits = bit_table(windows, bits).scalar() if each else F.array().cast("array<bigint>")
        docs = docs.withColumn("s", F.transform("w", lambda w: F.struct(w.alias("w"), F.transform(w, lambda x: F.xxhash64(x)).alias("h"))))
        docs = docs.withColumn("s", F.arrays_zip("s", F.array(table_of_bits).alias("bits")))
        found = F.expr(f"get(transform(s, z -> get(transform(array(named_struct('w', z.s.w, 'h', z.s.h, 'bits', z.bits)), s -> named_struct('n_words', cast(size(s.w) as bigint), 'hits', {hits})), 0)), 0)")
        rows = docs.select("doc_id", "r1", "r2", "row", found.alias("f")).select("doc_id", "r1", "r2", "row", "f.n_words", F.posexplode_outer(_each_once(F.col("f.hits"))).alias("i", "hit"))
        rows = cut(rows.select("doc_id", "r1", "r2", "row", "n_words", "i", "hit.len", "hit.run", "hit.places"), "rows")
        met = rows.where("run is not null")
        verified = cut(verified_runs(met.select("len", "run").distinct(), F.broadcast(windows) if total <= FEW_WINDOWS else windows), "verified")
        spots = F.expr("flatten(transform(places, p -> transform(at, i -> struct(p + i as pos, len))))")
        met = lookup(met, verified, "run", FEW_WINDOWS // 4, how="inner").withColumn("spots", spots)
        every = rows.where("coalesce(i, 0) = 0").select("doc_id", "r1", "r2", "row", "n_words")
        kept = met.select("doc_id", "r1", "r2", "row", "n_words", "spots", "items").unionByName(every, allowMissingColumns=True)
        of = kept.groupBy("doc_id", "r1", "r2", "row", "n_words").agg(F.flatten(F.collect_list("spots")).alias("hits"), F.collect_set("items").alias("items"))
        covered = F.aggregate(
            F.array_sort("hits"),
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda s, x: F.struct(F.greatest(s["end"], x["pos"] + x["len"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["pos"] + x["len"] - F.greatest(s["end"], x["pos"]))).alias("n")),
            lambda s: s["n"].cast("long"),
        )
        return scratch.result(of.select("doc_id", "n_words", covered.alias("n_hit"), F.array_distinct(F.flatten("items")).alias("items"), F.array_sort("hits").alias("hits"), "r1", "r2"), "contamination")


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rule calls contaminated go; others that share their id stay."""
    with Scratch(spark) as scratch:
        bad = scratch.result(contamination(docs, table(spark, sf_dir, "benchmark")).where(is_contaminated()).select("r1", "r2").distinct(), "bad")
    return without_rows(docs, bad)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """The other way to clean: hit words go, with the separators before them; all documents stay."""
    names = [free_name(docs, c) for c in ("r1", "r2", "hits")]
    hit = contamination(docs, benchmark, n).where("n_hit > 0").groupBy("r1", "r2").agg(F.first("hits").alias("hits"))  # equal texts have equal hits
    hit = hit.select(*(F.col(c).alias(x) for c, x in zip(("r1", "r2", "hits"), names, strict=True)))
    word = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[0-9A-Za-z\x{80}-\x{10FFFF}]+"
    pieces = F.regexp_extract_all(F.col("text"), F.lit(f"({word})"), F.lit(1))
    kept = F.filter(pieces, lambda p, i: ~F.exists(names[2], lambda h: (i >= h["pos"]) & (i < h["pos"] + h["len"])))
    tail = F.regexp_extract(F.col("text"), r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)$", 1)
    joined = docs.withColumns(dict(zip(names, row_key(), strict=False))).join(hit, names[:2], "left")
    return joined.withColumn("text", F.when(F.col(names[2]).isNull(), F.col("text")).otherwise(F.concat(F.array_join(kept, ""), tail))).select(*(F.col(f"`{c}`") for c in docs.columns))


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, len, array_to_string(w[i:i + len - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 13) AS len, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT rid, len, i, array_to_string(w[i:i + len - 1], ' ') AS win
  FROM (SELECT rid, w, len, unnest(range(1, len(w) - len + 2)) AS i FROM d, (SELECT DISTINCT len FROM bw) WHERE len(w) >= len)
), hit AS (SELECT rid, i, dw.len, item_id FROM dw JOIN bw USING (len, win)
), pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + len)) AS p FROM (SELECT DISTINCT rid, i, len FROM hit)) GROUP BY rid
), it AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN it USING (rid)
"""
