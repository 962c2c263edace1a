"""Line dedup by winnowing over line hashes.

A document is its sequence of non-blank lines' hashes. Of each `window` consecutive grams of k lines the
smallest is a fingerprint, so that each run of k + window - 1 lines that stands in two places has a fingerprint
at the same place in both. Fingerprints join their first occurrence in corpus order (doc_id, then text hash,
then line), never all, so that a hot one costs a row an occurrence; the match is extended both ways
over the window - 1 lines on each side (a longer run is a chain of fingerprints), and where it comes to
k + window - 1 lines they are deleted. A fingerprint's first occurrence need not be its run's: two lines that
open many documents have one of their own. So fingerprints whose windows have not all matched join a second
time, keyed with the whole window, which leaves no run out.

Fewer lines count as a run if they have more than LONG words together; they have keys of their own, also at a document's
edge and in documents of one line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behavex.llm.common import Scratch, cut, free_name, lookup_counted, table

K, WINDOW = 2, 2
#: A run of more words counts however few its lines are.
LONG = 50
WORD = r"[^\x20\x09-\x0D]+"


def _fingerprints(k: int, window: int) -> str:
    """SQL: of each fingerprint the place q of its first line, its hash g, the hashes of the lines before (nearest first) and
    behind it, and the first lines of the windows it was picked in."""
    t = k + window - 1
    grams = f"if(size(hs) >= {t}, transform(sequence(0, size(hs) - {k}), q -> xxhash64(slice(hs, q + 1, {k}))), cast(array() as array<bigint>))"
    pick = f"transform(sequence(0, size(hs) - {t}), p -> p + cast(array_position(slice(gh, p + 1, {window}), array_min(slice(gh, p + 1, {window}))) as int) - 1)"
    windows = f"filter(sequence(greatest(0, q - {window - 1}), least(q, size(hs) - {t})), p -> get(ps, p) = q)"
    before = f"reverse(slice(hs, greatest(0, q - {window - 1}) + 1, least(q, {window - 1})))"
    mark = f"struct(q AS q, get(gh, q) AS g, {before} AS before, slice(hs, q + {k} + 1, {window - 1}) AS behind, {windows} AS windows)"
    # grams and picks are bound once, as variables of lambdas
    return f"flatten(transform(array({grams}), gh -> if(size(gh) = 0, cast(array() as array<struct<q:int,g:bigint,before:array<bigint>,behind:array<bigint>,windows:array<int>>>), flatten(transform(array({pick}), ps -> transform(array_distinct(ps), q -> {mark}))))))"


def _alike(a: str, b: str, most: int) -> str:
    """SQL: how many of the first elements of two arrays agree."""
    return f"size(filter({'sequence(1, ' + str(most) + ')' if most else 'cast(array() as array<int>)'}, j -> size({a}) >= j AND size({b}) >= j AND slice({a}, 1, j) = slice({b}, 1, j)))"


def _long_runs(least: int) -> str:
    """SQL: (p, n, g) of each run of fewer than least lines and more than LONG words: the first one's place, lines, hash of all."""

    def of(n: int) -> str:
        words = " + ".join(f"get(ws, p + {j})" for j in range(n))
        return f"transform(filter(sequence(0, size(hs) - 1), p -> p + {n} <= size(hs) AND {words} > {LONG}), p -> struct(p AS p, {n} AS n, xxhash64(slice(hs, p + 1, {n})) AS g))"

    return f"concat({', '.join(of(n) for n in range(1, least))})"


def _later(runs: DataFrame, key: list[str]) -> DataFrame:
    """Of runs(k1, k2, p, n, key) those that are not their key's first."""
    first = runs.groupBy(*key).agg(F.min(F.struct("k1", "k2", "p")).alias("f"), F.count("*").alias("m")).where("m > 1")
    return lookup_counted(runs, cut(first, "first"), key, "m").where("struct(k1, k2, p) > f").select("k1", "k2", "p", "n")


def repeated_lines(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text) -> (k1, k2, gone): the numbers of the lines to delete, of documents that have any.
    k1 is doc_id (null: the largest long), k2 the text's hash. To be called within a Scratch."""
    lines, t = F.split("text", "\n"), k + window - 1
    line = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.xxhash64(F.rtrim(x)).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("w"), (F.trim(x) != "").alias("full")))
    d = docs.where(F.col("text").rlike("[^ \n]"))  # not by the lines, which the optimizer would make once more for it
    d = d.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("k1"), F.xxhash64("text").alias("k2"), F.filter(line, lambda x: x["full"]).alias("l"))
    d = cut(d.select("k1", "k2", F.col("l.i").alias("places"), F.col("l.h").alias("hs"), F.col("l.w").alias("ws")).dropDuplicates(["k1", "k2"]), "lines")

    marks = cut(d.select("k1", "k2", F.explode(F.expr(_fingerprints(k, window))).alias("m")).select("k1", "k2", "m.*"), "marks")
    first = marks.groupBy("g").agg(F.min(F.struct("k1", "k2", "q", "before", "behind")).alias("f"), F.count("*").alias("m")).where("m > 1")
    met = lookup_counted(marks, cut(first, "first"), "g", "m").where("struct(k1, k2, q) > struct(f.k1, f.k2, f.q)")
    met = met.withColumns({"up": F.expr(_alike("before", "f.before", window - 1)), "down": F.expr(_alike("behind", "f.behind", window - 1))})
    met = cut(met.select("k1", "k2", "q", "g", "windows", "up", "down"), "met")
    matched = met.where(f"up + down + {k} >= {t}").select("k1", "k2", (F.col("q") - F.col("up")).alias("p"), (F.col("up") + F.col("down") + k).alias("n"))

    open_ = met.where(f"exists(windows, p -> q - p > up OR p + {t} - q - {k} > down)").select("g").distinct()
    again = marks.join(open_, "g", "left_semi").select("k1", "k2", "q", "g", "before", "behind", F.explode("windows").alias("p"))
    again = again.select("k1", "k2", "p", F.lit(t).alias("n"), F.expr(f"xxhash64(g, q - p, slice(before, 1, q - p), slice(behind, 1, p + {t} - q - {k}))").alias("w"))
    long = d.select("k1", "k2", F.explode(F.expr(_long_runs(t))).alias("m")).select("k1", "k2", "m.*") if t > 1 else None

    later = matched.unionByName(_later(cut(again, "again"), ["w"]))
    later = later.unionByName(_later(cut(long, "long"), ["n", "g"])) if long is not None else later
    later = later.groupBy("k1", "k2").agg(F.collect_list(F.struct("p", "n")).alias("later"))
    return later.join(d, ["k1", "k2"]).select("k1", "k2", F.expr("array_sort(array_distinct(flatten(transform(later, x -> slice(places, x.p + 1, x.n)))))").alias("gone"))


def dedup_lines(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text, ...) with text less its later repeated runs, plus n_lines and n_removed.

    Lines end at a line feed; they are equal if they agree but for blanks at their end, and blank
    lines neither count nor break a run. A run of fewer than k + window - 1 lines stays if it
    has no more than LONG words (without white space), however often it occurs. Null text stays
    null (0 lines). Of runs within one document the first stays. Rows that repeat doc_id and text are treated alike, as one occurrence. Other columns pass
    through unchanged, but for n_lines and n_removed, which are replaced. The result has a row for each row of docs, also where nothing is left."""
    k1, k2, dead = (free_name(docs, c) for c in ("k1", "k2", "gone"))
    with Scratch(docs.sparkSession) as scratch:
        gone = scratch.result(repeated_lines(docs, k, window).toDF(k1, k2, dead), "gone")
    keyed = docs.withColumn(k1, F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).withColumn(k2, F.xxhash64("text"))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(dead, i)), "\n")
    out = keyed.join(gone.hint("merge"), [k1, k2], "left").withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long"))
    out = out.withColumn("n_removed", F.coalesce(F.size(dead), F.lit(0)).cast("long"))
    return out.withColumn("text", F.when(F.col(dead).isNotNull(), kept).otherwise(F.col("text"))).select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: later repeated runs go; a document of which nothing is left goes with them."""
    out = dedup_lines(docs).where("n_removed = 0 or trim(text) <> ''")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*(F.col(f"`{c}`") for c in docs.columns))
