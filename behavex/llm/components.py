"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from behavex.llm.common import cut, discard, lookup_counted


#: A step's minima are broadcast for so many links at most; beyond, each is repeated for so many salts.
FEW, SALTS = 500_000, 16
#: A member of a key knows so many of its keys before that one.
BEFORE = 8


def _star(edges: DataFrame, large: bool, links: int) -> DataFrame:
    """One step over so many links. A node's minimum is an aggregate with partial sums and returns by a broadcast or salted join, so
    that a node with very many neighbours is split over tasks."""
    both = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if links <= FEW:  # the minima are no more than the links' ends
        joined = both.join(F.broadcast(low), "u")
    else:
        spread = low.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
        joined = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS))).join(spread, ["u", "salt"]).drop("salt")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = low.select("u", F.col("m").alias("v"))
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) links of any two integer ids -> (id, component): the smallest id that each linked
    id reaches. Null ends and loops are ignored; an empty frame gives an empty frame. Nothing but
    two totals reaches the driver."""
    now = cut(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    was = state(now)
    for _ in range(rounds):
        if not was[0]:
            break
        after = cut(_star(_star(now, True, was[0]), False, 2 * was[0]), "edges")
        discard(now)
        now, is_ = after, state(after)
        if is_ == was:
            break
        was = is_
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def across(labelled: DataFrame, heads: DataFrame, rows: DataFrame | None, near: Callable[[str, str], Column] | None) -> DataFrame:
    """(x, y) pairs of different components c that share a key of labelled(key, doc, c), but for the heads(key, heads) of a key, whom
    all its members have met. Two that share many keys meet in the first of them, and again only in one before which the last
    BEFORE keys of either have none in common."""
    open_ = labelled.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count("*").alias("m")).where("a <> b and m > 2").select("key")
    members = labelled.join(open_.join(heads.select("key", "heads"), "key"), "key").where("not array_contains(heads, doc)").drop("heads")
    members = members.withColumn("before", F.collect_list("key").over(Window.partitionBy("doc").orderBy("key").rowsBetween(-BEFORE, -1)))
    members = members.join(rows, "doc") if rows is not None else members
    a, b = members.alias("a"), members.alias("b")
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.doc") > F.col("b.doc")) & (F.col("a.c") != F.col("b.c"))
    on = (on & near("a", "b") if near else on) & ~F.arrays_overlap("a.before", "b.before")
    return a.join(b, on).select(F.col("a.doc").alias("x"), F.col("b.doc").alias("y"))


def connect(kept: DataFrame, verify: Callable[[DataFrame], DataFrame], rows: DataFrame | None = None, near: Callable[[str, str], Column] | None = None) -> DataFrame:
    """Links among candidates: kept(key, doc, salt) -> verified (u, v) that connect all that the keys' pairs connect.

    Each member of a key first meets the key's leaders, one for each salt (a handful). Then, in
    keys whose members are still in different components, pairs across components meet. verify
    keeps the pairs (x, y) that link. rows(doc, ...) has what the test near(left, right) needs, which
    may only reject pairs that cannot link; it runs inside the joins."""
    heads = kept.groupBy("key", "salt").agg(F.min("doc").alias("head"), F.count("*").alias("c"))  # one for each salt
    heads = cut(heads.groupBy("key").agg(F.collect_list("head").alias("heads"), F.sum("c").alias("n")), "heads")
    mine = lookup_counted(kept.select("key", "doc"), heads, "key").groupBy("doc").agg(F.collect_set("heads").alias("h"))
    first = mine.select("doc", F.explode(F.array_distinct(F.flatten("h"))).alias("head")).where("doc <> head")
    first = cut(first.select(F.greatest("doc", "head").alias("x"), F.least("doc", "head").alias("y")).distinct(), "first")
    close = first
    if rows is not None:
        x, y = (rows.select(F.col("doc").alias(c), F.struct(*(n for n in rows.columns if n != "doc")).alias(f"s{c}")) for c in "xy")
        close = cut(first.join(x, "x").join(y, "y").where(near("sx", "sy")).select("x", "y"), "near")
    linked = cut(verify(close), "linked")

    part = components(linked.select(F.col("x").alias("u"), F.col("y").alias("v")))
    labelled = kept.select("key", "doc").join(part.withColumnRenamed("id", "doc"), "doc", "left").withColumn("c", F.coalesce("component", "doc"))
    labelled = cut(labelled.select("key", "doc", "c"), "labelled")
    rest = across(labelled, heads, rows, near)
    rest = cut(rest.distinct().join(first, ["x", "y"], "left_anti"), "rest")
    if not rest.isEmpty():
        linked = linked.unionByName(cut(verify(rest), "more"))
    return linked.select(F.col("x").alias("u"), F.col("y").alias("v"))
