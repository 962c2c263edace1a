"""The trie of conversation prefixes, merged family by family.

A family is the conversations c of one base id, c - c % 100. Its members are rebuilt in one cogroup of their turns with the base's first
turns, and make a small trie of their own. What is shuffled from there on is a row for each node of a family's trie, never a text:

1. turns -> (family, conversation, turn, digest, code points): texts are hashed where they are read;
2. cogroup by family -> family nodes, each named by a 128-bit chained hash of its prefix;
3. nodes of equal name are merged: members, smallest member, the family that owns the node (the smallest);
4. each family gets its nodes' merged values back and sums over its subtrees what it owns, so that a node that several families have
   counts once. Sums over families of such sums give every figure of a subtree, at any depth, in this one step;
5. the digest of a node's ends is taken over its families' lists in order, as a stream.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from behavex.llm.common import Scratch, cut, lookup_counted, table

FAMILY, LONGEST = 100, 6
#: Families whose lists of ends make one row before lists are hashed.
TOGETHER = 1000
NOTHING = hashlib.sha256(b"").hexdigest()

_NODES = "family long, node binary, parent binary, depth long, low long, n long, points long, weight long, inner boolean, ends string"
_SHARES = "node binary, depth long, low long, parent_low long, n_convs long, weight long, own_points long, own_leaves long, own_children long"


def shared_turns(conv_id: int) -> int:
    """How many turns a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % LONGEST


def turns(conversations: DataFrame) -> DataFrame:
    """(family, conv_id, turn, digest, points): what the trie needs of each turn."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    c = F.col("conv_id").cast("long")
    return conversations.where("conv_id is not null").select((c - c % FAMILY).alias("family"), c.alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("points"))


def _ordered(rows: pa.Table) -> pa.Table:
    """By conversation and turn, null turns first, turns of equal number by digest."""
    keys = pa.table({"c": rows["conv_id"], "s": pc.is_valid(rows["turn"]), "t": pc.fill_null(rows["turn"], 0), "d": rows["digest"]})
    return rows.take(pc.sort_indices(keys, [("c", "ascending"), ("s", "ascending"), ("t", "ascending"), ("d", "ascending")]))


def rebuilt(members: pa.Table, base: pa.Table) -> Iterator[tuple[int, list[bytes], list[int]]]:
    """(conv_id, digests, code points) of each rebuilt conversation of a family, by ascending id."""
    base = _ordered(base).slice(0, LONGEST - 1)
    first = base["digest"].to_pylist(), base["points"].to_pylist()
    members = _ordered(members)
    ids, digests, points = (members[c].to_pylist() for c in ("conv_id", "digest", "points"))
    at = 0
    while at < len(ids):
        end = at
        while end < len(ids) and ids[end] == ids[at]:
            end += 1
        h = shared_turns(ids[at])
        yield ids[at], first[0][:h] + digests[at + h : end], first[1][:h] + points[at + h : end]
        at = end


def family_trie(members: pa.Table, base: pa.Table) -> pa.Table:
    """The nodes of one family's trie: weight sums over the subtree each node's members here times its code points."""
    family = members["family"][0].as_py()
    name, parent, depth, low, n, size, inner, ends = [b""], [-1], [0], [None], [0], [0], [False], [[]]
    child: dict[tuple[int, bytes], int] = {}
    for c, digests, points in rebuilt(members, base):
        at = 0
        n[0] += 1
        low[0] = c if low[0] is None else low[0]
        for d, p in zip(digests, points, strict=True):
            inner[at] = True
            to = child.get((at, d))
            if to is None:
                to = child[at, d] = len(name)
                name.append(hashlib.blake2b(name[at] + d, digest_size=16).digest())
                parent.append(at), depth.append(depth[at] + 1), low.append(c), n.append(0), size.append(p), inner.append(False), ends.append([])
            at = to
            n[at] += 1
        ends[at].append(c)
    weight = [a * b for a, b in zip(n, size, strict=True)]
    for i in range(len(name) - 1, 0, -1):  # a child comes after its parent
        weight[parent[i]] += weight[i]
    lists = [",".join(map(str, e)) if e else None for e in ends]
    columns = {"family": [family] * len(name), "node": name, "parent": [None if p < 0 else name[p] for p in parent], "depth": depth, "low": low, "n": n, "points": size, "weight": weight, "inner": inner, "ends": lists}
    types = [pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 5, pa.bool_(), pa.string()]
    return pa.table({c: pa.array(v, t) for (c, v), t in zip(columns.items(), types, strict=True)})


def family_shares(rows: pa.Table) -> pa.Table:
    """What one family adds to each of its nodes' figures: code points, leaves and children that it owns, summed over the subtree."""
    rows = rows.take(pc.sort_indices(rows, [("depth", "ascending")]))
    node, parent, points, mine, leaf, low = (rows[c].to_pylist() for c in ("node", "parent", "points", "mine", "leaf", "all_low"))
    at = {x: i for i, x in enumerate(node)}
    up = [-1 if p is None else at[p] for p in parent]
    owned, leaves, children = ([0] * len(node) for _ in range(3))
    for i in range(len(node) - 1, -1, -1):
        if mine[i]:
            owned[i] += points[i]
            leaves[i] += leaf[i]
        if up[i] >= 0:
            owned[up[i]] += owned[i]
            leaves[up[i]] += leaves[i]
            children[up[i]] += mine[i]
    return pa.table({"node": rows["node"], "depth": rows["depth"], "low": rows["all_low"], "parent_low": pa.array([None if u < 0 else low[u] for u in up], pa.int64()), "n_convs": rows["n_convs"], "weight": rows["weight"], "own_points": pa.array(owned, pa.int64()), "own_leaves": pa.array(leaves, pa.int64()), "own_children": pa.array(children, pa.int64())})


def _hash_lists(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, digest) of lists sorted by node and place; only one hash state is held."""
    now, state = None, None
    for rb in it:
        names, digests = [], []
        for node, ids in zip(rb.column("node").to_pylist(), rb.column("ids").to_pylist(), strict=True):
            if node != now:
                if state is not None:
                    names.append(now), digests.append(state.hexdigest())
                now, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(digests, pa.string())], names=["node", "digest"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["node", "digest"])


def end_digests(nodes: DataFrame) -> DataFrame:
    """(node, digest): SHA-256 over the ids that end at a node. Families are ranges of ids, so their lists, put together by
    thousands, are in order; a node where very many end is hashed as a stream of such lists."""
    lists = nodes.where("ends is not null").select("node", "family", F.floor(F.col("family") / (FAMILY * TOGETHER)).alias("part"), "ends")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("family", "ends"))), lambda x: x["ends"]), ",")
    some = lists.groupBy("node", "part").agg(joined.alias("ids"))
    return some.repartition("node").sortWithinPartitions("node", "part").select("node", "ids").mapInArrow(_hash_lists, "node binary, digest string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text, ...) -> (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256), a row for each distinct prefix of the rebuilt conversations.

    Null role and text are empty; null turns come first, and turns of equal number go by the SHA-256 of `length of role:role text`. Equal
    rows are turns of their own. Rows without conv_id belong to no conversation. Ids below 0 have the base c - c % 100 with SQL's
    remainder, so that -99 to 99 are one family. Other columns are ignored. An empty table has no root, thus no row. A task holds
    one family's turns as some 60 bytes each, at any length of text."""
    with Scratch(conversations.sparkSession) as scratch:
        short = cut(turns(conversations), "turns")
        base = short.where("conv_id = family")
        nodes = cut(short.groupBy("family").cogroup(base.groupBy("family")).applyInArrow(_cogroup, _NODES), "family-nodes")
        merged = nodes.groupBy("node").agg(F.sum("n").alias("n_convs"), F.min("low").alias("all_low"), F.min("family").alias("owner"), F.max("inner").alias("any_inner"), F.count("*").alias("rows"))
        merged = cut(merged, "merged")
        back = lookup_counted(nodes.drop("ends"), merged, "node", "rows")
        back = back.withColumn("mine", F.when(F.col("family") == F.col("owner"), 1).otherwise(0)).withColumn("leaf", F.when(F.col("any_inner"), 0).otherwise(1))
        shares = back.select("family", "node", "parent", "depth", "points", "weight", "mine", "leaf", "all_low", "n_convs").groupBy("family").applyInArrow(family_shares, _SHARES)
        total = shares.groupBy("node").agg(*(F.first(c).alias(c) for c in ("depth", "low", "parent_low", "n_convs")), *(F.sum(c).alias(c) for c in ("weight", "own_points", "own_leaves", "own_children")))
        out = total.join(end_digests(nodes), "node", "left").select(
            F.col("low").alias("conv_id"), "depth", F.col("parent_low").alias("parent_conv_id"), "n_convs", F.col("own_children").alias("n_children"), F.col("own_leaves").alias("n_leaves"),
            (F.col("weight") - F.col("own_points")).alias("saved_tokens"), F.coalesce("digest", F.lit(NOTHING)).alias("ends_sha256"),
        )
        return scratch.result(out, "trie")


def _cogroup(members: pa.Table, base: pa.Table) -> pa.Table:
    return family_trie(members, base)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 a byte at a time, its eight steps of a bit each written out as a reduction.
_CRC = f"""xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(3988292384, x >> 1) ELSE x >> 1 END)), 4294967295) % {LONGEST}"""

OP13_SQL = f"""WITH t AS MATERIALIZED (SELECT CAST(conv_id AS BIGINT) AS conv_id, sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS s, CAST(length(coalesce(text, '')) AS BIGINT) AS p, turn FROM conversations WHERE conv_id IS NOT NULL),
    o AS MATERIALIZED (SELECT conv_id, list(s ORDER BY turn NULLS FIRST, s) AS s, list(p ORDER BY turn NULLS FIRST, s) AS p FROM t GROUP BY conv_id),
    h AS MATERIALIZED (SELECT *, CAST({_CRC} AS BIGINT) AS h FROM o),
    r AS MATERIALIZED (SELECT a.conv_id, list_concat(coalesce(b.s[1:a.h], []), a.s[a.h + 1:]) AS s, list_concat(coalesce(b.p[1:a.h], []), a.p[a.h + 1:]) AS p FROM h a LEFT JOIN h b ON b.conv_id = a.conv_id - a.conv_id % {FAMILY}),
    m AS MATERIALIZED (SELECT conv_id, d, s[1:d] AS k, CASE WHEN d > 0 THEN s[1:d - 1] END AS up, CASE WHEN d > 0 THEN p[d] ELSE 0 END AS p, d = len(s) AS last FROM r, LATERAL (SELECT unnest(range(0, len(s) + 1)) AS d)),
    n AS MATERIALIZED (SELECT k, any_value(d) AS d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(p) AS p, bool_and(last) AS leaf, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '') AS ends FROM m GROUP BY k),
    a AS MATERIALIZED (SELECT k[1:x] AS k, sum(leaf::INT) AS leaves, sum((n - 1) * p) AS saved FROM n, LATERAL (SELECT unnest(range(0, d + 1)) AS x) GROUP BY 1),
    c AS MATERIALIZED (SELECT up AS k, count(*) AS children FROM n WHERE up IS NOT NULL GROUP BY up)
    SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n AS n_convs, CAST(coalesce(children, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
    FROM n JOIN a ON a.k = n.k LEFT JOIN c ON c.k = n.k LEFT JOIN n u ON u.k = n.up"""
