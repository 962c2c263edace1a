"""N-gram Jaccard join by parity sketches.

Every text's shingles are XOR-hashed into a sparse bit sketch: one bit for each shingle, bits hit
twice cancel, so the Hamming distance of two sketches never exceeds the symmetric difference of
the shingle sets. With similarity t that difference is at most (a + b)(1 - t)/(1 + t), and for a
set of a shingles and any larger partner at most need(a) = a(1 - t)/t. The sketch is cut into
bands; of need(a) + 1 non-empty bands one must be equal in both texts (pigeonhole). Texts meet by
the hash of an equal band within a size band (sizes within a factor of two; texts near the edge
enter two). What meets is verified exactly.

Each set is a node, whatever ids its texts have. A node's id is a 64-bit hash of its set; that no two
sets share one is checked, and the ids are drawn anew if they do. Texts are hashed once.

Skew. Texts with equal sets are one node. Each text leaves out its commonest band values (those of
common passages), as many as it has bands beyond the possible differences. Order all values by how
many texts have them: of two texts that link, each would have to leave out one value more than it may
before it left out the rarest that they share, so they still meet there. Members of a value, such as a
large group of near copies, meet a few salted leaders first; only texts that are still in different
components of the same band value are compared with one another, after a Hamming test inside the join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from behavex.llm.common import Scratch, blocks, cut, discard, free_name, hashed_words, lookup, mix, row_key, semi, shingles, table, without_rows
from behavex.llm.components import components, connect

#: A band value with more texts than this is hot.
HOT = 64
SALTS = 4
SKETCH_WORDS = 8
_SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]
#: Sets of so many shingles, for which those are few bits, have so many longs more that are compared inside the join.
FINE = [(2048, 64), (256, 32)]
#: Sets of so many shingles also have a parity sketch of a bit or two for each shingle.
WIDE_FROM = 512


class Bands:
    """Band counts for a similarity num/den (above one half) and shingles of k words."""

    def __init__(self, num: int = 80, den: int = 100, k: int = 5):
        self.num, self.den, self.k = num, den, k
        self._layouts: dict[int, tuple[int, float]] = {}

    def need(self, a: int) -> int:
        """Most differences between a set of size a and a partner of at least its size."""
        return a * (self.den - self.num) // self.num

    def need_larger(self, b: int) -> int:
        """Most differences between a set of size b and a partner of at most its size."""
        return 2 * b * (self.den - self.num) // (self.den + self.num)

    def smallest(self, b: int) -> int:
        return -(-b * self.num // self.den)

    def layout(self, size_band: int) -> tuple[int, float]:
        """(number of bands, spare bands) for sizes of [2^size_band, 2^(size_band+1))."""
        if size_band in self._layouts:
            return self._layouts[size_band]
        top, rate = 2 ** (size_band + 1), self.rate
        n = rate * top + 2
        for _ in range(60):  # tiny sets would ask for ever more; keys() has another way for them
            empty = math.exp(-top / n)
            n = min(4 * top, (rate * top + 2 + 4 * math.sqrt(n * empty * (1 - empty))) / (1 - empty))
        empty = math.exp(-top / n)
        spare = (2 + 4 * math.sqrt(n * empty * (1 - empty))) / (1 - empty)
        self._layouts[size_band] = math.ceil(n) + 1, spare
        return self._layouts[size_band]

    @property
    def rate(self) -> float:
        """Non-empty bands asked for per shingle, so that need_larger() holds in the bands of the smallest partner."""
        return max((self.den - self.num) / self.num, 2 * (self.den - self.num) / (self.den + self.num) * self.den / self.num)

    def emitted(self, s: int, size_band: int) -> int:
        """Bands with a lower number are used for a set of size s; never falls as s grows."""
        n, spare = self.layout(size_band)
        return min(n, math.ceil(self.rate * s / (1 - math.exp(-s / n)) + spare))

    def size_bands(self, s: int) -> list[int]:
        own = s.bit_length() - 1
        return [own, own + 1] if s * self.den >= self.num * 2 ** (own + 1) else [own]

    def keys(self, sets: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Bands of many sets at once: (key, place of the set, whether the smallest partner uses it too).

        A set with too few non-empty bands (rare) also gives its lowest shingles as bands of their
        own, one more than may differ; two such sets meet there."""
        entry, sb = [], []  # each set once for each of its size bands
        for i, sh in enumerate(sets):
            if self.need(len(sh)):  # else only an equal set links with it
                for b in self.size_bands(len(sh)):
                    entry.append(i)
                    sb.append(b)
        if not entry:
            none = np.zeros(0, dtype=np.int64)
            return none.view(np.uint64), none, none.astype(bool), none, none, none
        size = np.array([len(sets[i]) for i in entry])
        n, used, inner = (np.array(x, dtype=np.uint64) for x in zip(*((self.layout(b)[0], self.emitted(s, b), self.emitted(self.smallest(s), b)) for s, b in zip(size.tolist(), sb, strict=True)), strict=True))
        sh = np.concatenate([sets[i] for i in entry])
        at = np.repeat(np.arange(len(entry), dtype=np.uint64), size)
        salt = np.array(sb, dtype=np.uint64)
        with np.errstate(over="ignore"):
            band = ((mix(sh + np.repeat(salt, size)) >> np.uint64(32)) * np.repeat(n, size)) >> np.uint64(32)
            keep = band < np.repeat(used, size)
            place, bit = (at[keep] << np.uint64(32)) | band[keep], mix((sh[keep] >> np.uint64(20)) + np.uint64(0xA5A5A5A5))
            order = np.argsort(place)
            place = place[order]
            cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, dtype=np.int64)
            value, place = np.bitwise_xor.reduceat(bit[order], cuts) if len(cuts) else bit, place[cuts]
            value, place = value[value != 0], place[value != 0]
            row, band = (place >> np.uint64(32)).astype(np.int64), place & np.uint64(0xFFFFFFFF)
            near = band < inner[row]
            key = mix(value ^ mix(band + (salt[row] << np.uint64(40))))
            n1, n2 = np.bincount(row, minlength=len(entry)), np.bincount(row[near], minlength=len(entry))
            need = np.array([(self.need(s), self.need_larger(s)) for s in size.tolist()])
            for e in np.flatnonzero((n1 <= need[:, 0]) | (n2 <= need[:, 1])):
                low = mix(sets[entry[e]][: need[e].max() + 1] ^ (np.uint64(0x5EED) + salt[e]))
                key, row, near = np.r_[key, low], np.r_[row, np.full(len(low), e)], np.r_[near, np.ones(len(low), dtype=bool)]
        return key, np.array(entry)[row], near, np.array(entry), n1 - need[:, 0] - 1, n2 - need[:, 1] - 1


def _sets(held: list[bytes], k: int) -> list[np.ndarray]:
    words, at = hashed_words(held)
    return [shingles(words[at[i] : at[i + 1]], k) for i in range(len(held))]


def _wide(sh: np.ndarray) -> bytes | None:
    """A parity sketch of 2^j bits, at least one for each shingle; a larger one folds to a smaller by XOR of its parts."""
    if len(sh) < WIDE_FROM:
        return None
    bits = 1 << (len(sh) - 1).bit_length()
    return np.packbits((np.bincount((sh >> np.uint64(10)).astype(np.int64) % bits, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _fine(sh: np.ndarray) -> np.ndarray | None:
    """A parity sketch of as many longs as FINE has for the size."""
    bits = 64 * next((words for least, words in FINE if len(sh) >= least), 0)
    return np.packbits((np.bincount((sh >> np.uint64(10)).astype(np.int64) % bits, minlength=bits) & 1).astype(np.uint8)).view(np.int64) if bits else None


def _apart(a: bytes, b: bytes) -> int:
    """Hamming distance of two wide sketches, the larger folded."""
    p, q = (np.frombuffer(x, dtype=np.uint8) for x in (a, b))
    size = min(len(p), len(q))
    p, q = (np.bitwise_xor.reduce(x.reshape(-1, size), axis=0) for x in (p, q))
    return int(np.bitwise_count(p ^ q).sum())


#: What is known of each row: its text's key, size, node, a second hash of the set, its keys (the lowest bit says whether the
#: smallest partner uses the key too), how many it can miss in its two roles, and its sketches.
_PROFILE = "doc_id long, r1 long, r2 long, n long, node long, check long, keys array<long>, spare1 long, spare2 long, " + ", ".join(f"{s} long" for s in _SKETCH) + ", fine array<long>, wide binary"


def _profiles(bands: Bands, seed: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for at, held in blocks(rb.column("text")):
                sets = _sets(held, bands.k)
                n, f = np.zeros(len(held), dtype=np.int64), np.zeros((2 + SKETCH_WORDS, len(held)), dtype=np.uint64)
                for i, sh in enumerate(sets):
                    if len(sh):
                        n[i] = len(sh)
                        with np.errstate(over="ignore"):
                            f[0, i], f[1, i] = mix(sh + np.uint64(seed)).sum(keepdims=True), np.bitwise_xor.reduce(mix(sh ^ np.uint64(0x1234567)))
                        bit = np.bincount((sh >> np.uint64(10)).astype(np.int64) % (64 * SKETCH_WORDS), minlength=64 * SKETCH_WORDS) & 1
                        f[2:, i] = np.packbits(bit.astype(np.uint8)).view(np.uint64)
                key, place, near, entry, *spares = bands.keys(sets)
                order = np.argsort(place, kind="stable")
                ends = np.searchsorted(place[order], np.arange(len(held) + 1)).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(((key & ~np.uint64(1)) | near.astype(np.uint64))[order].view(np.int64)))
                least = np.full((2, len(held)), 1 << 40)
                for j in (0, 1):
                    np.minimum.at(least[j], entry, spares[j])
                head = [rb.column(c).slice(at, len(held)) for c in ("doc_id", "r1", "r2")]
                fine = pa.array([_fine(sh) for sh in sets], type=pa.list_(pa.int64()))
                wide = pa.array([_wide(sh) for sh in sets], type=pa.binary())
                longs = [pa.array(x.view(np.int64)) for x in f]
                yield pa.RecordBatch.from_arrays([*head, pa.array(n), *longs[:2], keys, *map(pa.array, least), *longs[2:], fine, wide], names=[c.split()[0] for c in _PROFILE.split(", ")])

    return run


def _verify(bands: Bands):
    """Keeps pairs whose exact similarity reaches the threshold."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            x, y = rb.column("x").to_numpy(zero_copy_only=False), rb.column("y").to_numpy(zero_copy_only=False)
            good = np.zeros(len(x), dtype=bool)
            known: dict[str, np.ndarray] = {}

            def sets(t: str, known=known) -> np.ndarray:
                if (got := known.get(t)) is None:
                    if len(known) > 2000:
                        known.clear()
                    words, _ = hashed_words([(t or "").encode("utf-8", "surrogatepass")])
                    got = known[t] = shingles(words, bands.k)
                return got

            for i, (tx, ty) in enumerate(zip(rb.column("tx"), rb.column("ty"), strict=True)):
                a, b = sets(tx.as_py()), sets(ty.as_py())
                if len(a) and len(b) and min(len(a), len(b)) * bands.den >= bands.num * max(len(a), len(b)):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    good[i] = bands.den * both >= bands.num * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([pa.array(x[good], type=pa.int64()), pa.array(y[good], type=pa.int64())], names=["x", "y"])

    return run


def _may_link(bands: Bands, a: str, b: str) -> Column:
    """Sizes and the Hamming distance of the parity sketches (the fine ones where both have as many longs) allow the similarity; it never rejects a link."""
    apart = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in _SKETCH), F.lit(0))
    finer = F.aggregate(F.zip_with(f"{a}.fine", f"{b}.fine", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    few = lambda apart: apart * (bands.den + bands.num) <= (na + nb) * (bands.den - bands.num)
    return (na * bands.den >= nb * bands.num) & (nb * bands.den >= na * bands.num) & few(apart) & F.coalesce(few(finer), F.lit(True))


def _may_link_wide(bands: Bands):
    """Keeps pairs whose wide sketches allow the similarity; it never drops a link."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            rows = zip(*(rb.column(c) for c in ("nx", "ny", "wx", "wy")), strict=True)
            good = [not (p.is_valid and q.is_valid) or _apart(p.as_py(), q.as_py()) * (bands.den + bands.num) <= (m.as_py() + n.as_py()) * (bands.den - bands.num) for m, n, p, q in rows]
            yield pa.RecordBatch.from_arrays([rb.column(c) for c in "xy"], names=["x", "y"]).filter(pa.array(good, type=pa.bool_()))

    return run


def verified(pairs: DataFrame, texts: DataFrame, wide: DataFrame, bands: Bands) -> DataFrame:
    """(x, y) pairs of nodes that link, of texts(doc, text). Long texts meet by their wide sketches(doc, n, wide) first,
    so that texts are joined for pairs that hardly fail; both come by two joins on the nodes."""
    side = lambda c: wide.select(F.col("doc").alias(c), F.col("n").alias(f"n{c}"), F.col("wide").alias(f"w{c}"))
    pairs = cut(pairs.join(side("x"), "x").join(side("y"), "y").mapInArrow(_may_link_wide(bands), "x long, y long"), "wide")
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("doc")).distinct()
    texts = cut(texts(wanted), "texts")
    side = lambda c, t: texts.select(F.col("doc").alias(c), F.col("text").alias(t))
    return pairs.join(side("x", "tx"), "x").join(side("y", "ty"), "y").mapInArrow(_verify(bands), "x long, y long")


def _classes(docs: DataFrame, bands: Bands) -> DataFrame:
    """(doc_id, r1, r2, n, class, first) for each row: the smallest node that its own reaches by links (null without words), and
    the smallest doc_id of the class. To be called within a Scratch."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(c.alias(f"r{i}") for i, c in enumerate(row_key(), 1)))
    for seed in range(0, 50, 7):
        profiles = cut(plain.mapInArrow(_profiles(bands, seed), _PROFILE), "profiles")
        real = profiles.where("n > 0")
        same = cut(real.groupBy("node").agg(F.count("*").alias("copies"), F.min("check").alias("low"), F.max("check").alias("high")).where("copies > 1"), "same")
        if same.where("low <> high").isEmpty():
            break
    else:
        raise RuntimeError("no seed gives every set a hash of its own")

    # one row stands for each node: of those with copies the one with the smallest key
    one = semi(real, same.select("node"), "node").groupBy("node").agg(F.min(F.struct("r1", "r2")).alias("k")).select("node", "k.*")
    single = semi(real, same.select("node"), "node", how="left_anti")
    chosen = semi(real, cut(one, "one"), ["node", "r1", "r2"]).dropDuplicates(["node"])
    nodes = cut(single.unionByName(chosen), "nodes").withColumnRenamed("node", "doc")
    rows = cut(profiles.select("doc_id", "r1", "r2", "n", "node"), "keyed")
    discard(profiles)

    def texts(wanted: DataFrame) -> DataFrame:
        here = cut(semi(nodes, wanted, "doc").select("doc", "r1", "r2"), "wanted")
        found = semi(plain, here.select("r1", "r2"), ["r1", "r2"]).select("r1", "r2", "text").dropDuplicates(["r1", "r2"])
        return found.join(here, ["r1", "r2"]).select("doc", "text")

    root = components(_links(nodes, texts, bands)).select(F.col("id").alias("node"), F.col("component").alias("root"))
    rows = lookup(rows, cut(root, "roots"), "node")
    rows = cut(rows.select("doc_id", "r1", "r2", "n", F.when(F.col("n") > 0, F.coalesce("root", "node")).alias("class")), "rows")
    first = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("first"), F.count("*").alias("m")).where("m > 1").select("class", "first")
    return lookup(rows, cut(first, "first"), "class")


def jaccard_components(docs: DataFrame, num: int = 80, den: int = 100, k: int = 5) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_shingles, component_id), one row for each row of docs.

    Words are runs without white space, A-Z lower-cased. A text of fewer than k words is one
    shingle; null or blank text has none, links with nothing and is its own component. component_id
    is the smallest doc_id that links reach. Links are between texts: rows that share a doc_id each get their own
    text's component, repeated rows get the same, and a row with null doc_id links like any other but gives the
    component no id (null if no row of it has one). Other columns of docs are ignored; an empty table gives an empty result."""
    with Scratch(docs.sparkSession) as scratch:
        found = _classes(docs, Bands(num, den, k))
        return scratch.result(found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id")), "jaccard")


def _links(nodes: DataFrame, texts, bands: Bands) -> DataFrame:
    """Verified links (u, v) of different sets that connect what all links connect."""
    keys = nodes.select(F.explode("keys").alias("k"), "doc").select(F.shiftright("k", 1).alias("key"), "doc", (F.col("k") % 2 != 0).alias("near"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(keys.join(shared, "key"), "met")  # (key, doc, near, n): the rows of keys that sets share

    # a set leaves out its commonest keys, as many as its spare bands allow in both roles
    ranked = Window.partitionBy("doc").orderBy(F.desc("n"), F.desc("key")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = met.join(nodes.select("doc", "spare1", "spare2"), "doc").withColumns({"lost1": F.count("*").over(ranked), "lost2": F.count_if("near").over(ranked)})
    salt = F.when(F.col("n") > HOT, F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).otherwise(0)
    kept = cut(ranks.where("lost1 > spare1 or lost2 > spare2").select("key", "doc", salt.alias("salt")), "kept")
    sketch, wide = nodes.select("doc", "n", *_SKETCH, "fine"), nodes.select("doc", "n", "wide")
    return connect(kept, lambda pairs: verified(pairs, texts, wide, bands), sketch, lambda a, b: _may_link(bands, a, b))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the smallest doc_id stays (of several texts under that id the one with
    the smallest hash, a null id last), and of rows that repeat it one. Texts without words all stay."""
    with Scratch(spark) as scratch:
        found = cut(_classes(docs, Bands()).where("first is not null or class is not null"), "found")
        key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "r1", "r2")
        many = found.groupBy("class").agg(F.count("*").alias("m"), F.min(key).alias("k")).where("m > 1")
        best = cut(many.select("class", F.col("k.r1").alias("b1"), F.col("k.r2").alias("b2")), "best")
        member = cut(lookup(found, best, "class").where("b1 is not null"), "member")
        gone = scratch.result(member.where("r1 <> b1 or r2 <> b2").select("r1", "r2").distinct(), "gone")
        again = scratch.result(member.where("r1 = b1 and r2 = b2").groupBy("r1", "r2").agg(F.count("*").alias("m")).where("m > 1").select("r1", "r2"), "again")
    kept = without_rows(docs, gone)
    if again.isEmpty():
        return kept
    names = [free_name(docs, "r1"), free_name(docs, "r2")]  # of rows that repeat the one that stays, one stays
    keyed = kept.withColumns(dict(zip(names, row_key(), strict=True)))
    again = again.select(F.col("r1").alias(names[0]), F.col("r2").alias(names[1]))
    kept = semi(keyed, again, names, how="left_anti").unionByName(semi(keyed, again, names).dropDuplicates(names))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
