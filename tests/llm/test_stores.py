"""Stores under several writers, their clean-up, and operators side by side."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from behavex.llm import packing, sharding, token_counts
from behavex.llm.common import shared_folder
from behavex.llm.jaccard_join import jaccard_components
from behavex.llm.line_dedup import dedup_lines
from behavex.llm.tokens import tokenizer_path
from behavex.sources.files import Folder

SCHEMA = "doc_id long, text string"


def docs(spark, a, b):
    return spark.createDataFrame([(i, f"text {i} " + "word " * 400) for i in range(a, b)], SCHEMA)


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def racing(store, other):
    """The store's next commit meets another one that came between."""
    real = store.commit

    def commit(*args):
        store.commit = real
        other()
        return real(*args)

    store.commit = commit


def test_appends_and_merges_go_on_top(spark, tmp_path):
    store, second = (sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=1 << 20, fan_in=2) for _ in range(2))
    store.append(docs(spark, 0, 10))
    racing(store, lambda: second.append(docs(spark, 10, 20)))
    assert store.append(docs(spark, 20, 40), arrivals=2) == 4 and ids(store.read()) == list(range(40))  # a conflict in the midst of two arrivals
    run = store.plan(store.manifest())[0]
    racing(store, lambda: second.append(docs(spark, 40, 50)))
    assert store.merge(run) and ids(store.read()) == list(range(50))  # rebased over the append
    racing(store, lambda: second.compact())
    left = store.plan(store.manifest())
    assert all(not store.merge(r) for r in left) or not left  # the other was faster: nothing is merged twice
    assert ids(store.read()) == list(range(50))


def test_vacuum_takes_what_no_version_names(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=1 << 20, fan_in=2)
    for i in range(4):
        store.append(docs(spark, i * 5, i * 5 + 5), arrivals=2)
    store.compact()
    docs(spark, 100, 105).write.parquet(f"{tmp_path}/s/shards/of-a-dead-writer")
    files = lambda: {p.name for p in (tmp_path / "s" / "shards").rglob("*.parquet")}
    was = len(files())
    assert store.vacuum() == 0 and len(files()) == was  # all of them are young
    assert store.vacuum(keep=len(store.versions()), hours=0.0) >= 1
    assert store.vacuum(hours=0.0) > 0 and len(files()) == len(store.manifest())
    assert ids(store.read()) == list(range(20))
    empty = sharding.ShardStore(spark, str(tmp_path / "e"))
    assert empty.read(schema=docs(spark, 0, 1).schema).count() == 0 and empty.vacuum(hours=0.0) == 0


def test_very_long_texts_in_shards(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=1 << 16, fan_in=2)
    long = spark.createDataFrame([(i, ("ü" * 50 + str(i)) * 40_000) for i in range(4)], SCHEMA)
    for _ in range(2):
        store.append(long, arrivals=2)
    store.compact()
    key = lambda df: sorted((r.doc_id, r.h) for r in df.select("doc_id", F.sha2("text", 256).alias("h")).collect())
    assert key(store.read()) == key(long.unionByName(long))


def test_rollup_folds_deltas(spark, tmp_path):
    """Snapshots change no totals; batches that they have are still there once, and their deltas go."""
    plain, folded = token_counts.Rollup(spark, str(tmp_path / "p"), fold=10**6), token_counts.Rollup(spark, str(tmp_path / "f"), fold=3)
    delta = lambda n: spark.createDataFrame([("s", None if n % 2 else "en", "v", 1, n), ("t", "en", "v", (-1) ** n, 0)], token_counts._DELTA)
    rows = lambda r: sorted((tuple(x) for x in r.totals().collect()), key=repr)
    for n in range(11):
        for r in (plain, folded):
            assert r.commit(f"batch/{n}", delta(n)) and not r.commit(f"batch/{n}", delta(n))
        assert rows(plain) == rows(folded)
    assert len(folded._snapshots.names()) == 3 and len(folded._open(folded._snapshot())) == 2
    assert len([n for n in folded._store.names() if n.startswith("delta-")]) < 11 and folded.batches() == plain.batches()
    late = token_counts.Rollup(spark, str(tmp_path / "f"), fold=3)
    stale = late._snapshot()
    folded.snapshot()
    late._snapshot = lambda: stale  # a second writer folds the same deltas
    assert not late.snapshot() and rows(folded) == rows(plain)


def test_operators_side_by_side_leave_results_only(spark):
    """Two operators in two threads; of each the shared folder has what it returned, and nothing else."""
    texts = [(i, "\n".join(f"line {j} of {i % 3} with a few words more" for j in range(6))) for i in range(12)]
    df = spark.createDataFrame(texts, SCHEMA)
    folder = Folder(spark, shared_folder(spark))
    before = set(folder.names())
    work = [lambda: dedup_lines(df).agg(F.sum("n_removed")).first()[0], lambda: jaccard_components(df).select("component_id").distinct().count(), lambda: packing.pack(df, tokenizer_path("byte_bpe_50k.json")).count()]
    with ThreadPoolExecutor(3) as pool:
        assert list(pool.map(lambda f: f(), work)) == [54, 3, 12]
    assert len(set(folder.names()) - before) == 3
