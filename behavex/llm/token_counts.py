"""Token counts as rollups that signed deltas maintain.

A batch of changes (insert, delete, revise) becomes signed deltas of documents and tokens by
source, language and tokenizer version. Batches are committed by name, each once; a repeated batch
changes nothing. Totals are the sum over batches.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behavex.llm.common import new_path, table
from behavex.llm.tokens import encoder, tokenizer_path
from behavex.sources.files import Folder

KEYS = ["source", "lang", "tokenizer"]
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def _counted(tokenizers: dict[str, str]):
    """Sums by source, language and version within each Arrow batch, before any shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            docs: Counter = Counter()
            tokens: Counter = Counter()
            for s, g, sign, new, old in zip(*(rb.column(c) for c in ("source", "lang", "sign", "text", "old_text")), strict=True):
                for version, path in tokenizers.items():
                    key = (s.as_py(), g.as_py(), version)
                    docs[key] += sign.as_py()
                    for text, by in ((new, 1), (old, -1)):
                        if text.as_py():
                            tokens[key] += by * len(encoder(path).encode(text.as_py()))
            rows = [(*k, docs[k], tokens[k]) for k in docs]
            kinds = [pa.string()] * 3 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)], names=[*KEYS, "n_docs", "n_tokens"])

    return run


def deltas(changes: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    """changes(op, source, lang, text, old_text, ...) -> signed deltas, one row for each key.

    op is insert (text counts), delete (old_text is taken away) or revise (both); any other op,
    also null, is ignored. Null and empty text has no tokens but counts as a document. Null source
    and language are keys of their own. Each row is a change, so repeated rows count each."""
    known = changes.where("op in ('insert', 'delete', 'revise')")
    text = F.when(F.col("op") != "delete", F.col("text"))
    old = F.when(F.col("op") != "insert", F.col("old_text"))
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    rows = known.select("source", "lang", sign.alias("sign"), text.alias("text"), old.alias("old_text"))
    return rows.mapInArrow(_counted(tokenizers), _DELTA).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """The store. A batch's delta is written to a folder of its own; the file commits/<batch>, which can be made once only,
    names that folder. Every `fold` batches the committed deltas are summed into a snapshot, which names the batches that it has; totals
    are the newest snapshot and the deltas since."""

    def __init__(self, spark: SparkSession, path: str, fold: int = 64):
        self.spark, self.path, self.fold = spark, path.rstrip("/"), fold
        self._commits, self._store, self._snapshots = (Folder(spark, self.path + p) for p in ("/commits", "", "/snapshots"))

    def batches(self) -> set[str]:
        return {unquote(n[1:]) for n in self._commits.names()}

    def commit(self, batch: str, delta: DataFrame) -> bool:
        """Adds a batch once; False if it was there, or if another writer came first."""
        if batch in self.batches():
            return False
        folder = f"delta-{uuid.uuid4().hex}"
        delta.select(*KEYS, "n_docs", "n_tokens").coalesce(1).write.parquet(f"{self.path}/{folder}")  # one row for each key
        done = self._commits.create_once("b" + quote(batch, safe=""), folder)
        if not done:
            self._store.delete(folder)
        elif len(self._open(self._snapshot())) >= self.fold:
            self.snapshot()
        return done

    def _snapshot(self) -> dict:
        have = self._snapshots.names()
        return json.loads(self._snapshots.read(have[-1])) if have else {"number": 0, "folder": None, "commits": {}}

    def _open(self, last: dict) -> dict[str, str]:
        """The commits that the snapshot does not have yet, with their deltas' folders."""
        return {n: self._commits.read(n) for n in self._commits.names() if n not in last["commits"]}

    def _rows(self, folders: list[str]) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in folders]
        rows = self.spark.read.schema(_DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], _DELTA)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def snapshot(self) -> bool:
        """Sums what is committed; False if another writer has done so. The deltas that the snapshot before this one had are deleted."""
        last = self._snapshot()
        new, folder = self._open(last), f"sum-{uuid.uuid4().hex}"
        self._rows([*filter(None, [last["folder"]]), *new.values()]).coalesce(1).write.parquet(f"{self.path}/{folder}")
        text = json.dumps({"number": last["number"] + 1, "folder": folder, "commits": {**dict.fromkeys(last["commits"], ""), **new}})
        done = self._snapshots.create_once(f"s{last['number'] + 1:012d}", text)
        for f in filter(None, last["commits"].values()) if done else [folder]:
            self._store.delete(f)
        return done

    def totals(self) -> DataFrame:
        """Totals by key; keys whose documents have all gone have no row."""
        last = self._snapshot()
        return self._rows([*filter(None, [last["folder"]]), *self._open(last).values()]).where("n_docs <> 0 or n_tokens <> 0")


def changes(docs: DataFrame) -> list[tuple[str, DataFrame]]:
    """A table's history as batches whose net effect is the table: every document is inserted in one of two loads, one in
    sixteen (by hash) first as a draft that is then revised; as many are staged under another source and deleted again."""
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(16))
    rows = docs.select("source", "lang", "text", part.alias("part"))
    draft, none = F.concat(F.lit("draft "), "text"), F.lit(None).cast("string")

    def batch(op: str, where: str, text, old, source="source") -> DataFrame:
        return rows.where(where).select(F.lit(op).alias("op"), F.col(source) if source == "source" else F.lit(source).alias("source"), "lang", text.alias("text"), old.alias("old_text"))

    text = F.col("text")
    return [
        ("load-1", batch("insert", "part < 8", text, none)),
        ("load-2", batch("insert", "part between 8 and 14", text, none).unionByName(batch("insert", "part = 15", draft, none)).unionByName(batch("insert", "part = 7", text, none, "staging"))),
        ("revise", batch("revise", "part = 15", text, draft)),
        ("delete", batch("delete", "part = 7", none, text, "staging")),
    ]


VERSIONS = {"byte_bpe_50k": "byte_bpe_50k.json", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table's history through the store: inserts, drafts and their revisions, staged documents and their deletion,
    under two tokenizer versions; each batch is committed again without effect. The totals are those of a
    recount of the table, by source, language and tokenizer version."""
    docs = table(spark, sf_dir, "documents")
    versions = {v: tokenizer_path(f) for v, f in VERSIONS.items()}
    store = Rollup(spark, new_path(spark, "rollup"))
    for _ in range(2):
        for name, batch in changes(docs):
            store.commit(name, deltas(batch, versions))
    return store.totals()
