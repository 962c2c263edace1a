"""A training corpus from raw documents: rejects, repeated lines, near duplicates and benchmark
text go, and what is left is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from behavex.llm.common import Scratch, discard, table
from behavex.llm.decontaminate import drop_contaminated
from behavex.llm.jaccard_join import keep_one
from behavex.llm.line_dedup import without_repeats
from behavex.llm.packing import packed
from behavex.llm.quality import accepted

#: (name, function(spark, docs, sf_dir) -> DataFrame); the next stage reads what one has written.
STAGES = [
    ("quality_classifier", accepted),
    ("line_dedup", without_repeats),
    ("ngram_jaccard_join", keep_one),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", packed),
]

#: Trained models, tokenizers and component search have no SQL form; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with Scratch(spark) as scratch:
            docs, old = scratch.result(stage(spark, docs, sf_dir), name), before
        if old is not None:
            discard(old)
        before = docs
    return docs
