"""Quality by co-training of two views.

One classifier sees a document's text (which words occur, and what the characters are like), the
other only its page metadata (source, language, length). Both start from labelled rows; over a
few rounds each labels the unlabelled rows it is most sure of for the other. Held-out labelled
rows then calibrate each view's score, and the calibrated scores are combined. There are two such targets, quality and
toxicity; a document is accepted if its quality score is at least one half and its toxicity score
below it.

Fitting takes a bounded sample: `most_labelled` labelled and `most_unlabelled` unlabelled rows,
those with the smallest hash of doc_id. Which words tell the classes apart is counted in the tasks; the driver gets those words
(`VOCABULARY` at most) and of each sampled row which of them it has. Scoring covers every document in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from behavex.llm.common import Scratch, blocks, cut, free_name, hashed_words, table

LABELLED, UNLABELLED = 6000, 3000
#: Words that a text view knows, and sources and languages that a metadata view knows.
VOCABULARY, KNOWN_PAGES = 20_000, 500
TARGETS = ("quality", "toxic")

#: Every byte that does not belong to a letter, a digit or a non-ASCII character.
_NOT_WORD = np.ones(256, dtype=bool)
_NOT_WORD[48:58] = _NOT_WORD[65:91] = _NOT_WORD[97:123] = _NOT_WORD[128:] = False
_KINDS = 8
_KIND = np.full(256, 7, dtype=np.int64)  # 7: letters and the rest
_KIND[list(b"*#$%&@^~=+<>{}[]\\")] = 0
_KIND[list(b"!?")] = 1
_KIND[list(b"|/_")] = 2
_KIND[list(b".,;:'\"()-")] = 3
_KIND[48:58] = 4
_KIND[65:91] = 5
_KIND[[9, 10, 11, 12, 13, 32]] = 6


def _word_sets(held: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, word hash) of all texts, and how many words each text has."""
    words, at = hashed_words(held, _NOT_WORD)
    doc = np.repeat(np.arange(len(held)), np.diff(at))
    order = np.lexsort((words, doc))
    words, doc = words[order], doc[order]
    new = np.ones(len(words), dtype=bool)
    new[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], words[new], np.diff(at)


def _shape(held: list[bytes], doc: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Dense features of each text: shares of kinds of characters, of distinct words, words a line, word length."""
    size = np.array([len(b) for b in held])
    buf = np.frombuffer(b"".join(held), dtype=np.uint8)
    of = np.repeat(np.arange(len(held)), size)
    kinds = np.bincount(of * _KINDS + _KIND[buf], minlength=len(held) * _KINDS).reshape(-1, _KINDS)
    lines = np.bincount(of[buf == 10], minlength=len(held)) + 1
    distinct = np.bincount(doc, minlength=len(held))
    share = kinds / np.maximum(1, size)[:, None]
    return np.column_stack([np.sqrt(share), distinct / np.maximum(1, n_words), np.log1p(n_words), np.log1p(n_words / lines), size / np.maximum(1, n_words) / 10])


@dataclass
class Pages:
    """The sources and languages that the metadata view knows, as sorted 64-bit hashes; each has a feature of its own, all others share one."""

    sources: np.ndarray
    languages: np.ndarray

    @classmethod
    def of(cls, source: np.ndarray, language: np.ndarray) -> Pages:
        def common(x: np.ndarray) -> np.ndarray:
            values, count = np.unique(x, return_counts=True)
            return np.sort(values[np.lexsort((values, -count))][:KNOWN_PAGES])

        return cls(common(source), common(language))

    def features(self, source: np.ndarray, language: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
        """n_chars is -1 where it is null."""
        parts = []
        for known, x in ((self.sources, source), (self.languages, language)):
            one = np.zeros((len(x), len(known) + 1))
            at = np.minimum(np.searchsorted(known, x), len(known) - 1)
            one[np.arange(len(x)), np.where(known[at] == x, at, len(known))] = 1
            parts.append(one)
        x = np.log1p(np.maximum(0, n_chars)) / 10
        return np.column_stack([*parts, x, x * x, n_chars < 0, n_chars == 0])


@dataclass
class Linear:
    """Logistic regression on standardised dense features and, for the text view, known words."""

    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    words: np.ndarray = field(default_factory=lambda: np.zeros(0))
    dense: np.ndarray = field(default_factory=lambda: np.zeros(0))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def fit(self, dense: np.ndarray, rows: np.ndarray, cols: np.ndarray, y: np.ndarray, steps: int = 120, l2: float = 1e-4) -> Linear:
        self.mean, self.scale = dense.mean(0), dense.std(0) + 1e-3
        x = (dense - self.mean) / self.scale
        n, k = len(y), len(self.vocabulary)
        w, d, b = np.zeros(k), np.zeros(x.shape[1]), 0.0
        gw, gd, gb = np.full(k, 1e-8), np.full(x.shape[1], 1e-8), 1e-8
        for _ in range(steps):  # AdaGrad on the whole sample
            z = x @ d + b + (np.bincount(rows, weights=w[cols], minlength=n) if k else 0)
            e = (_sigmoid(z) - y) / n
            g = x.T @ e + l2 * d
            gd += g * g
            d -= 0.5 * g / np.sqrt(gd)
            gb += e.sum() ** 2
            b -= 0.5 * e.sum() / np.sqrt(gb)
            if k:
                g = np.bincount(cols, weights=e[rows], minlength=k) + l2 * w
                gw += g * g
                w -= 0.3 * g / np.sqrt(gw)
        self.words, self.dense, self.bias = w, d, b
        return self

    def logit(self, dense: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        z = (dense - self.mean) / self.scale @ self.dense + self.bias
        return z + np.bincount(rows, weights=self.words[cols], minlength=len(z)) if len(self.words) else z


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _known(vocabulary: np.ndarray, doc: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(vocabulary):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    good = vocabulary[at] == words
    return doc[good], at[good]


@dataclass
class Views:
    """The two views of one target: each one's logit is calibrated (a * logit + b), and the calibrated ones are combined."""

    text: Linear
    meta: Linear
    pages: Pages
    calibration: list[np.ndarray]
    mix: np.ndarray

    def calibrated(self, dense, rows, cols, meta) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, dtype=np.int64)
        raw = self.text.logit(dense, rows, cols), self.meta.logit(meta, none, none)
        return tuple(a * z + b for z, (a, b) in zip(raw, self.calibration, strict=True))

    def scores(self, dense, rows, cols, meta):
        t, m = self.calibrated(dense, rows, cols, meta)
        return _sigmoid(np.column_stack([t, m, np.ones(len(t))]) @ self.mix), _sigmoid(t), _sigmoid(m)


def co_train(y: np.ndarray, held: np.ndarray, vocabulary: np.ndarray, dense: np.ndarray, rows: np.ndarray, cols: np.ndarray, meta: np.ndarray, pages: Pages, rounds: int = 3, sure: float = 0.97, share: float = 0.1) -> Views:
    """Rows with y of 0 or 1 are labelled, those with -1 not; held labelled rows only calibrate. rows and cols say what words of the vocabulary a row has."""
    base, calibrates = np.flatnonzero((y >= 0) & ~held), np.flatnonzero((y >= 0) & held)
    label = [y.astype(float).copy(), y.astype(float).copy()]  # what each view is taught
    free = np.flatnonzero(y < 0)
    none = np.zeros(0, dtype=np.int64)
    views = [Linear(vocabulary=vocabulary), Linear()]
    for r in range(rounds):
        for v in (0, 1):
            use = np.zeros(len(y), dtype=bool)
            use[base] = True
            use[free] = label[v][free] >= 0
            place = np.cumsum(use) - 1
            mine = use[rows]
            views[v].fit((dense, meta)[v][use], place[rows[mine]] if v == 0 else none, cols[mine] if v == 0 else none, label[v][use])
        if r + 1 < rounds and len(free):
            logits = (views[0].logit(dense, rows, cols)[free], views[1].logit(meta, none, none)[free])
            for v in (0, 1):  # each teaches the other what it is sure of, the surest first
                p = _sigmoid(logits[v])
                sureness = np.maximum(p, 1 - p)
                pick = [i for i in np.argsort(-sureness, kind="stable")[: int(share * len(free)) + 1] if sureness[i] >= sure]
                label[1 - v][free[pick]] = (p[pick] >= 0.5).astype(float)
    known = y[calibrates].astype(float)
    raw = views[0].logit(dense, rows, cols)[calibrates], views[1].logit(meta, none, none)[calibrates]
    calibration = [_logistic(z[:, None], known, np.array([1e-2])) for z in raw]
    t, m = (a * z + b for z, (a, b) in zip(raw, calibration, strict=True))
    return Views(views[0], views[1], pages, calibration, _logistic(np.column_stack([t, m]), known, np.array([1e-2, 1.0])))


def _logistic(z: np.ndarray, y: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """Weights of the columns of z and a constant by regularised logistic regression: Newton's method with step
    halving on logits of unit spread, since separable rows have no finite optimum of their own."""
    spread = np.r_[z.std(0) + 1e-6, 1.0]
    x, ridge = np.column_stack([z, np.ones(len(z))]) / spread, np.r_[ridge, 1e-3]
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + ridge @ (w * w) / 2
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if abs(size * step).max() < 1e-6:
            break
    return w / spread


def _row() -> list[Column]:
    """What the tasks are given of a row: its text, source and language as hashes, null length as -1."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("source").alias("source"), F.xxhash64("lang").alias("lang"), F.coalesce(F.col("n_chars").cast("long"), F.lit(-1)).alias("n_chars")]


def _sample(docs: DataFrame, labels: DataFrame, most_labelled: int, most_unlabelled: int) -> DataFrame:
    """(doc_id, text, source, lang, n_chars, quality, toxic, held): the sampled rows. Of texts that share an id the one with the smallest hash
    stands for it; of several labels of an id the largest counts. Every fifth labelled id, by hash, is held out."""
    labels = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(t).cast("int").alias(t) for t in TARGETS))
    base = docs.where("text is not null and trim(text) <> '' and doc_id is not null").select(*_row())

    def smallest(ids: DataFrame, most: int) -> DataFrame:
        return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    keyed = base.select("doc_id").dropDuplicates(["doc_id"])
    given = smallest(keyed.join(labels, "doc_id"), most_labelled)
    other = smallest(keyed.join(labels, "doc_id", "left_anti"), most_unlabelled).select("doc_id", *(F.lit(None).cast("int").alias(t) for t in TARGETS))
    rows = base.join(F.broadcast(given.unionByName(other)), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min_by(F.struct(*rows.columns), F.struct(F.xxhash64("text"), "source", "lang", "n_chars")).alias("x")).select("x.*")
    return one.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) == 0)


def _word_counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, rows, and for each target labelled rows and those with label 1 that have it), summed within each block."""
    for rb in it:
        y = [np.array([-1 if v is None else int(v > 0) for v in rb.column(t).to_pylist()]) for t in TARGETS]
        held = rb.column("held").to_numpy(zero_copy_only=False)
        for at, texts in blocks(rb.column("text")):
            doc, words, _ = _word_sets(texts)
            known, index = np.unique(words, return_inverse=True)
            counts = []
            for label in y:
                mine = np.where(held, -1, label)[at : at + len(texts)][doc]
                counts += [np.bincount(index, weights=mine >= 0, minlength=len(known)), np.bincount(index, weights=mine == 1, minlength=len(known))]
            yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), *(pa.array(c.astype(np.int64)) for c in counts)], names=["word", *(f"{t}_{k}" for t in TARGETS for k in ("n", "p"))])


def _vocabulary(counts: DataFrame, target: str, rate: float) -> np.ndarray:
    """Words of three labelled texts at least whose share in the classes differs by four standard errors or more;
    of more than VOCABULARY the first by that."""
    n, p = F.col(f"{target}_n"), F.col(f"{target}_p")
    apart = F.abs(p - n * F.lit(rate)) / F.sqrt(n * F.lit(max(rate * (1 - rate), 1e-6)))
    got = counts.withColumn("apart", apart).where((n >= 3) & (F.col("apart") >= 4)).orderBy(F.desc("apart"), "word").limit(VOCABULARY).select("word").collect()
    return np.sort(np.array([r.word for r in got], dtype=np.int64).view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = LABELLED, most_unlabelled: int = UNLABELLED) -> dict[str, Views | float]:
    """Models by target; where a target has one class only (or no labels), its share of ones instead."""
    with Scratch(docs.sparkSession):
        sample = cut(_sample(docs, labels, most_labelled, most_unlabelled), "sample")
        long = ", ".join(f"{t}_{k} long" for t in TARGETS for k in ("n", "p"))
        counts = sample.where("quality is not null or toxic is not null").mapInArrow(_word_counts, f"word long, {long}").groupBy("word").agg(*(F.sum(f"{t}_{k}").alias(f"{t}_{k}") for t in TARGETS for k in ("n", "p")))
        counts = cut(counts, "words")
        shares = sample.where("not held").agg(*(F.avg((F.col(t) > 0).cast("double")).alias(t) for t in TARGETS)).first()
        vocabulary = {t: _vocabulary(counts, t, shares[t] or 0.0) for t in TARGETS}
        # what is collected: for each sampled row some fifteen numbers and which of the vocabularies' words it has
        both = np.union1d(*vocabulary.values())
        features = sample.mapInArrow(_features(both), "doc_id long, quality int, toxic int, held boolean, source long, lang long, n_chars long, dense binary, words binary")
        got = sorted(features.collect(), key=lambda r: r.doc_id)
    out: dict[str, Views | float] = {}
    if got:
        dense = np.array([np.frombuffer(r.dense, dtype=np.float64) for r in got])
        held, source, lang, n_chars = (np.array([r[c] for r in got]) for c in ("held", "source", "lang", "n_chars"))
        pages = Pages.of(source, lang)
        meta = pages.features(source, lang, n_chars)
        row = np.repeat(np.arange(len(got)), [len(r.words) // 4 for r in got])
        words = both[np.frombuffer(b"".join(r.words for r in got), dtype=np.int32)] if len(both) else np.zeros(0, dtype=np.uint64)
    for t in TARGETS:
        y = np.array([-1 if r[t] is None else int(r[t] > 0) for r in got])
        known = y[y >= 0]
        enough = min((known == 0).sum(), (known == 1).sum()) >= 5 if len(known) else False
        if enough and len(np.unique(y[(y >= 0) & ~held])) == 2 and ((y >= 0) & held).any():
            out[t] = co_train(y, held, vocabulary[t], dense, *_known(vocabulary[t], row, words), meta, pages)
        else:
            out[t] = float(known.mean()) if len(known) else float(t == "quality")
    return out


def _features(vocabulary: np.ndarray):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for at, held in blocks(rb.column("text")):
                doc, words, n = _word_sets(held)
                row, col = _known(vocabulary, doc, words)
                parts = np.split(col.astype(np.int32), np.searchsorted(row, np.arange(1, len(held))))
                kept = [rb.column(c).slice(at, len(held)) for c in ("doc_id", *TARGETS, "held", "source", "lang", "n_chars")]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array([x.tobytes() for x in a], type=pa.binary()) for a in (_shape(held, doc, n), parts))], names=["doc_id", *TARGETS, "held", "source", "lang", "n_chars", "dense", "words"])

    return run


def _score(models: dict[str, Views | float]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            ids, pages = rb.column("doc_id"), [rb.column(c).to_numpy(zero_copy_only=False) for c in ("source", "lang", "n_chars")]
            for at, held in blocks(rb.column("text")):
                doc, words, n = _word_sets(held)
                dense = _shape(held, doc, n)
                cols: list[np.ndarray] = []
                for t in TARGETS:
                    m = models[t]
                    if isinstance(m, float):
                        cols += [np.full(len(held), m)] * 3
                    else:
                        cols += m.scores(dense, *_known(m.text.vocabulary, doc, words), m.pages.features(*(x[at : at + len(held)] for x in pages)))
                empty = np.array([not b.strip() for b in held])
                ok = (cols[0] >= 0.5) & (cols[3] < 0.5) & ~empty
                cols = [np.where(empty, 0.0, c) for c in cols]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(held)), *map(pa.array, cols), pa.array(ok)], names=["doc_id", *(f"{t}_{k}" for t in TARGETS for k in ("score", "text", "meta")), "accepted"])

    return run


def score(docs: DataFrame, models: dict[str, Views | float]) -> DataFrame:
    """docs(doc_id, text, source, lang, n_chars, ...) -> (doc_id, quality_score, quality_text, quality_meta,
    toxic_score, toxic_text, toxic_meta, accepted), a row for each row of docs.

    Null and blank text scores 0 everywhere and is not accepted. Null metadata is a value of its
    own. Without labels of both classes the score is the labels' share (1 for quality, 0 for
    toxicity where there are none). Other columns are ignored."""
    columns = ", ".join(f"{t}_{k} double" for t in TARGETS for k in ("score", "text", "meta"))
    return docs.select(*_row()).mapInArrow(_score(models), f"doc_id long, {columns}, accepted boolean")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go. It decides row by row."""
    inner, columns, rest = _score(fit(docs, table(spark, sf_dir, "labels"))), docs.columns, free_name(docs, "row")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            row = pa.RecordBatch.from_struct_array(rb.column(rest)).append_column("text", rb.column("text"))
            good = [x for out in inner(iter([row])) for x in out.column("accepted").to_pylist()]
            yield rb.select(columns).filter(pa.array(good, type=pa.bool_()))

    doc_id, _, *more = _row()
    return docs.select("*", F.struct(doc_id, *more).alias(rest)).mapInArrow(run, docs.schema)
