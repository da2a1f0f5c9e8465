"""A quality classifier by co-training a text-content view and a page-metadata view."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rounds in which the views exchange pseudo-labels.
ROUNDS = 3
#: A view labels a document for the other if its calibrated probability is at least this, or at most one less it.
CONFIDENT = 0.97
#: Weight of a pseudo-label next to a label.
PSEUDO_WEIGHT = 0.25
#: Share of labelled rows (by a hash of doc_id) that calibrate and are not learned from.
CALIBRATE_MOD = 4
#: Labelled documents that the views are fitted and calibrated on, at most: those whose ids have the least hashes.
LABELLED = 50_000
#: Buckets of hashed words, of word shapes, of pairs of neighbouring words by shape and equality, and of each hashed metadata value.
WORDS, SHAPES, PAIRS, VALUES = 1 << 14, 1 << 9, 1 << 12, 64
#: How many words a document's mean word counts as, at most: words aren't independent evidence, and few words are little of it.
WORTH = 10.0
#: Mass of a feature in either class before any is seen, in parts of the mean feature's.
ALPHA = 0.1
#: Scores lie within this; bins of the calibrating histogram; words that a worker remembers.
SPAN, SCORE_BINS, REMEMBERED = 60.0, 400, 400_000
#: Documents whose combined probability is below this are rejected.
KEEP_FROM = 0.5

METADATA = ("source", "lang", "source and lang", "reported length")
#: Sections of each view's columns: their sizes. A document has a share of each section, one in sum.
SECTIONS = ((WORDS, SHAPES, PAIRS), (VALUES,) * len(METADATA))
WIDTHS = tuple(map(sum, SECTIONS))
_RUN = re.compile(r"(.)\1+", re.DOTALL)


def shape(word: str) -> str:
    """The word with small letters as a, capitals as A and digits as 0, each run as one; other characters stay."""
    if word.isalpha():  # most words
        if word.islower():
            return "a"
        if word.isupper() and word.isascii():
            return "A"
        if word[0].isupper() and word[1:].islower():
            return "Aa"
    return _RUN.sub(r"\1", "".join(["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "a" if c.isalpha() else c for c in word]))


class _Columns(dict):
    """A word's columns: its own and its shape's, in one number."""

    def __missing__(self, word: str) -> int:
        value = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORDS + (WORDS + zlib.crc32(shape(word).encode("utf-8", "surrogatepass")) % SHAPES << 32)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


_columns = _Columns()


def content(text: str | None) -> bytes:
    """The columns of a whole text's words, shapes and pairs, two bytes each, then the share of each (of WORTH words in a shorter text), four bytes; a null text has none."""
    words = text.split() if text else []
    own = np.fromiter(map(_columns.__getitem__, words), np.int64, len(words))
    word, form = own & 0xFFFFFFFF, own >> 32
    pair = WORDS + SHAPES + (form[:-1] * 2654435761 + form[1:] * 40503 + (word[:-1] == word[1:]) * 97) % PAIRS
    at, n = np.unique(np.concatenate([word, form, pair]), return_counts=True)
    return at.astype("<u2").tobytes() + (n / max(len(words), WORTH)).astype("<f4").tobytes()


def metadata(source, lang, n_chars) -> bytes:
    """A column of each METADATA value, in the same form; null has one of its own. The text isn't looked at."""
    hashed = [VALUES - 1 if v is None else zlib.crc32(str(v).encode()) % (VALUES - 1) for v in (source, lang, None if source is None and lang is None else f"{source}/{lang}")]
    reported = VALUES - 1 if n_chars is None else min(VALUES - 2, max(int(n_chars), 0).bit_length())
    return (np.array([*hashed, reported], "<u2") + np.arange(len(METADATA), dtype="<u2") * VALUES).astype("<u2").tobytes() + np.ones(len(METADATA), "<f4").tobytes()


class Rows:
    """The features of some documents in one view: the document, column and share of each."""

    def __init__(self, packed: list[bytes]):
        sizes = np.array([len(p) // 6 for p in packed], np.int64)
        self.n, self.empty = len(packed), sizes == 0
        self.row = np.repeat(np.arange(len(packed)), sizes)
        self.column = np.frombuffer(b"".join([p[: len(p) // 3] for p in packed]), "<u2").astype(np.int64)
        self.share = np.frombuffer(b"".join([p[len(p) // 3 :] for p in packed]), "<f4").astype(np.float64)

    def sums(self, weight: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.column, self.share * weight[self.row], width)


def _reported(docs: DataFrame):
    return (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("long")


def known_labels(labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and their labels, of LABELLED documents at most; several labels of one count on average."""
    rows = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    found = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED).toPandas().sort_values("doc_id")
    return found["doc_id"].to_numpy(np.int64), found["y"].to_numpy(np.int64)


def views(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id; the features of either view; y (0, 1 or null); calibrates. Each row is made where the document is read."""
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.binary()), ("metadata", pa.binary()), ("y", pa.int32())])
    known = docs.sparkSession.sparkContext.broadcast(known_labels(labels))

    def fn(batch):
        doc_id, text, *page = (c.to_pylist() for c in batch.columns)
        ids, y = known.value
        own = np.array([0 if i is None else i for i in doc_id], np.int64)
        at = np.searchsorted(ids, own).clip(0, max(len(ids) - 1, 0))
        has = (ids[at] == own) & np.array([i is not None for i in doc_id], bool) if len(ids) else np.zeros(len(own), bool)
        return [batch.column(0), [content(t) for t in text], [metadata(*x) for x in zip(*page)], pa.array(y[at] if len(ids) else own, pa.int32(), mask=~has)]

    found = docs.select(F.col("doc_id").cast("long"), "text", F.col("source").cast("string"), F.col("lang").cast("string"), _reported(docs).alias("n_chars"))
    found = found.mapInArrow(common.batches(fn, schema), "doc_id long, content binary, metadata binary, y int")
    return found.withColumn("calibrates", F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATE_MOD)) == 0)


class View:
    """A naive Bayes table over a view's columns, and a calibration of its score."""

    def __init__(self, view: int):
        self.worth = WORTH if view == 0 else 1.0
        self.weights, self.scale, self.shift, self.prior = np.zeros(WIDTHS[view]), 0.0, 0.0, 0.0
        self.sections = SECTIONS[view]

    def learn(self, on: np.ndarray, totals: np.ndarray) -> None:
        """on: shares of bad and good rows by column; totals: the weight of all of them. A feature that neither has weighs nothing."""
        mean = on / np.maximum(totals, 1e-9)[:, None] + np.repeat([ALPHA / size for size in self.sections], self.sections)
        self.weights = np.log(mean[1] / mean[0]) if totals.all() else np.zeros(len(self.weights))

    def odds(self, rows: Rows) -> np.ndarray:
        return np.clip(np.bincount(rows.row, rows.share * self.weights[rows.column], rows.n) * self.worth, -SPAN, SPAN)

    def calibrate(self, x: np.ndarray, n: np.ndarray) -> None:
        """Logistic calibration on the histogram (bad and good rows by score); flat if it has one class only."""
        total = n.sum(0)
        self.prior = float(np.log((n[1].sum() + 1) / (n[0].sum() + 1)))
        self.scale, self.shift = 0.0, self.prior
        if not n.sum(1).all():
            return
        w = np.zeros(2)
        design = np.stack([x / 10, np.ones_like(x)], 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            grad = design.T @ (n[1] - total * p) - 1e-3 * w
            hess = design.T @ (design * (total * p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
            w += np.clip(np.linalg.solve(hess, grad), -5, 5)
        self.scale, self.shift = max(float(w[0]) / 10, 0.0), float(w[1])

    def logit(self, rows: Rows) -> np.ndarray:
        """That of the calibrated score; the fewer words under WORTH a document has, the nearer to the prior's, which it has without any."""
        known = np.minimum(np.bincount(rows.row, rows.share * (rows.column < self.sections[0]), rows.n), 1.0)
        return self.scale * self.odds(rows) + known * self.shift + (1 - known) * self.prior


def _sides(batch: pa.RecordBatch, at: int = 0) -> list[Rows]:
    return [Rows(batch.column(at + v).to_pylist()) for v in (0, 1)]


_SUMS = pa.schema([("kind", pa.string()), ("at", pa.int32()), ("n", pa.float64())])


def _sums(rows: DataFrame, fn) -> dict[str, dict[int, float]]:
    """Sums that each task makes, over all rows; as many as the tables have cells."""
    out: dict[str, dict[int, float]] = {}

    def of(stream):
        total: dict[str, np.ndarray] = {}
        for batch in stream:
            for part in common.slices(batch):
                for kind, values in fn(part).items():
                    total[kind] = total.get(kind, 0) + values
        for kind, values in total.items():
            at = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at)), pa.array(at, pa.int32()), pa.array(values[at])], schema=_SUMS)

    for kind, at, n in rows.mapInArrow(of, "kind string, at int, n double").groupBy("kind", "at").agg(F.sum("n")).collect():
        out.setdefault(kind, {})[at] = n
    return out


def _dense(found: dict[int, float], width: int) -> np.ndarray:
    out = np.zeros(width)
    for i, n in found.items():
        out[i] = n
    return out


def train(rows: DataFrame) -> list[View]:
    """Both views after ROUNDS rounds; each round reads every row once to learn and the calibrating labels once."""
    models = [View(v) for v in (0, 1)]
    for turn in range(ROUNDS + 1):
        old = models if turn else None

        def learn(batch, old=old):
            y = np.array([-1 if v is None else v for v in batch.column(2).to_pylist()])
            held, sides, out = np.array(batch.column(3).to_pylist(), bool), _sides(batch), {}
            sure = [np.full(len(y), -1)] * 2
            if old:
                edge = np.log(CONFIDENT / (1 - CONFIDENT))
                sure = [np.where(z >= edge, 1, np.where(z <= -edge, 0, -1)) for z in (m.logit(s) for m, s in zip(old, sides))]
            for v in (0, 1):
                label = np.where(y >= 0, np.where(held, -1, y), sure[1 - v])
                label = np.where(sides[v].empty, -1, label)
                weight = np.where(y >= 0, 1.0, PSEUDO_WEIGHT)
                for c in (0, 1):
                    own = weight * (label == c)
                    out[f"{v}{c}"], out[f"n{v}{c}"] = sides[v].sums(own, WIDTHS[v]), np.array([own.sum()])
            return out

        source = rows if turn else rows.filter("y IS NOT NULL")
        got = _sums(source.select("content", "metadata", "y", "calibrates"), learn)
        models = [View(v) for v in (0, 1)]
        for v, m in enumerate(models):
            m.learn(np.array([_dense(got.get(f"{v}{c}", {}), WIDTHS[v]) for c in (0, 1)]), np.array([got.get(f"n{v}{c}", {}).get(0, 0.0) for c in (0, 1)]))

        def spread(batch, models=models):
            y, out = np.array(batch.column(2).to_pylist()), {}
            for v, (m, side) in enumerate(zip(models, _sides(batch))):
                at = np.clip(((m.odds(side) + SPAN) / (2 * SPAN) * SCORE_BINS).astype(int), 0, SCORE_BINS - 1)
                for c in (0, 1):
                    out[f"{v}{c}"] = np.bincount(at[(y == c) & ~side.empty], minlength=SCORE_BINS).astype(float)
            return out

        got = _sums(rows.filter("y IS NOT NULL AND calibrates").select("content", "metadata", "y"), spread)
        centres = ((np.arange(SCORE_BINS) + 0.5) / SCORE_BINS * 2 - 1) * SPAN
        for v, m in enumerate(models):
            m.calibrate(centres, np.array([_dense(got.get(f"{v}{c}", {}), SCORE_BINS) for c in (0, 1)]))
    return models


def fit(rows: DataFrame) -> tuple[list[View], float]:
    """The trained views and the log odds of a good label among the calibrating ones."""
    models = train(rows)
    prior = rows.filter("y IS NOT NULL AND calibrates").agg(F.sum("y"), F.count("y")).first()
    return models, float(np.log(((prior[0] or 0) + 1) / (prior[1] - (prior[0] or 0) + 1)))


def combined(models: list[View], prior: float, sides: list[Rows]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The probability of good quality by each view, and by both: their log odds added, the prior counted once."""
    a, b = (m.logit(s) for m, s in zip(models, sides))
    return tuple(1 / (1 + np.exp(-np.clip(z, -500, 500))) for z in (a, b, a + b - prior))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, p_text, p_metadata, score, kept.

    The text view sees the hashed words of the whole text, their shapes and pairs of neighbours; the metadata view sees the page's source,
    language and reported length (a column of ``docs`` if there; never the text). Each view is a naive Bayes table over a fixed
    number of cells, so a round's state is sums of fixed size, pre-aggregated in every task. The fit knows the labels of LABELLED documents at most, a
    documented bound; the pseudo-labels of each round are those of all other documents that a view is confident of. In each round a view learns from the labels and from the other view's confident
    pseudo-labels; a quarter of the labelled rows only calibrates. The score is the probability of good
    quality: the calibrated views' log odds added, the prior counted once; documents below KEEP_FROM go.

    A text without words, or null, has the prior's probability in the text view; null metadata values have a bucket of their own. Labels of null and
    several labels of one document that agree on average are allowed. Without labels of both classes every score is the
    prior, one half or more if no bad label is known, so everything stays. Rows that repeat a doc_id
    are scored row by row.
    """
    rows = common.materialise(views(docs, labels), "views")
    models, prior = fit(rows)
    schema = pa.schema([("doc_id", pa.int64()), ("p_text", pa.float64()), ("p_metadata", pa.float64()), ("score", pa.float64()), ("kept", pa.bool_())])

    def fn(batch):
        p, q, s = combined(models, prior, _sides(batch, 1))
        return [batch.column(0), p, q, s, s >= KEEP_FROM]

    return rows.select("doc_id", "content", "metadata").mapInArrow(common.batches(fn, schema), "doc_id long, p_text double, p_metadata double, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``classify`` rejects; a row is scored by itself, whatever its doc_id.

    The fitted views score each row where it is read, so no text is shuffled to be dropped.
    """
    rows = common.materialise(views(docs, labels), "views")
    models, prior = fit(rows)
    common.discard(rows)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series, sources: pd.Series, langs: pd.Series, lengths: pd.Series) -> pd.Series:
        text, *page = (x.astype(object).where(x.notna(), None) for x in (texts, sources, langs, lengths))
        return pd.Series(combined(models, prior, [Rows([content(t) for t in text]), Rows([metadata(*x) for x in zip(*page)])])[2] >= KEEP_FROM)

    return docs.filter(good(F.col("text"), F.col("source").cast("string"), F.col("lang").cast("string"), _reported(docs)))
