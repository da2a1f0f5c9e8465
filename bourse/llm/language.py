"""Language identification by prediction by partial matching: a byte context tree per language, with frozen statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of context at most.
ORDER = 3
#: Documents to learn from, per language: the fit reads about so many labelled rows, whole, chosen by a hash of doc_id.
SAMPLE_DOCS = 1500
#: Bytes that a worker counts at a time.
COUNT_BYTES = 1 << 20
#: A context of two bytes or more is kept if its language has seen it so often; else its suffix stands in.
MIN_SEEN = 24
#: Bytes of text that a worker scores at a time.
SCORE_BYTES = 1 << 20


def training_rows(docs: DataFrame, held_out) -> DataFrame:
    return docs.filter(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())


def context_counts(rows: DataFrame) -> DataFrame:
    """(lang, code, n): how often each run of ORDER + 1 bytes occurs; pre-aggregated in each task."""
    schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])

    def codes(text):
        for at in range(0, len(text), COUNT_BYTES):
            b = np.frombuffer(text[max(0, at - ORDER) : at].rjust(ORDER, b"\0") + text[at : at + COUNT_BYTES], np.uint8).astype(np.int64)
            code = b[ORDER:].copy()
            for k in range(1, ORDER + 1):
                code |= b[ORDER - k : len(b) - k] << (8 * k)
            yield code

    def merged(parts):
        code, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return code, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

    def fn(batch):
        waiting, counted, size = {}, {}, 0

        def count():
            for lang, own in waiting.items():
                counted.setdefault(lang, []).append(np.unique(np.concatenate(own), return_counts=True))
            waiting.clear()

        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for code in codes(text):
                waiting.setdefault(lang, []).append(code)
                size += len(code)
                if size > COUNT_BYTES:
                    count()
                    size = 0
        count()
        if not counted:
            return None
        out = {lang: merged(parts) for lang, parts in sorted(counted.items())}
        return [[lang for lang, (code, _) in out.items() for _ in code], np.concatenate([c for c, _ in out.values()]), np.concatenate([n for _, n in out.values()])]

    found = rows.select("lang", common.text_binary().alias("body")).mapInArrow(common.batches(fn, schema), "lang string, code long, n long")
    return found.groupBy("lang", "code").agg(F.sum("n").alias("n"))


class Tree:
    """The byte contexts of one language, up to ORDER long, and the bits of each byte behind each of them.

    A text stands behind ORDER zero bytes. Contexts of one byte are kept if they were seen, longer ones if they were seen
    ``least`` times, which their suffixes then were, too. Behind a context, a byte that it has seen is coded by its count (method C: all
    counts and one for each kind of byte), any other by the escape and by the suffix's distribution without the bytes seen
    here; behind the empty context the escape leads to 256 equal bytes. So every byte has a code, and the probabilities behind
    a context add up to one. Bytes that training doesn't have are alike, so one column stands for each of them.
    """

    def __init__(self, code: np.ndarray, n: np.ndarray, least: int):
        parts = [(code >> (8 * k)) & 255 for k in range(ORDER + 1)]  # the byte, then the one before it, and so on
        seen = np.unique(np.concatenate([[0], *parts]))
        self.symbol = np.full(256, len(seen), np.int32)
        self.symbol[seen] = np.arange(len(seen))
        self.size = a = len(seen) + 1
        sym = [self.symbol[p].astype(np.int64) for p in parts]
        lower = np.append(np.ones(len(seen)), 256 - len(seen)) / 256
        tables, parent, row = [], lower[None, :], np.zeros(len(code), np.int64)  # row: of each code's context, the longest kept so far, or -1
        child, n_rows = np.full((1, a), -1, np.int64), 0
        self.child = []
        for order in range(ORDER + 1):
            if order:  # contexts one byte longer
                alive = row >= 0
                key = row[alive] * a + sym[order][alive]
                total = np.bincount(key, n[alive], len(parent) * a)
                kept = np.flatnonzero(total >= (least if order > 1 else 1))
                child = np.full(len(parent) * a, -1, np.int64)
                child[kept] = np.arange(len(kept))
                self.child.append(np.where(child >= 0, child + n_rows, -1).reshape(-1, a))
                row[alive] = child[key]
                parent = parent[kept // a]
            alive = row >= 0
            count = np.zeros((len(parent), a))
            np.add.at(count, (row[alive], sym[0][alive]), n[alive])
            parent = self.behind(count, parent)
            tables.append(parent)
            n_rows += len(parent)
        each = np.append(np.ones(len(seen)), max(256 - len(seen), 1))
        self.bits = (-np.log2(np.concatenate(tables) / each)).astype(np.float32)
        self.jump()

    @staticmethod
    def behind(count: np.ndarray, lower: np.ndarray) -> np.ndarray:
        total, kinds, seen = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True), count > 0
        left = np.where(seen, 0, lower)
        share = left.sum(1, keepdims=True)
        own = np.where(share > 0, count / np.maximum(total + kinds, 1), count / np.maximum(total, 1))  # without a byte left nothing escapes
        return np.where(seen, own, np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0) * left / np.where(share > 0, share, 1))

    def jump(self) -> None:
        """Tables from the bytes before a place to the row of the longest kept context: of all bytes but the first, then with it."""
        a, base = self.size, [0]
        for table in self.child:
            base.append(base[-1] + len(table))
        rows = np.zeros(1, np.int64)
        for order, table in enumerate(self.child):
            longer = np.repeat(rows, a)
            at = (rows >= base[order]) & (rows < base[order] + len(table)) if order else np.ones(len(rows), bool)
            found = np.full((len(rows), a), -1, np.int64)
            found[at] = table[rows[at] - base[order]]
            longer = np.where(found.ravel() >= 0, found.ravel(), longer)
            if order == ORDER - 1:
                kept, self.place = np.unique(rows, return_inverse=True)  # rows of all shorter contexts, each once
                first = np.zeros(len(kept), np.int64)
                first[self.place] = np.arange(len(rows))
                self.last = longer.reshape(-1, a)[first].astype(np.int32)
                self.place = self.place.astype(np.int32)
                return
            rows = longer

    def lengths(self, text: np.ndarray) -> np.ndarray:
        """The bits of each byte but the first ORDER, which are context alone."""
        s = self.symbol[text]
        at = s[ORDER - 1 : -1].astype(np.int64)
        for k in range(2, ORDER):  # the byte just before a place counts most
            at *= self.size
            at += s[ORDER - k : len(s) - k]
        row = self.last[self.place[at], s[: len(s) - ORDER]]
        return self.bits[row, s[ORDER:]]


class Model:
    """A tree for each language; ``lengths``: the bits of each text under each of them."""

    def __init__(self, langs, code, lang_of, n, least: int | None = None):
        self.langs = list(langs)
        self.trees = [Tree(code[lang_of == i], n[lang_of == i], MIN_SEEN if least is None else least) for i in range(len(self.langs))]

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.langs)))
        waiting, size = [], 0
        for i, text in enumerate(texts):
            for at in range(0, len(text), SCORE_BYTES):
                part = text[max(0, at - ORDER) : at].rjust(ORDER, b"\0") + text[at : at + SCORE_BYTES]
                waiting.append((i, part))
                size += len(part)
                if size >= SCORE_BYTES:
                    self.add(waiting, out)
                    waiting, size = [], 0
        if waiting:
            self.add(waiting, out)
        return out

    def add(self, parts: list[tuple[int, bytes]], out: np.ndarray) -> None:
        text = np.frombuffer(b"".join([p for _, p in parts]), np.uint8)
        sizes = np.array([len(p) for _, p in parts])
        starts = np.cumsum(sizes) - sizes  # each part's bytes begin ORDER later, and so do the bits of its own
        own = np.ones(len(text), bool)
        for k in range(ORDER):
            own[starts + k] = False
        for lang, tree in enumerate(self.trees):
            bits = np.append(np.zeros(ORDER), tree.lengths(text)) * own
            np.add.at(out[:, lang], [i for i, _ in parts], np.add.reduceat(bits, starts))


def fit(docs: DataFrame, held_out) -> Model | None:
    """Learns from about SAMPLE_DOCS rows of each language, chosen by a hash; None if no row has a language."""
    rows = training_rows(docs, held_out)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[x for lang, n in sorted(sizes.items()) for x in (F.lit(lang), F.lit(min(1.0, SAMPLE_DOCS / n)))])
    picked = rows.filter((F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0) < F.element_at(share, F.col("lang")))
    got = context_counts(picked).toPandas()
    langs = sorted(sizes)
    lang_of = got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)
    return Model(langs, got["code"].to_numpy(np.int64), lang_of, got["n"].to_numpy(np.float64)) if len(got) else None


def identify(docs: DataFrame, held_out=None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score.

    ``held_out``: a condition on the rows that aren't learned from (default: crc32 of doc_id mod 3 is 1).
    Each language has a tree of byte contexts up to ORDER long, of its own texts alone; contexts of two bytes or more that it
    has seen less than MIN_SEEN times are left to their suffixes. Every byte is coded, also those that training doesn't have. A text's exact code length is summed under each tree, and the shortest wins; ties go to the language that sorts first. score is the winner's
    share when a byte's mean saving counts as 32 bits. Null texts and those without a letter are ``und``
    with score 0, and so are all if nothing could be learned. Learning reads about SAMPLE_DOCS labelled rows
    per language, a documented bound, so the tables sent to the workers are a few MB a language; scoring reads
    every whole text in place, without a shuffle. Languages without a text in the sample can't win.
    """
    if held_out is None:
        held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    held_out = F.coalesce(held_out, F.lit(False))
    model = fit(docs, held_out)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def fn(batch):
        m, texts, letters = shared.value, batch.column(2).to_pylist(), batch.column(3).to_pylist()
        pred, score = [], []
        bits = m.lengths(texts) if m else None
        for i, (text, letter) in enumerate(zip(texts, letters)):
            if not letter or m is None:
                pred.append("und")
                score.append(0.0)
                continue
            best = int(bits[i].argmin())
            more = np.minimum((bits[i] - bits[i, best]) * 32 / max(len(text), 1), 700)
            pred.append(m.langs[best])
            score.append(float(1 / np.exp2(-more).sum()))
        return [batch.column(0), batch.column(1), pred, score]

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    return docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), common.text_binary().alias("body"), letter).mapInArrow(common.batches(fn, schema), "doc_id long, held_out boolean, lang_pred string, score double")
