"""Language-model scores: add-one word frequencies, and a probabilistic suffix tree over words."""

from __future__ import annotations

import itertools
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of context at most.
DEPTH = 2
#: A context is a candidate if it was seen so often in training, at every size of the corpus: one occurrence has no distribution.
LEAST_SEEN = 2
#: A candidate is kept if its own distribution codes what follows it in so many bits less per distinct next word than its suffix's.
LEAST_SAVING = 1.0
#: The test reads the suffix's code lengths in such parts of a bit.
BIT_PARTS = 256
#: What follows a context is spread over several tasks from so many occurrences, and from so large a share of all tokens: at
#: most SHARES contexts of a length are, whatever the corpus. They are tested like all others, from sums over their parts.
SPREAD_FROM, SHARES = 1 << 20, 1 << 16
#: Symbols: a word that training doesn't have, a text's start and its end; training words come after.
RARE, START, END = 0, 1, 2
#: Bytes of text in a block of documents whose words are looked up together.
BLOCK_BYTES = 4 << 20
#: Blocks whose questions meet in one task; with more blocks, questions are merged and answers dealt out in steps.
MEETING = 16_384
#: Kinds of message: a block's documents, its words; at level d: FIRST + d. SPREAD: next words of a context that is spread.
DOCS, WORDS, FIRST, SPREAD = 0, 1, 1, -1
MESSAGE = "block long, kind int, bucket long, body binary, n long, v long"
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]


def _default_fold() -> "F.Column":
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def pack(*values) -> bytes:
    """Arrays of whole numbers, byte by byte of their width so that equal high bytes lie together, and byte strings; compressed."""
    head, parts = [], []
    for x in values:
        if isinstance(x, bytes):
            head += [len(x), -1]
            parts.append(x)
        else:
            x = np.ascontiguousarray(x, np.int64).view(np.uint64)
            width = (int(x.max(initial=0)).bit_length() + 7) // 8
            head += [len(x), width]
            parts.append(x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    raw = np.array([len(values), *head], "<i8").tobytes() + b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(body: bytes) -> list:
    raw = pa.decompress(body[8:], int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)
    head = np.frombuffer(raw, "<i8", 1 + 2 * int(np.frombuffer(raw, "<i8", 1)[0]))[1:].reshape(-1, 2).tolist()
    out, at = [], 8 + 16 * len(head)
    for n, width in head:
        size = n * abs(width)
        if width < 0:
            out.append(raw[at : at + size])
        else:
            planes = np.zeros((n, 8), np.uint8)
            planes[:, :width] = np.frombuffer(raw, np.uint8, size, at).reshape(width, n).T
            out.append(planes.view("<i8").reshape(-1))
        at += size
    return out


def _messages(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(_TYPES)
    return pa.table([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=["block", "kind", "bucket", "body", "n", "v"])


def _rows_of(table: pa.Table) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in table.columns)))


def _runs(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of each run of equal ones."""
    starts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    return [(int(bucket[i]), i, j) for i, j in zip(starts, [*starts[1:], len(bucket)])]


def _spread_of(number: np.ndarray, word: np.ndarray, n: np.ndarray, facts: dict) -> np.ndarray:
    """The bucket of each entry: its context's, or one of as many as a very frequent context has millions of occurrences."""
    mixed = ((number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (word.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x165667B19E3779F9)
    parts = (n // facts["part"] + 1).astype(np.uint64)
    other = (mixed >> np.uint64(33)) % parts * np.uint64(0x9E3779B1) % np.uint64(facts["buckets"])
    return np.where(n >= facts["spread"], number + other.astype(np.int64), number) % facts["buckets"]


def in_buckets(words, n_buckets: int) -> tuple[list[bytes], np.ndarray]:
    """The words by bucket, then by bytes, and their buckets."""
    words = sorted(words)
    bucket = np.fromiter((crc32(w) for w in words), np.int64, len(words)) % n_buckets
    order = np.argsort(bucket, kind="stable")
    return [words[i] for i in order.tolist()], bucket[order]


def blocked(docs: DataFrame, held_out, n_buckets: int) -> DataFrame:
    """Documents in blocks of about BLOCK_BYTES, as they lie in the input: a row of the documents, and rows of the block's words by bucket."""

    def block(number: int, rows: list[tuple]) -> pa.RecordBatch:
        parts = [_words(body) for _, _, body in rows]
        words, bucket = in_buckets(set().union(*parts), n_buckets)
        place = dict(zip(words, itertools.count()))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.fromiter(map(place.__getitem__, itertools.chain.from_iterable(parts)), np.int64, int(sizes.sum()))
        ids, held = [r[0] for r in rows], np.array([r[1] for r in rows], bool)
        counts = np.bincount(at[np.repeat(~held, sizes)], minlength=len(words))
        own = pack(np.array([i is not None for i in ids]), np.array([i or 0 for i in ids], np.int64), held, sizes, at)
        out = [(number, DOCS, 0, own, int((~held).sum()), 0)]
        out += [(number, WORDS, b, pack(b" ".join(words[i:j]), counts[i:j]), 0, 0) for b, i, j in _runs(bucket)]
        return _messages(out).to_batches()[0]

    def run(stream):
        waiting, size, made, part = [], 0, 0, 0
        for batch in stream:
            for piece in common.slices(batch):
                for part, *row in zip(*(c.to_pylist() for c in piece.columns)):
                    waiting.append(row)
                    size += len(row[2])
                    if size >= BLOCK_BYTES:
                        yield block((part << 31) + made, waiting)
                        waiting, size, made = [], 0, made + 1
        if waiting:
            yield block((part << 31) + made, waiting)

    held_out = F.coalesce(_default_fold() if held_out is None else held_out, F.lit(False))
    rows = docs.select(F.spark_partition_id().cast("long").alias("part"), F.col("doc_id").cast("long"), held_out.alias("held_out"), common.text_binary().alias("body"))
    return rows.mapInArrow(run, MESSAGE)


class Words:
    """Questions of words, by bucket: the count of each in all training texts, and a number for those that have any."""

    @staticmethod
    def merged(bodies: list[bytes], facts: dict) -> bytes:
        total: dict[bytes, int] = {}
        for body in bodies:
            words, counts = unpack(body)
            for word, n in zip(words.split(b" "), counts.tolist()):
                total[word] = total.get(word, 0) + n
        words = sorted(total)
        return pack(b" ".join(words), np.array([total[w] for w in words], np.int64))

    @staticmethod
    def answers(bodies: list[bytes], bucket: int, facts: dict) -> tuple[list[bytes], list[tuple]]:
        """Numbers go from the most frequent word of the bucket down, so that common words have small ones."""
        words, total = unpack(Words.merged(bodies, facts))
        place = np.empty(len(total), np.int64)
        place[np.argsort(-total, kind="stable")] = np.arange(1, len(total) + 1)
        number = np.where(total > 0, place * facts["buckets"] + bucket, RARE)
        told = dict(zip(words.split(b" "), zip(total.tolist(), number.tolist())))
        out = [pack(*np.array([told[w] for w in unpack(body)[0].split(b" ")], np.int64).reshape(-1, 2).T) for body in bodies]
        return out, [(SPREAD, bucket, None, int(total.sum()), int((total > 0).sum()))]

    @staticmethod
    def dealt(bodies: list[bytes], merged: bytes, told: bytes) -> list[bytes]:
        known = dict(zip(unpack(merged)[0].split(b" "), zip(*(x.tolist() for x in unpack(told)))))
        return [pack(*np.array([known[w] for w in unpack(body)[0].split(b" ")], np.int64).reshape(-1, 2).T) for body in bodies]


def savings(total: np.ndarray, lengths: np.ndarray, n, kinds) -> np.ndarray:
    """Bits that a context saves on each next symbol's ``total`` occurrences, against its suffix's code lengths: the context has
    ``n`` occurrences and ``kinds`` next symbols."""
    lower = np.exp2(-lengths / BIT_PARTS)
    own = (total + kinds * lower) / np.maximum(n + kinds, 1)
    return total * (np.log2(np.where(total > 0, own, 1)) + lengths / BIT_PARTS)


def spread_kinds(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The contexts that are spread, SHARES at most, and their numbers of distinct next symbols (0: not kept).

    Their parts' occurrences and numbers are summed first; with these sums each part tells what it saves, and the savings are
    summed and tested like any context's.
    """

    def sized(batch):
        return [batch.column(0), batch.column(1), [int(unpack(b)[0].sum()) for b in batch.column(2).to_pylist()]]

    parts = rows.select("n", "v", "body")
    sizes = parts.mapInArrow(common.batches(sized, pa.schema([("n", pa.int64()), ("v", pa.int64()), ("total", pa.int64())])), "n long, v long, total long")
    known = np.array(sizes.groupBy("n").agg(F.sum("v"), F.sum("total")).orderBy("n").collect(), np.int64).reshape(-1, 3)
    if not len(known):
        return known[:, 0], known[:, 1]

    def saved(batch):
        places = np.searchsorted(known[:, 0], batch.column(0).to_numpy())
        bits = [float(savings(*unpack(b), known[i, 2], known[i, 1]).sum()) for i, b in zip(places, batch.column(2).to_pylist())]
        return [batch.column(0), bits]

    bits = parts.mapInArrow(common.batches(saved, pa.schema([("n", pa.int64()), ("saved", pa.float64())])), "n long, saved double").groupBy("n").agg(F.sum("saved")).orderBy("n").collect()
    return known[:, 0], np.where(np.array([b[1] for b in bits]) >= LEAST_SAVING * known[:, 1], known[:, 1], 0)


class Entries:
    """Questions of entries, a context and a next symbol, by bucket: what training has of them, and if the context is kept.

    A body holds the contexts' codes (twice the number, and one more if it is spread), as steps; how many entries each has;
    the entries' symbols, their counts in the block's training texts, and their code lengths under the suffix.
    """

    @staticmethod
    def read(bodies: list[bytes]):
        parts = [unpack(b) for b in bodies]
        codes = np.concatenate([np.cumsum(p[0]) for p in parts])
        symbol, count, length = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4))
        context, of = np.unique(codes, return_inverse=True)
        width = int(symbol.max(initial=0)) + 1
        key, at = np.unique(np.repeat(of, np.concatenate([p[1] for p in parts])) * width + symbol, return_inverse=True)
        lengths = np.zeros(len(key), np.int64)
        np.maximum.at(lengths, at, length)
        return context, of, key // width, key % width, at, np.bincount(at, count, len(key)).astype(np.int64), lengths, ([len(p[0]) for p in parts], [len(p[2]) for p in parts])

    @staticmethod
    def merged(bodies: list[bytes], facts: dict) -> bytes:
        context, _, owner, symbol, _, total, lengths, _ = Entries.read(bodies)
        return pack(np.diff(context, prepend=0), np.bincount(owner, minlength=len(context)), symbol, total, lengths)

    @staticmethod
    def answers(bodies: list[bytes], bucket: int, facts: dict) -> tuple[list[bytes], list[tuple]]:
        """Each entry's count, and its number as a context to be (0: seen too rarely); each context's number of distinct next symbols (0: not kept).

        Of a context that is spread, the bucket's number and its entries' counts and code lengths go on to ``spread_kinds``.
        """
        context, of, owner, _, at, total, lengths, (n_contexts, n_entries) = Entries.read(bodies)
        seen = total > 0
        n, kinds = np.bincount(owner, total, len(context)), np.bincount(owner, seen, len(context))
        saved = np.bincount(owner, np.where(seen, savings(total, lengths, n[owner], kinds[owner]), 0), len(context))
        spread = context & 1 > 0
        kept = np.where(~spread & (saved >= LEAST_SAVING * kinds), kinds, 0).astype(np.int64)
        frequent = total >= LEAST_SEEN
        number = np.where(frequent, np.cumsum(frequent) * facts["buckets"] + bucket, 0)
        ends = np.cumsum(n_entries)[:-1]
        out = [pack(a, b, c) for a, b, c in zip(np.split(total[at], ends), np.split(number[at], ends), np.split(kept[of], np.cumsum(n_contexts)[:-1]))]
        return out, [(SPREAD, bucket, pack(total[(owner == i) & seen], lengths[(owner == i) & seen]), int(context[i] >> 1), int(kinds[i])) for i in np.flatnonzero(spread)]

    @staticmethod
    def dealt(bodies: list[bytes], merged: bytes, told: bytes) -> list[bytes]:
        steps, sizes, symbol, _, _ = unpack(merged)
        context, (count, number, kept) = np.cumsum(steps), unpack(told)
        width = int(symbol.max(initial=0)) + 1
        key, out = np.repeat(np.arange(len(context)), sizes) * width + symbol, []
        for body in bodies:
            steps, sizes, symbol, _, _ = unpack(body)
            of = np.searchsorted(context, np.cumsum(steps))
            at = np.searchsorted(key, np.repeat(of, sizes) * width + symbol)
            out.append(pack(count[at], number[at], kept[of]))
        return out


def answered(questions: DataFrame, kind, n_blocks: int, facts: dict) -> DataFrame:
    """The answers to each block's questions, by bucket; rows of kind SPREAD bear sums of the bucket.

    A bucket gets a row from each block at most. Beyond MEETING blocks, the questions of as many are merged, the merged ones
    are answered in the same way, and the answers dealt out: so a word that every block has costs no task a row from each.
    """

    def answer(table: pa.Table) -> pa.Table:
        rows = _rows_of(table)
        bodies, more = kind.answers([r[3] for r in rows], rows[0][2], facts)
        return _messages([(r[0], r[1], r[2], b, 0, 0) for r, b in zip(rows, bodies)] + [(-1, *m) for m in more])

    if n_blocks <= MEETING:
        return questions.groupBy("bucket").applyInArrow(answer, MESSAGE)
    meetings = -(-n_blocks // MEETING)
    meeting = F.pmod(F.xxhash64("block"), F.lit(meetings)).alias("meeting")

    def merge(table: pa.Table) -> pa.Table:
        rows, at = _rows_of(table.drop_columns(["meeting"])), table.column("meeting")[0].as_py()
        return _messages([(at, rows[0][1], rows[0][2], kind.merged([r[3] for r in rows], facts), 0, 0)])

    def deal(own: pa.Table, told: pa.Table) -> pa.Table:
        rows = _rows_of(own.drop_columns(["meeting"]))
        if not rows:
            return _messages([])
        body = kind.dealt([r[3] for r in rows], *(told.column(c)[0].as_py() for c in ("merged", "body")))
        return _messages([(*r[:3], b, 0, 0) for r, b in zip(rows, body)])

    own = questions.select("*", meeting)
    merged = common.materialise(own.groupBy("bucket", "meeting").applyInArrow(merge, MESSAGE), "merged")
    told = common.materialise(answered(merged, kind, meetings, facts), "told")
    both = merged.select(F.col("block").alias("meeting"), "bucket", F.col("body").alias("merged")).join(told.select(F.col("block").alias("meeting"), "bucket", "body").hint("merge"), ["meeting", "bucket"])
    dealt = own.groupBy("bucket", "meeting").cogroup(both.groupBy("bucket", "meeting")).applyInArrow(deal, MESSAGE)
    return dealt.unionByName(told.filter(F.col("kind") == SPREAD))


def coded(messages: DataFrame, facts: dict) -> DataFrame:
    """One row per block: its documents as symbols, each between a start and an end; the symbols' numbers and training counts."""

    def fn(table: pa.Table) -> pa.Table:
        rows = sorted(_rows_of(table), key=lambda r: r[1:3])
        has_id, ids, held, sizes, at = unpack(rows[0][3])
        parts = [unpack(r[3]) for r in rows[1:]]
        count, number = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]) for i in (0, 1))
        numbers, place = np.unique(np.concatenate([[RARE, START, END], number]), return_inverse=True)
        counts = np.zeros(len(numbers), np.int64)
        counts[place[3:]] = count
        counts[:3] = 0, facts["ends"], facts["ends"]
        starts = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]])
        symbols = np.full(len(at) + 2 * len(sizes), END)
        symbols[starts] = START
        inner = np.ones(len(symbols), bool)
        inner[starts] = inner[starts + sizes + 1] = False
        symbols[inner] = place[3:][at]
        return _messages([(rows[0][0], DOCS, 0, pack(has_id, ids, held, starts, symbols, numbers, counts), 0, 0)])

    return messages.groupBy("block").applyInArrow(fn, MESSAGE)


class Block:
    """The documents of a block as symbols, and the suffix tree over words as far as the answers so far tell it."""

    def __init__(self, rows: list[tuple], facts: dict):
        rows = sorted(rows, key=lambda r: r[1:3])
        self.block, self.facts = rows[0][0], facts
        self.has_id, self.ids, held, self.starts, self.symbols, self.numbers, self.counts = unpack(rows[0][3])
        self.held = held.astype(bool)
        self.learned = ~np.repeat(self.held, np.diff(np.append(self.starts, len(self.symbols)))) & (self.symbols != START)
        self.answers: dict[int, list] = {}
        for row in rows[1:]:
            self.answers.setdefault(row[1], []).append(unpack(row[3]))
        n = self.counts[self.symbols]
        self.known = (n > 0) & (self.symbols != START)
        self.base = (n + 1) / (facts["n"] + facts["v"] + 1)
        self.base[self.starts] = 1.0  # a start isn't a token
        # of the symbol at each place, as a context: its place in the lists of all contexts, and their numbers and counts
        self.own, self.number, self.count = np.where(self.symbols == END, RARE, self.symbols), np.where(np.arange(len(self.numbers)) == END, 0, self.numbers), self.counts
        self.p, self.depth = self.base.copy(), 0

    def deeper(self) -> None:
        """Takes the contexts of the next length: the distinct entries, by bucket and context."""
        self.depth += 1
        before = np.append(-1, self.own[:-1])
        usable = (before >= 0) & (self.symbols != START)
        usable[usable] = ((self.number > 0) & (self.count >= LEAST_SEEN))[before[usable]]
        self.at = np.flatnonzero(usable)
        entry, self.entry_at = np.unique(before[self.at] * len(self.numbers) + self.symbols[self.at], return_inverse=True)
        context, symbol = entry // len(self.numbers), self.numbers[entry % len(self.numbers)]
        n, number = self.count[context], self.number[context]
        bucket = _spread_of(number, symbol, n, self.facts)
        self.order = self.sorted_by(bucket, context, number, entry % len(self.numbers))
        self.n, code = n, 2 * number + (n >= self.facts["spread"])
        self.symbol, self.bucket, self.code = symbol[self.order], bucket[self.order], code[self.order]
        self.first = (np.diff(self.bucket, prepend=-1) != 0) | (np.diff(self.code, prepend=-1) != 0)

    @staticmethod
    def sorted_by(bucket: np.ndarray, context: np.ndarray, number: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The order of entries, which come by context, by bucket, the context's number and the symbol, whose numbers ascend with
        its place: a sort of one number each, where bucket, context and place have 21 bits."""
        first = np.flatnonzero(np.diff(context, prepend=-1))
        if max(len(first), int(bucket.max(initial=0)), int(place.max(initial=0))) >= 1 << 21:
            return np.lexsort((place, number, bucket))
        rank = np.empty(len(first), np.int64)
        rank[np.argsort(number[first])] = np.arange(len(first))
        return np.argsort(bucket << 42 | np.repeat(rank, np.diff(np.append(first, len(context)))) << 21 | place)

    def asks(self) -> list[tuple]:
        """Questions of the entries of this depth, by bucket."""
        count = np.bincount(self.entry_at, self.learned[self.at], len(self.n)).astype(np.int64)[self.order]
        length = np.zeros(len(self.n), np.int64)
        length[self.entry_at] = np.round(-np.log2(self.p[self.at]) * BIT_PARTS)
        length, out = length[self.order], []
        for bucket, i, j in _runs(self.bucket):
            heads = np.append(np.flatnonzero(self.first[i:j]), j - i)
            out.append((self.block, FIRST + self.depth, bucket, pack(np.diff(self.code[i + heads[:-1]], prepend=0), np.diff(heads), self.symbol[i:j], count[i:j], length[i:j]), 0, 0))
        return out

    def learn(self) -> None:
        """The symbols' probabilities from the answers of this depth: of the longest kept context, smoothed with its suffixes'."""
        parts = self.answers.get(FIRST + self.depth, [])
        count, number, kinds = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]) for i in range(3))
        kinds = kinds[np.cumsum(self.first) - 1]
        spread = np.flatnonzero(self.code & 1)
        if len(spread):
            contexts, their = self.facts["kinds"][self.depth]
            kinds[spread] = their[np.searchsorted(contexts, self.code[spread] >> 1)]
        told = np.empty((3, len(self.order)), np.int64)
        told[:, self.order] = count, number, kinds
        count, number, kinds = told
        here, n = self.entry_at, self.n
        p = (count[here] + kinds[here] * self.p[self.at]) / np.maximum(n + kinds, 1)[here]
        self.p[self.at] = np.where(kinds[here] > 0, p, self.p[self.at])
        self.own = np.full(len(self.symbols), -1)
        self.own[self.at] = np.where(self.symbols[self.at] == END, -1, here)
        self.number, self.count = number, count


def score(docs: DataFrame, held_out=None) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out``: a condition on rows that aren't learned from (default: crc32 of doc_id mod 7 is 2).
    The base model counts every word of every training text. ``score`` is the log10 probability of the same tokens
    under a suffix tree over words: contexts of up to DEPTH words, those seen LEAST_SEEN times at least, kept by a
    divergence test against their suffix. A token's probability is that of the longest kept context before it, smoothed
    by the number of distinct next words with those of its suffixes, down to the base model's; so words that were
    never seen have the base model's share.

    Words, contexts and what follows them grow with the corpus and stay distributed. Documents are taken in blocks of about
    BLOCK_BYTES as they lie in the input; a block asks once for each distinct word, then, level by level, once for each
    distinct entry of a context and a next word, so a very common one costs one entry a block. A context's entries meet in
    one bucket; those of a context that is a share of 1 / SHARES of all tokens are spread over many, and its test adds up what
    they tell in two passes: the driver sees two sums of each of these, SHARES a level at most.

    A null or empty text is its end alone. Without training rows, base_score is 0 and score 0. Repeated
    rows are scored row by row; columns other than doc_id and text are ignored; no rows give no rows.
    """
    since = common.mark()
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_buckets = 1 << max(3, (max(size, 1) // BLOCK_BYTES).bit_length())
    made = common.materialise(blocked(docs, held_out, n_buckets), "blocks")
    own = made.filter(F.col("kind") == DOCS)
    known = own.agg(F.sum("n").alias("train"), F.count(F.lit(1)).alias("blocks")).first()
    ends, n_blocks, facts = known["train"] or 0, known["blocks"], {"buckets": n_buckets, "kinds": {}}
    answers = common.materialise(answered(made.filter(F.col("kind") == WORDS), Words, n_blocks, facts), "words")
    words = answers.filter(F.col("kind") == SPREAD).agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = (words["n"] or 0) + ends, (words["v"] or 0) + (ends > 0)
    facts |= {"n": n, "v": v, "ends": ends, "spread": max(SPREAD_FROM, n // SHARES), "part": SPREAD_FROM}
    tables = [common.materialise(coded(own.unionByName(answers.filter(F.col("kind") == WORDS)), facts), "coded")]
    for spent in (made, answers):
        common.discard(spent)

    def at_depth(rows: list[tuple], depth: int, facts: dict) -> Block:
        block = Block(rows, facts)
        for d in range(1, depth + 1):
            block.deeper()
            if d < depth or FIRST + d in block.answers:
                block.learn()
        return block

    def asked(depth: int, facts: dict) -> DataFrame:
        if depth == 1:  # nothing is known but the coded blocks, a row each

            def first(stream):
                for batch in stream:
                    for row in _rows_of(batch):
                        yield from _messages(at_depth([row], 1, facts).asks()).to_batches()

            return tables[0].mapInArrow(first, MESSAGE)
        return _union(tables).groupBy("block").applyInArrow(lambda table: _messages(at_depth(_rows_of(table), depth, facts).asks()), MESSAGE)

    for depth in range(1, DEPTH + 1):
        told = common.materialise(answered(asked(depth, facts), Entries, n_blocks, facts), "answers")
        facts = facts | {"kinds": facts["kinds"] | {depth: spread_kinds(told.filter(F.col("kind") == SPREAD))}}
        tables.append(told.filter(F.col("kind") != SPREAD))
        common.release(docs.sparkSession)

    def fn(table: pa.Table) -> pa.Table:
        block = at_depth(_rows_of(table), DEPTH, facts)
        starts, sums = block.starts, lambda x: np.add.reduceat(x, block.starts)
        out = [
            pa.array(block.ids, pa.int64(), mask=block.has_id == 0), block.held, np.diff(np.append(starts, len(block.p))) - 1, sums(block.known.astype(np.int64)),
            np.full(len(starts), facts["n"]), sums(np.log10(block.base)), sums(np.log10(block.p)),
        ]
        return pa.table([pa.array(c) for c in out], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = _union(tables).groupBy("block").applyInArrow(fn, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return common.sweep(since, out)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out
