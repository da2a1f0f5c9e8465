"""Byte-level BPE over Arrow batches: encoding, offsets, decoding, and token counts of whole texts.

The merges are done by the tokenizers library. A text is cut before white space, where no match of
the split pattern can cross, so each distinct chunk is encoded once per worker and looked up afterwards.
"""

from __future__ import annotations

import base64
import itertools
import json
import re
import zlib
from array import array
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Chunks a worker remembers at most (about 200 bytes each); then it starts anew.
CACHE_ENTRIES = 500_000
#: Longer chunks aren't remembered.
CACHED_CHARS = 64
#: White space beyond ASCII's six: texts that hold some go through the tokenizer in one piece.
_RARE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_SPACE_RUN = re.compile("[ \t\n\r\x0b\x0c] ")
_CHUNK = re.compile("[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
#: Chunks of ASCII and of letters that every version of Unicode agrees on; _SPLIT is the split pattern on them.
_PLAIN = re.compile("[\x00-\x1b\x20-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f\u03a3-\u03ff\u0410-\u044f\u4e00-\u9fa5\uac00-\ud7a3]+")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\u0080-\U0010ffff]+| ?[0-9]+| ?[^\\sA-Za-z0-9\u0080-\U0010ffff]+|\\s+(?!\\S)|\\s+")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), 256)]
    table = {b: chr(b) for b in plain}
    table |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in table)}
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def tokenizer_from_ranks(ranks: dict[bytes, int]):
    """A tokenizer whose merges are all the pairs that make a token, in the order of the tokens' ranks."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    chars = byte_chars()
    shown = lambda token: "".join(chars[b] for b in token)
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        pairs = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        merges += [(shown(a), shown(b)) for a, b in sorted(pairs, key=lambda p: (ranks[p[0]], ranks[p[1]]))]
    made = Tokenizer(models.BPE({shown(t): r for t, r in ranks.items()}, merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return made


class Chunks(dict):
    """Chunk without its leading space -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(" " + chunk)
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """Encodes whole texts as the vocabulary at ``path`` does (a tokenizers JSON or a file of ranks)."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        chars = byte_chars()
        if path.endswith(".json"):
            self.tokenizer = Tokenizer.from_file(path)
            back = {c: b for b, c in enumerate(chars)}
            vocab = self.tokenizer.get_vocab(with_added_tokens=False)
            self.table = {i: bytes(back[c] for c in shown) for shown, i in vocab.items()}
            with open(path, encoding="utf-8") as f:
                added = {a["content"]: a["id"] for a in json.load(f).get("added_tokens", [])}
            self.table |= {i: content.encode() for content, i in added.items()}
            self.added = {content: array("I", [i]).tobytes() for content, i in added.items()}
        else:
            ranks = read_ranks(path)
            self.tokenizer = tokenizer_from_ranks(ranks)
            self.table, self.added = {i: token for token, i in ranks.items()}, {}
        #: The contents of added tokens, the longest first: the library cuts a text at them before anything else.
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.model = self.tokenizer.model
        self.sizes = np.zeros(max(self.table, default=0) + 1, np.int64)
        for i, token in self.table.items():
            self.sizes[i] = len(token)
        self.shown = {b: ord(c) for b, c in enumerate(chars)}
        self.matches: dict[str, bytes] = {}
        self.chunks = Chunks(self.encode_chunk)

    def encode_match(self, match: str) -> bytes:
        """One match of the split pattern, merged by the model."""
        ids = self.matches.get(match)
        if ids is None:
            ids = array("I", [t.id for t in self.model.tokenize(match.encode().decode("latin-1").translate(self.shown))]).tobytes()
            if len(match) < 3 and len(self.matches) < 10_000:
                self.matches[match] = ids
        return ids

    def encode_chunk(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk):
            if chunk[0] == " " and chunk[1:].isalpha():
                return self.encode_match(chunk)
            return b"".join(map(self.encode_match, _SPLIT.findall(chunk)))
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; an added token's content is that token, as in the library."""
        if not text:
            return b""
        if self.cut and self.cut.search(text):
            return b"".join([self.added[p] if i % 2 else self.encode_plain(p) for i, p in enumerate(self.cut.split(text)) if p])
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        if _RARE_SPACE.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if _SPACE_RUN.search(text):
            return b"".join([self.chunks[c[1:]] if c[0] == " " else self.encode_chunk(c) for c in _CHUNK.findall(text)])
        first, *rest = text.split(" ")
        head = b"".join(map(self.encode_chunk, _CHUNK.findall(first))) if first else b""
        return head + b"".join(map(self.chunks.__getitem__, rest))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def offsets(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Start and end of each token in code points; a character split among tokens belongs to each of them."""
        raw = np.frombuffer(text.encode(), np.uint8)
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.sizes[ids])
        starts = ends - self.sizes[ids]
        return np.stack([char_of[starts], char_of[ends - 1] + 1], 1) if len(ids) else np.zeros((0, 2), np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_offsets: bool = False) -> DataFrame:
    """Each document's ids, and each token's code-point span on request.

    A null text is empty and has no ids; repeated rows are encoded row by row; other columns are left out.
    """
    fields = [pa.field("ids", pa.list_(pa.int32()))] + [pa.field(n, pa.list_(pa.int32())) for n in ("starts", "ends") if with_offsets]
    id_type = docs.schema[id_col].dataType.simpleString()

    def rows(batch):
        enc, ids, starts, ends = encoder(path), [], [], []
        for text in batch.column(1).to_pylist():
            own = np.frombuffer(enc.encode(text or ""), "<u4")
            ids.append(own.astype(np.int32))
            if with_offsets:
                spans = enc.offsets(text or "", own).astype(np.int32)
                starts.append(spans[:, 0])
                ends.append(spans[:, 1])
        return [batch.column(0), ids, starts, ends][: 2 + 2 * with_offsets]

    def run(stream):
        for batch in stream:
            for part in common.slices(batch):
                schema = pa.schema([pa.field("id", part.schema.types[0]), *fields])
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.list_(pa.int32())) for c in rows(part)], schema=schema)

    more = ", starts array<int>, ends array<int>" if with_offsets else ""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, ids array<int>{more}").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes and the text of each row's ids; characters split among tokens come together again in the bytes.

    A null array decodes to no bytes; bytes that aren't UTF-8 become replacement characters in the text.
    """
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(stream):
        for batch in itertools.chain.from_iterable(map(common.slices, stream)):
            raw = [encoder(path).decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw])], names=["id", "raw", "text"])

    return encoded.select(F.col(id_col).alias("id"), ids_col).mapInArrow(run, f"id {id_type}, raw binary, text string").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: n_tokens, the SHA-256 of its ids and of the bytes that they decode to, n_split and covers.

    Encoding, offsets and decoding happen in one pass over Arrow batches, without a shuffle. n_split: the tokens
    that begin or end within a character, by their byte and code-point offsets; covers: the tokens' code-point spans
    begin with the text, leave no gap and end with it. A null or empty text has no ids, so both digests are those of no bytes.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_split", pa.int64()), ("covers", pa.bool_())])

    def rows(batch):
        enc, out = encoder(path), ([], [], [], [], [])
        for text in batch.column(1).to_pylist():
            text = text or ""
            packed = enc.encode(text)
            ids = np.frombuffer(packed, "<u4")
            spans = enc.offsets(text, ids)
            shared = spans[1:, 0] < spans[:-1, 1]  # a character that two tokens have a part of
            covers = len(ids) == 0 and not text or len(ids) > 0 and spans[0, 0] == 0 and spans[-1, 1] == len(text) and bool((spans[1:, 0] <= spans[:-1, 1]).all())
            n_split = (np.append(shared, False) | np.append(False, shared)).sum() if len(ids) else 0
            for column, value in zip(out, (len(ids), sha256(packed).hexdigest(), sha256(enc.decode(ids.tolist())).hexdigest(), int(n_split), bool(covers))):
                column.append(value)
        return [batch.column(0), *out]

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.batches(rows, schema), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long, covers boolean")


def count_tokens(docs: DataFrame, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row's number of tokens (0 for a null or empty text), with the columns named in ``keep``."""
    types = {c: docs.schema[c].dataType.simpleString() for c in keep}

    def run(stream):
        for batch in stream:
            for part in common.slices(batch):
                enc = encoder(path)
                n = [len(enc.encode(t or "")) // 4 for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), *part.columns[1:]], names=["n_tokens", *keep])

    return docs.select("text", *keep).mapInArrow(run, ", ".join(["n_tokens long", *[f"`{c}` {t}" for c, t in types.items()]]))


def binary_pieces(n: int, longest: int) -> list[int]:
    """``n`` as runs of ``longest`` (a power of two), then falling powers of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, path: str, longest: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Power-of-two packing: each document's ids and one end id are cut into pieces of binary lengths.

    Every piece is a sequence of its own, so no sequence crosses documents and none needs padding. The rows lie by
    ``bucket`` (the length's exponent): sequences of equal length are neighbours, and ``write_buckets`` makes a folder of
    each bucket. sequence_id is a piece's place in the order of bucket, doc_id, start and ids, so it depends
    on the documents alone, whatever the input's files; pieces that are equal in all of these take their places in any
    order. ``with_ids``: the ids too. A null or empty text is its end id alone. Rows with the same doc_id are packed
    one by one. Texts stay where they are; the pieces' rows are dealt by range, with a key of their own behind the
    order, so that equal rows are spread, too.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    more = [("ids", pa.list_(pa.int32()))] if with_ids else []
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("bucket", pa.int32()), *more])
    end = np.array([end_id], "<u4").tobytes()

    def rows(batch):
        enc, out = encoder(path), tuple([] for _ in schema)
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            packed = memoryview(enc.encode(text or "") + end)
            total, start = len(packed) // 4, 0
            for length in binary_pieces(total, longest):
                own = packed[4 * start : 4 * (start + length)]
                for column, value in zip(out, (doc_id, start, length, zlib.crc32(own), total, length.bit_length() - 1, np.frombuffer(own, "<i4") if with_ids else None)):
                    column.append(value)
                start += length
        return out

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + (", ids array<int>" if with_ids else "")
    since = common.mark()
    pieces = common.materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.batches(rows, schema), ddl).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    order = ["bucket", "doc_id", "start", "ids_crc32", "doc_tokens", "_row"]
    placed = pieces.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    placed = common.materialise(placed.withColumns({"_part": F.shiftright("_row", 33), "_row": F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))}), "placed")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))  # one row for each part of the range
    before = sizes.select("_part", F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = placed.join(before, "_part").withColumns({"sequence_id": F.col("_before") + F.col("_row"), "offset": F.lit(0).cast("long")}).drop("_part", "_before", "_row")
    return common.sweep(since, out)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes packed sequences to a folder for each bucket, so that a batch reads sequences of one length."""
    packed.write.partitionBy("bucket").parquet(path)


def length_report(docs: DataFrame, path: str, block: int = 1024) -> DataFrame:
    """Exact length histogram: a row for each encoded length that occurs, with what it answers.

    length; n_docs of that length; docs_longer and tokens_longer, and docs_upto and tokens_upto (suffix
    and prefix sums); truncated_total, the tokens left if every document were cut at ``length``;
    total_docs and total_tokens; quantile, the share of documents no longer than ``length``. The answer
    for a limit that doesn't occur is that of the next smaller length, its truncated total more by
    docs_longer for each further token.

    Only (length, count) pairs are shuffled, pre-aggregated in each task, so a hot source or one very
    common length costs a row a task. The sums run within blocks of lengths and over the blocks' totals,
    so no task has all lengths. A null or empty text has length 0. No documents: no rows.
    """
    counts = count_tokens(docs, path).groupBy(F.col("n_tokens").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))
    counts = common.materialise(counts.withColumn("block", F.floor(F.col("length") / block)), "lengths")
    totals = counts.groupBy("block").agg(F.sum("n_docs").alias("bn"), F.sum(F.col("n_docs") * F.col("length")).alias("bt"))
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    everywhere = W.orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    totals = totals.select(
        "block", F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("bt").over(before), F.lit(0)).alias("t0"), F.sum("bn").over(everywhere).alias("total_docs"), F.sum("bt").over(everywhere).alias("total_tokens")
    )
    within = W.partitionBy("block").orderBy("length").rowsBetween(W.unboundedPreceding, 0)
    upto = counts.select("block", "length", "n_docs", F.sum("n_docs").over(within).alias("n1"), F.sum(F.col("n_docs") * F.col("length")).over(within).alias("t1")).join(totals, "block")
    upto = upto.select("length", "n_docs", (F.col("n0") + F.col("n1")).alias("docs_upto"), (F.col("t0") + F.col("t1")).alias("tokens_upto"), "total_docs", "total_tokens")
    longer = upto.withColumns({"docs_longer": F.col("total_docs") - F.col("docs_upto"), "tokens_longer": F.col("total_tokens") - F.col("tokens_upto")})
    return longer.withColumns({"truncated_total": F.col("tokens_upto") + F.col("docs_longer") * F.col("length"), "quantile": F.col("docs_upto") / F.col("total_docs")})
