"""Token ids in binary blocks, coded by a static range asymmetric numeral system.

Texts are tokenized once; the ids are kept as little-endian 16-bit numbers. One
frequency table over all documents is shared by every block. A block holds
whole documents in ascending doc_id order, is coded by interleaved lanes, and
can be decoded without any other block. Blocks are rows of a Parquet table, so
Spark's committer makes the files whole or absent:

    magic "TKR1", n_lanes, n_ids, n_checkpoints     4 bytes and three uint32
    crc32 of all that follows                       uint32
    checkpoints                                     (ids before, words before, lane states), one for each CHECKPOINT steps
    coded words                                     uint32, in the order the decoder reads them

Lane j codes ids j, j + n_lanes, ...; a decoder can start at any checkpoint.

Nulls and edge cases: a null text is an empty one, so it has the end id alone;
null ids come first; rows with one doc_id follow each other by their ids; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgraph.storage import shared_dir

from .common import Batches, frugal, in_pieces, materialize

MAGIC = b"TKR1"
END_ID = 1
#: Frequencies are scaled to 2**SCALE; 32-bit words leave and enter 64-bit states of at least 2**31.
SCALE, LOW = 20, 31
#: A block is closed at so many ids; the steps of a block between two checkpoints; most lanes.
BLOCK_IDS, CHECKPOINT, LANES = 1 << 18, 64, 2048
#: Bytes of text tokenized together, and pieces whose ids a worker remembers.
BATCH_BYTES, CACHE = 8 << 20, 500_000

#: Stands between pieces that are encoded in one call; one itself, whose id occurs in none without it.
BETWEEN = "~"
#: The tokenizer composes before it lowers case, and a small letter may compose with a mark where its capital doesn't; no mark is below U+0300.
MARKED_CAPITAL = r"[A-Z][\x{0300}-\x{10FFFF}]"
#: Letters below U+0100, which form one piece, and marks that are pieces of their own at a word's end.
LETTERS, MARKS = "^[A-Za-zªµºÀ-ÖØ-öø-ÿ]+$", "!*#$%&.,;:?"
#: Pieces encoded in one call.
CALL = 4000


class Encoder:
    """ids of texts, piece by piece with a bounded memory of pieces.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its words in turn. Words are cut at blanks and newlines only;
    a word is one piece, or letters and the marks after them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.closes = np.zeros(1 << 16, bool)
        self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        (self.between,) = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        """Piece 0 is the empty one, piece 1 the end id."""
        self.known: dict[str, int] = {"": 0}
        self.sizes, self.ids = [np.array([0, 1], np.int32)], [np.array([END_ID], "<u2")]
        self.count = 2

    def remember(self, pieces: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.known.update(zip(pieces, range(self.count, self.count + len(pieces)), strict=True))
        self.count += len(pieces)
        self.sizes.append(sizes.astype(np.int32))
        self.ids.append(ids)

    def learn(self, pieces: list[str], letters: bool) -> None:
        """Letters alone are one piece, whose last id closes a word; other pieces are told apart by a sign between them."""
        for at in range(0, len(pieces), CALL):
            some = pieces[at : at + CALL]
            text = (" " if letters else f" {BETWEEN} ").join(some)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2")
            ends = np.flatnonzero(self.closes[ids] if letters else ids == self.between) + 1
            if not letters:
                ends = np.append(ends, len(ids) + 1) - np.arange(1, len(ends) + 2)
                ids = ids[ids != self.between]
            self.remember(some, np.diff(ends, prepend=0), ids)

    def numbered(self, pieces: pa.Array, how: str) -> np.ndarray:
        """Numbers of the pieces, which are learned where they are new."""
        own = pieces.dictionary_encode()
        values = own.dictionary.to_pylist()
        at = list(map(self.known.get, values))
        new = [p for p, k in zip(values, at, strict=True) if k is None]
        if new and how == "whole":  # what looks like one of the tokenizer's own signs
            found = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
            self.remember(new, np.array([len(e.ids) for e in found]), np.concatenate([np.array(e.ids, "<u2") for e in found]))
        elif new:
            self.learn(new, how == "letters")
        if new:
            at = [self.known[p] if k is None else k for p, k in zip(values, at, strict=True)]
        return np.array(at, np.int32)[own.indices.to_numpy()]

    def pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the two pieces of each distinct word."""
        special = pc.or_(pc.match_substring(words, BETWEEN), pc.match_substring(words, "<|"))
        folded = pc.if_else(pc.match_substring_regex(words, MARKED_CAPITAL), words, pc.ascii_lower(words))
        head = pc.ascii_rtrim(folded, MARKS)
        letters = pc.match_substring_regex(head, LETTERS)
        cut = pc.or_(letters, pc.equal(head, ""))
        head = pc.if_else(cut, head, folded)
        kinds = np.where(special.to_numpy(zero_copy_only=False), 2, np.where(letters.to_numpy(zero_copy_only=False), 0, 1))
        first, second = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
        for k, how in enumerate(("letters", "between", "whole")):
            own = np.flatnonzero(kinds == k)
            first[own] = self.numbered((words if k == 2 else head).take(pa.array(own)), how)
        short = np.flatnonzero((kinds == 0) & (pc.binary_length(head).to_numpy() < pc.binary_length(folded).to_numpy()))
        tails = pc.replace_substring_regex(folded.take(pa.array(short)), "^[^" + re.escape(MARKS) + "]+", "")
        second[short] = self.numbered(tails, "between")
        marks = np.flatnonzero((kinds == 1) & (pc.binary_length(head).to_numpy() == 0) & (pc.binary_length(folded).to_numpy() > 0))
        first[marks] = self.numbered(folded.take(pa.array(marks)), "between")
        return first, second

    def encode(self, texts: pa.Array) -> pa.Array:
        """Each text's ids as little-endian 16-bit numbers, the end id last."""
        if self.count > CACHE:
            self.forget()
        plain = pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), "\n", " ")
        cut = pc.split_pattern(plain, " ")
        words = cut.flatten().dictionary_encode()
        first, second = self.pieces(words.dictionary)
        at = words.indices.to_numpy()
        per_text = pc.list_value_length(cut).to_numpy()
        # two pieces a word, and the end after each text
        ends = np.cumsum(per_text)
        seq = np.empty(2 * len(at) + len(ends), np.int32)
        stop = np.zeros(len(seq), bool)
        stop[2 * ends + np.arange(len(ends))] = True
        seq[stop] = 1
        seq[~stop] = np.stack([first[at], second[at]], axis=1).ravel()
        self.sizes, self.ids = [np.concatenate(self.sizes)], [np.concatenate(self.ids)]
        sizes, ids = self.sizes[0], self.ids[0]
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        n = sizes[seq]
        total = np.cumsum(n, dtype=np.int64)
        # the k-th id of a piece stands k places after the piece's start
        out = ids[np.repeat(starts[seq] - (total - n), n) + np.arange(total[-1] if len(total) else 0)]
        offsets = np.append(0, 2 * total[stop])
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out.tobytes())])


ENCODERS: dict[str, Encoder] = {}


def tokenize(documents: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids): 16-bit ids, the end id last."""

    def run(batches: Batches) -> Batches:
        own = ENCODERS.get(vocabulary) or ENCODERS.setdefault(vocabulary, Encoder(vocabulary))
        for batch in in_pieces(batches, 1, BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), own.encode(batch.column(1))], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {dict(documents.dtypes)['doc_id']}, ids binary")


def count_ids(tokens: DataFrame) -> np.ndarray:
    """How often each of the 65536 possible ids occurs."""

    def run(batches: Batches) -> Batches:
        n = np.zeros(1 << 16, np.int64)
        for batch in in_pieces(batches, 0):
            n += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2"), minlength=1 << 16)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["id", "n"])

    table = tokens.select("ids").mapInArrow(frugal(run), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 << 16, np.int64)
    counts[table["id"].to_numpy()] = table["n"].to_numpy()
    return counts


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies of sum 2**SCALE, 1 at least for every id that occurs."""
    total, seen = counts.sum(), counts > 0
    if not total:
        return np.zeros(len(counts), np.uint64)
    room = (1 << SCALE) - int(seen.sum())
    freq = np.where(seen, 1 + (counts * (room / total)).astype(np.int64), 0)
    freq[counts.argmax()] += (1 << SCALE) - int(freq.sum())
    return freq.astype(np.uint64)


def encode_block(ids: np.ndarray, freq: np.ndarray, start: np.ndarray) -> bytes:
    lanes = max(1, min(LANES, len(ids) // 64))
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, 1 << LOW, np.uint64)
    words: list[np.ndarray] = []
    marks, written = [], 0
    for s in range(steps - 1, -1, -1):  # the last id first, so that the decoder reads forwards
        own = ids[s * lanes : (s + 1) * lanes]
        f, x = freq[own], state[: len(own)]
        full = x >= (f << np.uint64(LOW - SCALE + 32))
        if full.any():
            words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            written += len(words[-1])
            x = np.where(full, x >> np.uint64(32), x)
        q, r = np.divmod(x, f)
        state[: len(own)] = (q << np.uint64(SCALE)) + r + start[own]
        if s % CHECKPOINT == 0:
            marks.append((s * lanes, written, state.copy()))
    body = b"".join(struct.pack("<II", at, written - w) + st.astype("<u8").tobytes() for at, w, st in reversed(marks))
    body += b"".join(w.tobytes() for w in reversed(words))
    return MAGIC + struct.pack("<IIII", lanes, len(ids), len(marks), zlib.crc32(body)) + body


def decode_block(block: bytes, freq: np.ndarray, start: np.ndarray, lookup: np.ndarray, checkpoint: int = 0) -> np.ndarray:
    """The block's ids from a checkpoint on. ``lookup`` has the id of every slot."""
    lanes, n, marks, crc = struct.unpack_from("<IIII", block, 4)
    body = memoryview(block)[20:]
    if block[:4] != MAGIC or zlib.crc32(body) != crc:
        raise ValueError("damaged block of token ids")
    size = 8 + 8 * lanes
    first, at = struct.unpack_from("<II", body, checkpoint * size)
    state = np.frombuffer(body, "<u8", lanes, checkpoint * size + 8).astype(np.uint64)
    words = np.frombuffer(body, "<u4", offset=marks * size)
    out = np.empty(n - first, np.uint16)
    for s in range(0, n - first, lanes):
        own = out[s : s + lanes]
        x = state[: len(own)]
        slot = x & np.uint64((1 << SCALE) - 1)
        own[:] = lookup[slot.astype(np.intp)]
        x = freq[own] * (x >> np.uint64(SCALE)) + slot - start[own]
        low = np.flatnonzero(x < np.uint64(1 << LOW))
        if len(low):
            x[low] = (x[low] << np.uint64(32)) | words[at : at + len(low)]
            at += len(low)
        state[: len(own)] = x
    return out


def write_ids(tokens: DataFrame, path: str) -> None:
    """Blocks and the shared frequency table below ``path``."""
    spark = tokens.sparkSession
    freq = scaled(count_ids(tokens))
    used = np.flatnonzero(freq)
    spark.createDataFrame([(int(i), int(freq[i])) for i in used], "id int, freq int").coalesce(1).write.parquet(f"{path}/frequencies")
    shared = spark.sparkContext.broadcast(freq)

    def run(batches: Batches) -> Batches:
        freq = shared.value
        start = np.cumsum(freq, dtype=np.uint64) - freq
        file, before, nr = TaskContext.get().partitionId(), 0, 0
        held, docs = [], []

        def close() -> pa.RecordBatch:
            nonlocal before, nr
            ids = np.frombuffer(b"".join(held), "<u2")
            sizes = [len(x) // 2 for x in held]
            row = {
                "file": [file], "block": [nr], "before": [before], "n_ids": [len(ids)],
                "doc_ids": pa.array([pa.array(docs, kind).to_pylist()], pa.list_(kind)), "sizes": pa.array([sizes], pa.list_(pa.int64())),
                "data": pa.array([encode_block(ids, freq, start)], pa.binary()),
            }
            before, nr = before + len(ids), nr + 1
            held.clear()
            docs.clear()
            return pa.RecordBatch.from_pydict(row, schema=schema)

        pending = 0
        for batch in in_pieces(batches, 1):
            kind = batch.schema.field(0).type
            schema = pa.schema([("file", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(kind)), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())])
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs.append(doc)
                held.append(ids)
                pending += len(ids) // 2
                if pending >= BLOCK_IDS:
                    yield close()
                    pending = 0
        if held:
            yield close()

    kind = dict(tokens.dtypes)["doc_id"]
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        tokens.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "ids")
        .mapInArrow(frugal(run), f"file int, block int, before long, n_ids long, doc_ids array<{kind}>, sizes array<long>, data binary")
        .write.option("compression", "none").parquet(f"{path}/blocks")
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): decodes every block of the files; ``start`` counts the ids of all documents before."""
    table = spark.read.parquet(f"{path}/frequencies").toPandas()
    freq = np.zeros(1 << 16, np.uint64)
    freq[table["id"].to_numpy()] = table["freq"].to_numpy().astype(np.uint64)
    shared = spark.sparkContext.broadcast(freq)
    blocks = spark.read.parquet(f"{path}/blocks")
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"))
    files = files.select("file", (F.sum("n").over(W.orderBy("file")) - F.col("n")).alias("file_start"))  # a row a file
    kind = dict(blocks.dtypes)["doc_ids"].removeprefix("array<")[:-1]

    def run(batches: Batches) -> Batches:
        freq = shared.value
        start = np.cumsum(freq, dtype=np.uint64) - freq
        lookup = np.repeat(np.arange(1 << 16, dtype=np.uint16), freq.astype(np.int64))
        for batch in batches:
            for i in range(batch.num_rows):
                at, sizes = batch.column(0)[i].as_py(), np.array(batch.column(2)[i].as_py(), np.int64)
                ids = decode_block(batch.column(3)[i].as_py(), freq, start, lookup).tobytes()
                ends = np.cumsum(sizes)
                own = [ids[2 * (e - n) : 2 * e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                docs = batch.column(1)[i].values
                yield pa.RecordBatch.from_arrays([docs, pa.array(at + ends - sizes, pa.int64()), pa.array(own, pa.binary())], ["doc_id", "start", "ids"])

    joined = blocks.join(F.broadcast(files), "file").select((F.col("file_start") + F.col("before")).alias("at"), "doc_ids", "sizes", "data")
    return joined.mapInArrow(frugal(run), f"doc_id {kind}, start long, ids binary")


def digest(decoded: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit numbers)."""

    def run(batches: Batches) -> Batches:
        for batch in in_pieces(batches, 2):
            ids = batch.column(2).to_pylist()
            crc = [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return decoded.mapInArrow(frugal(run), f"doc_id {dict(decoded.dtypes)['doc_id']}, start long, n_tokens long, ids_crc32 long")


def round_trip(documents: DataFrame, vocabulary: str, path: str | None = None) -> DataFrame:
    """Tokenizes, writes the files below ``path`` (a new folder of the shared one), and digests what is read back."""
    import uuid

    spark = documents.sparkSession
    path = path or f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(materialize(tokenize(documents, vocabulary), "token-ids"), path)
    return digest(read_ids(spark, path))
