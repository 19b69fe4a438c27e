"""Token ids in Arrow stream files with fixed-size-list batches.

A shard is one Arrow stream: batches of two columns, `input_ids` and `mask`,
both fixed-size lists of SEQUENCE items, so that in a memory-mapped shard row i
is a view at a known place. A mask is a bitmap, as Arrow keeps booleans, and its
view holds eight items in a byte (`unpacked` spells them out). The ids of all documents of a shard follow each
other, each document's closed by the end id; the last row is filled up, which
its mask shows. The stream's schema carries the documents' ids and lengths, so
a shard is read without any other file.

Documents are dealt to partitions in ranges of their id and written in ascending
order, null ids first, copies of an id in the order of a hash of their texts.
Files are written by Spark's own writer (one row of bytes a file), so a failed
task leaves none behind, in any store that Spark reaches.

Words between ASCII blanks are encoded by the library once, and their ids kept
in a bounded cache: the vocabulary's splitter never joins across white space.

Defined cases: a null text is empty and gives the end id alone; repeated rows
are written each; extra columns are not looked at; an empty table gives no
shard and an empty result.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import CHUNK_BYTES, RunCache, chunks, column_of, forget_at_exit, gather, scratch_path, text_or_empty, tokenizer_path, words_of, worker_cache, written

#: Ids in a row of a shard, and rows in a batch.
SEQUENCE, BATCH_ROWS = 2048, 256
#: A shard is closed once it has so many ids (a single longer document goes into one shard): 32 MB of two-byte ids.
SHARD_IDS = 16 << 20
#: Words whose ids a worker keeps in each generation of its cache.
KEPT_WORDS = 200_000
END_ID = 1


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[c for c in range(128) if chr(c).isalpha()]] = True
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True


def finer(texts: pa.Array) -> pa.Array:
    """The texts in lower case (ASCII only) and with a blank where a letter is followed by a mark: the same ids from fewer words.

    The vocabulary's normaliser folds case after composing characters, and its splitter parts letters from marks, the
    apostrophe apart; ASCII marks compose with nothing before them. Texts that may hold a special token are left alone.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if len(data) < 3 or b"<|" in data.tobytes():
        return texts
    cut = np.zeros(len(data), bool)
    cut[1:] = _LETTER[data[:-1]]
    latin = (data[:-2] == 0xC3) & (data[1:-1] >= 0x80) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)  # two-byte Latin letters
    cut[2:] |= latin
    cut &= _MARK[data]
    cut[offsets[:-1][offsets[:-1] < len(data)]] = False  # what stands before belongs to another text
    added = np.concatenate([[0], np.cumsum(cut)])
    laid = np.full(len(data) + int(added[-1]), 32, np.uint8)
    plain = np.ones(len(data), bool)  # a letter before anything but ASCII may compose with it, which its case decides
    plain[:-1] = data[1:] < 0x80
    laid[np.arange(len(data)) + added[1:]] = np.where(plain, _LOWER[data], data)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets + added[offsets]).astype(np.int64)), pa.py_buffer(laid))


class WordEncoder:
    """Ids of words by the tokenizers library, kept as runs of one growing array."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        self.known = RunCache(KEPT_WORDS)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text)."""
        words, codes, offsets = words_of(finer(texts))
        data, starts, sizes = self.known.runs_of(words.to_pylist(), lambda new: [e.ids for e in self.library.encode_batch_fast(new, add_special_tokens=False)])
        ids = data[gather(starts[codes], sizes[codes])] if len(codes) else np.zeros(0, np.uint32)
        sums = np.concatenate([[0], np.cumsum(sizes[codes] if len(codes) else np.zeros(0, np.int64))])
        return ids, sums[offsets]


def shard_bytes(part: int, number: int, ids: np.ndarray, doc_ids: np.ndarray, valid: np.ndarray, sizes: np.ndarray, sequence: int) -> bytes:
    """One shard as an Arrow stream; ids that fit take two bytes. The sequence is a multiple of eight, so that masks begin at whole bytes."""
    if sequence % 8:
        raise ValueError("the sequence must be a multiple of eight")
    rows = -(-len(ids) // sequence)
    width = np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.uint32
    laid, mask = np.zeros(rows * sequence, width), np.zeros(rows * sequence, bool)
    laid[: len(ids)], mask[: len(ids)] = ids, True
    about = {"part": str(part), "number": str(number), "n_ids": str(len(ids)), "doc_ids": doc_ids.astype("<i8").tobytes(), "doc_valid": valid.astype(np.uint8).tobytes(), "doc_sizes": sizes.astype("<i8").tobytes()}
    schema = pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(width), sequence)), ("mask", pa.list_(pa.bool_(), sequence))], metadata=about)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        for at in range(0, rows, BATCH_ROWS):
            part_of = slice(at * sequence, min(rows, at + BATCH_ROWS) * sequence)
            out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x[part_of]), sequence) for x in (laid, mask)], schema=schema))
    return sink.getvalue().to_pybytes()


class Shard:
    """A shard in a buffer (bytes, or a memory map): rows and ids are views of it."""

    def __init__(self, buffer):
        with pa.ipc.open_stream(pa.py_buffer(buffer) if isinstance(buffer, (bytes, bytearray, memoryview)) else buffer) as stream:
            self.batches = list(stream)
            about = stream.schema.metadata
            self.sequence = stream.schema.field("input_ids").type.list_size
        self.part, self.number, self.n_ids = (int(about[k]) for k in (b"part", b"number", b"n_ids"))
        self.doc_ids, self.doc_sizes = np.frombuffer(about[b"doc_ids"], "<i8"), np.frombuffer(about[b"doc_sizes"], "<i8")
        self.doc_valid = np.frombuffer(about[b"doc_valid"], np.uint8).astype(bool)

    def row(self, i: int, column: str = "input_ids") -> np.ndarray:
        """Row i as a view of the buffer: its ids, or its mask as a bitmap of sequence / 8 bytes, the lowest bit first."""
        batch, i = self.batches[i // BATCH_ROWS], i % BATCH_ROWS
        if column != "mask":
            return batch.column(column)[i].values.to_numpy(zero_copy_only=True)
        width = self.sequence // 8
        return np.frombuffer(batch.column("mask").values.buffers()[1], np.uint8)[i * width : (i + 1) * width]

    def ids(self) -> np.ndarray:
        parts = [_items(b.column("input_ids")) for b in self.batches]
        return (np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.uint16))[: self.n_ids]


def unpacked(mask: np.ndarray) -> np.ndarray:
    """The items of a mask's bitmap."""
    return np.unpackbits(mask, bitorder="little").astype(bool)


def _items(lists: pa.FixedSizeListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=True)


def write_store(docs: DataFrame, path: str, vocabulary_path: str | None = None, end_id: int = END_ID, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Writes the shards of all documents under the path. The id must be an integer."""
    with open(vocabulary_path or tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, of fixed size

    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        cache = worker_cache("words")
        key = zlib.crc32(vocabulary.value.encode())
        encoder = cache[key] = cache.get(key) or WordEncoder(vocabulary.value)
        held: list[tuple] = []
        waiting = 0

        def shard():
            nonlocal held, waiting, number
            made = shard_bytes(part, number, *(np.concatenate([h[k] for h in held]) for k in range(4)), sequence)
            held, waiting, number = [], 0, number + 1
            return pa.record_batch([pa.array([made], pa.binary())], ["shard"])

        for batch in chunks(batches, limit=min(2 * CHUNK_BYTES, 4 * shard_ids)):
            ids, offsets = encoder.encode(column_of(batch, "text"))
            n = batch.num_rows
            closed = np.full(len(ids) + n, end_id, np.uint32)
            closed[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(offsets))] = ids
            doc_ids = column_of(batch, "id")
            if not len(closed) or closed.max() < 1 << 16:
                closed = closed.astype(np.uint16)  # half the memory while they wait
            held.append((closed, np.asarray(doc_ids.fill_null(0)), np.asarray(doc_ids.is_valid()), np.diff(offsets) + 1))
            waiting += len(closed)
            if waiting >= shard_ids:
                yield shard()
        if held:
            yield shard()

    tie = F.xxhash64("text")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.repartitionByRange(F.col("id").asc_nulls_first(), tie).sortWithinPartitions(F.col("id").asc_nulls_first(), tie)
    made = rows.mapInArrow(run, "shard binary")
    made.select(F.col("shard").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document in the shards under the path: id, part and number of its shard, its place there, its ids' count and crc32."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                shard = Shard(content.as_buffer())
                ids, ends = shard.ids(), np.cumsum(shard.doc_sizes)
                sums = [zlib.crc32(ids[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends, shard.doc_sizes, strict=True)]
                n = len(ends)
                yield pa.record_batch(
                    [pa.array(shard.doc_ids, mask=~shard.doc_valid), pa.array(np.full(n, shard.part)), pa.array(np.full(n, shard.number)), pa.array(ends - shard.doc_sizes), pa.array(shard.doc_sizes), pa.array(sums, pa.int64())],
                    ["id", "part", "number", "place", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "id long, part long, number long, place long, n_tokens long, ids_crc32 long")


def stored_documents(docs: DataFrame, vocabulary_path: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The columns that op1 returns, read back from the files written."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_store(docs, path, vocabulary_path, shard_ids=shard_ids)
    forget_at_exit(spark, path)
    read = written(read_store(spark, path), "token-index")
    shards = read.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    of_part = shards.groupBy("part").agg(F.sum("n").alias("n"))  # a few rows: ids before each partition, then before each of its shards
    base = of_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    within = shards.select("part", "number", (F.sum("n").over(Window.partitionBy("part").orderBy("number")) - F.col("n")).alias("within"))
    places = written(within.join(base, "part").select("part", "number", (F.col("base") + F.col("within")).alias("base")), "shards")
    found = read.join(places, ["part", "number"])
    return found.select(F.col("id").alias("doc_id"), (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
