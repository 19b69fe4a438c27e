"""What the corpus operators share: tables, written intermediates, text batches."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import types
import uuid
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Text is cut into chunks of about so many bytes before vectorised work, which bounds a Python worker's memory.
CHUNK_BYTES = 1 << 20

#: Rows go to a Python worker in batches of about so many bytes. Spark's own bound, 64 MB, lets the JVM and each worker hold 10,000 texts at once.
BATCH_BYTES = 2 << 20

#: Rows of a few numbers each that are broadcast, at most.
MOST_BROADCAST = 2_000_000

#: A word, as all word-based operators take it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds by BATCH_BYTES what this session sends to a Python worker at a time, unless it was given a bound already."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) is None:
        spark.conf.set(bound, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder for intermediates: spark.checkpoint.dir, or a local one where it is unset and Spark is local (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = "file://" + tempfile.mkdtemp(prefix="pairloom-")
    return shared_dir.own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is written there goes when the driver's JVM ends, if forget_at_exit() is told."""
    return f"{shared_dir(spark)}/pairloom/{name}-{uuid.uuid4().hex}"


def forget_at_exit(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and an executor's loss costs no recomputation before it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    forget_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> DataFrame:
    """(_doc, _key): each row as a struct, and a number of it that is the same whenever it is read again.

    Rows of a Parquet table are numbered by file and place in it; any other rows are written first.
    """
    if not _has_places(docs):
        docs = written(docs, "rows")
    about = docs.metadataColumn("_metadata")
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_doc"), about["file_path"].alias("_file"), about["row_index"].alias("_at"))
    # one row for each file, which the driver lists anyway
    files = written(rows.select("_file").distinct().withColumn("_n", F.row_number().over(Window.orderBy("_file")).cast("long")), "files")
    return rows.join(F.broadcast(files), "_file").select("_doc", F.shiftleft("_n", 32).bitwiseOR(F.col("_at")).alias("_key"))


def _has_places(docs: DataFrame) -> bool:
    """Whether rows are those of a table's files, each once, and the files tell their places."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return False
    try:
        return bool(docs.select(docs.metadataColumn("_metadata")["row_index"]).schema)
    except AnalysisException:
        return False


def picked(keys: DataFrame) -> tuple[bool, DataFrame]:
    """(whether it is small, the side of a join): thin rows of a written table are broadcast if they are MOST_BROADCAST at most, and else merged."""
    small = keys.count() <= MOST_BROADCAST
    return small, F.broadcast(keys) if small else keys.hint("merge")


def partitions(df: DataFrame) -> int:
    """Spark's number of shuffle partitions; where it is given, they aren't coalesced, so that no task holds many rows."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def plain_texts(texts: pa.Array) -> pa.Array:
    """Texts with nulls as empty ones, in one array."""
    return (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).fill_null("")


def chunks(batches, column: str | int = "text", limit: int = CHUNK_BYTES):
    """Arrow batches cut by rows so that each holds about `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def give_back() -> None:
    """Gives memory that a worker no longer uses back to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    got = batch.column(batch.schema.get_field_index(name))
    return got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, code of each word in order, offsets by text) of strings without nulls."""
    lists = pa.compute.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    full = np.asarray(pa.compute.binary_length(flat)) > 0  # a leading or trailing blank gives an empty piece
    if not full.all():
        kept = np.concatenate([[0], np.cumsum(full)])
        flat, offsets = flat.filter(pa.array(full)), kept[offsets]
    coded = flat.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices, dtype=np.int64), offsets


def worker_cache(name: str) -> dict:
    """A dict that lives as long as this Python worker, so that tasks in it share what they have learnt."""
    home = sys.modules.setdefault("_pairloom_worker_cache", types.ModuleType("_pairloom_worker_cache"))
    return home.__dict__.setdefault(name, {})


def forget_caches(but: str = "") -> None:
    """Gives back what other operators have left in this Python worker, which outlives their tasks; for tasks that need the room.

    `but` is a cache that stays. What is garbage in cycles, and free memory that the worker holds, goes even where no cache is.
    """
    home = sys.modules.get("_pairloom_worker_cache")
    for name in [n for n in vars(home) if not n.startswith("__") and n != but] if home else []:
        del home.__dict__[name]
    gc.collect()
    give_back()


class Kept:
    """A bounded cache in two generations: what was used since the younger one began survives its end."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start..start+length of each run, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def _fitted(held: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """held with `more` after its first `used` items, in a longer array where there is no room."""
    while used + len(more) > len(held):
        held = np.concatenate([held, held * 0])
    held[used : used + len(more)] = more
    return held


class Runs:
    """Runs of ids: place of a word, start and size of the run at a place."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.start, self.size, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0
        self.data = np.zeros(8192, np.uint32)

    def places(self, words: list[str]) -> np.ndarray:
        """The place of each word, -1 if it has none."""
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))

    def extend(self, words: list[str], data: np.ndarray, sizes: np.ndarray) -> None:
        """Adds new words with their ids one after the other."""
        k = len(self.place)
        self.start = _fitted(self.start, k, self.used + np.cumsum(sizes) - sizes)
        self.size = _fitted(self.size, k, sizes)
        self.data = _fitted(self.data, self.used, data)
        self.used += len(data)
        self.place.update(zip(words, range(k, k + len(words)), strict=True))


class RunCache:
    """Ids of words in two generations of at most about `most` words: what was used since the younger one began survives its end."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, Runs(), Runs()

    def runs_of(self, words: list[str], encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start of each word's run in them, its size); encode gives the ids of a list of new words."""
        if len(self.young.place) > self.most or self.young.used > 16 * self.most:
            self.young, self.old = Runs(), self.young
        young, old = self.young, self.old
        place = young.places(words)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            asked = list(dict.fromkeys([words[i] for i in missing.tolist()]))
            before = old.places(asked)
            known = np.flatnonzero(before >= 0)
            if len(known):
                starts, sizes = old.start[before[known]], old.size[before[known]]
                young.extend([asked[i] for i in known.tolist()], old.data[gather(starts, sizes)], sizes)
            if len(known) < len(asked):
                new = [asked[i] for i in np.flatnonzero(before < 0).tolist()]
                runs = encode(new)
                sizes = np.fromiter(map(len, runs), np.int64, len(runs))
                young.extend(new, np.fromiter(chain.from_iterable(runs), np.uint32, int(sizes.sum())), sizes)
            place[missing] = young.places([words[i] for i in missing.tolist()])
        return young.data, young.start[place], young.size[place]


def tokenizer_path(name: str) -> str:
    """Default place of a public vocabulary file; every operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
