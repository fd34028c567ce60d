"""What the operators share: tables, materialised intermediates, words and word hashes."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: A word: a run of anything but ASCII white space (space, tab, line feed, VT, FF, CR).
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
WORD = re.compile(WORD_PATTERN)
#: Java's spelling of the same class, for SQL functions.
SPACE_JAVA = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset (tests on one machine) a temporary folder takes its place.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = os.path.join(tempfile.gettempdir(), "llm-checkpoints")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Bytes of a batch that Spark hands to Python. Its own default is eight times that, and a task holds a batch several times over.
BATCH_BYTES = "8388608b"
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def lean(spark: SparkSession) -> None:
    """Keeps Arrow batches small, unless the session has a size of its own."""
    if spark.conf.get(_BATCH_CONF, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_CONF, BATCH_BYTES)


def released(run):
    """``run`` (a function of Arrow batches) such that its task's memory goes back to the machine when it ends.

    Spark keeps idle Python workers; without this they hold what their largest task took while other stages run.
    """

    def held(batches):
        import ctypes
        import gc

        import pyarrow

        yield from run(batches)
        gc.collect()
        pyarrow.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library, which trims on its own

    return held


class Scratch:
    """Parquet tables in the shared folder that cut lineage; ``drop`` removes them again.

    A lost executor loses nothing that was written here. Tables that a returned (lazy) result still
    reads are left in place for the cluster to clear with its checkpoint folder.
    """

    def __init__(self, spark: SparkSession):
        lean(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Writes df and reads it back; the copy's ``scratch_path`` names it for ``drop``."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bucket_of(doc_id, modulus: int):
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus if isinstance(doc_id, str) else F.crc32(doc_id.cast("string")) % modulus


def boxed(docs: DataFrame, **more: Column) -> DataFrame:
    """``row``, a struct of all columns of docs as they are, beside named expressions: no name of theirs can clash with docs'."""
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return docs.select(F.struct(*quoted).alias("row"), *(x.alias(n) for n, x in more.items()))


def slots(spark: SparkSession, least: int = 1) -> int:
    """Shuffle partitions of the session."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def word_hash(word: str) -> int:
    """A stable 64-bit hash of one word, as unsigned int."""
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


class WordHashes(dict):
    """word -> hash, computed once for each word; emptied when it has grown large."""

    LIMIT = 500_000

    def __missing__(self, word: str) -> int:
        h = self[word] = word_hash(word)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words in order; the whole text as one if it is shorter (none if empty)."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - n + 1 + i]
        out ^= out >> np.uint64(29)
    return mix64(out)


#: Characters of text that Python code handles at once; a longer single text is handled on its own.
CHUNK_CHARS = 2_000_000


def chunks(texts: list, most: int = CHUNK_CHARS):
    """(first, end) of runs of texts of bounded length in all; a single long text is a run of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def map_texts(docs: DataFrame, keep: list[str], make, out: str, most: int = CHUNK_CHARS) -> DataFrame:
    """keep columns of docs beside what Python finds in ``text``, by Arrow batches.

    ``make()`` is called once a task and gives a function of a list of texts (a null is empty), which
    returns (rows, columns): for each row of the result the text it stems from (None: one row a text),
    and Arrow arrays in the order of the DDL ``out``. Kept columns pass through as they are, nulls too.
    """
    import pyarrow as pa

    lean(docs.sparkSession)
    place = keep.index("text") if "text" in keep else len(keep)

    def run(batches):
        find = make()
        for b in batches:
            texts = [t or "" for t in b.column(place).to_pylist()]
            for i, j in chunks(texts, most):
                rows, columns = find(texts[i:j])
                kept = [b.column(k).slice(i, j - i) for k in range(len(keep))]
                if rows is not None:
                    kept = [c.take(pa.array(rows, pa.int64())) for c in kept]
                yield pa.RecordBatch.from_arrays([*kept, *columns], names=names)

    found = T.StructType.fromDDL(out)
    schema = T.StructType([*(docs.schema[k] for k in keep), *found.fields])
    names = schema.names
    return docs.select(*keep, *["text"][: place == len(keep)]).mapInArrow(released(run), schema)


#: Bits of a sieve: 4 MB, whatever the number of keys. A full sieve lets all rows through.
SIEVE_BITS = 25


def sieve(keys: DataFrame):
    """A function that adds a flag to a DataFrame: false where the column surely holds none of the keys.

    ``keys`` has one long column. Its hashes set bits in bitmaps of a fixed size, which are broadcast; so rows that no key
    can match needn't be shuffled to find that out.
    """

    def place(c):
        return F.pmod(F.xxhash64(c, F.lit("sieve")), F.lit(1 << SIEVE_BITS))

    p = place(F.col(keys.columns[0]))
    bits = F.broadcast(keys.groupBy(F.bitmap_bucket_number(p).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias("_bitmap")))

    def flagged(df: DataFrame, column: str, flag: str) -> DataFrame:
        at = F.bitmap_bit_position(place(F.col(column)))
        byte = F.conv(F.hex(F.substring(F.col("_bitmap"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        bit = F.floor(byte / F.pow(F.lit(2.0), F.pmod(at, F.lit(8)))) % 2 == 1
        d = df.join(bits, F.bitmap_bucket_number(place(F.col(column))) == F.col("_bucket"), "left")
        return d.withColumn(flag, F.coalesce(bit, F.lit(False))).drop("_bucket", "_bitmap")

    return flagged
