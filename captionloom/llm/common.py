"""What the operators of this subpackage share: shared-folder tables and numpy views of words."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy pass looks at; a longer document is one pass of its own.
SLICE = 1 << 19


_own_folders: dict[str, str] = {}
_scope: contextvars.ContextVar[str] = contextvars.ContextVar("scope", default="")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only where it is unset and everything runs in
    one process, as in tests, a folder of our own; on a cluster without it, an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        sc = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _own_folders.setdefault(sc.applicationId, "") or tempfile.mkdtemp(prefix="spark-shared-")
        _own_folders[sc.applicationId] = at
    return at.rstrip("/")


def cut(df: DataFrame, lasting: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends, and a lost executor costs a reread.

    The table stays until the folder is cleared, or until the end of the scratch() that this is called in, unless lasting.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{'' if lasting else _scope.get()}{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut inside are deleted at the end: what is wanted of them must be written by then."""
    token = _scope.set(f"{uuid.uuid4().hex}/")
    try:
        yield
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tables/{_scope.get()}")
        _scope.reset(token)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of steps whose results are tables by now, where the session has a handle on its
    JVM; elsewhere Spark's cleaner does it some time later."""
    gc.collect()
    if jvm := getattr(getattr(spark, "_sc", None), "_jvm", None):
        jvm.System.gc()


#: Parts that the rows of one key are dealt to wherever a key may hold a large share of all rows.
SALTS = 64


def salt(*unit: str) -> Column:
    """The part of its key that a row belongs to."""
    return F.pmod(F.xxhash64(*unit), F.lit(SALTS)).cast("int")


def salts_of(salt_col: Column | str) -> Column:
    """Aggregate: the parts that a key has rows in, as the bits of a long. Combined before the shuffle, like a sum."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt_col))


def per_salt(groups: DataFrame, mask: str = "salts", name: str = "salt") -> DataFrame:
    """One row for each part that a key has rows in, so that a join on key and part puts no key's rows in one task."""
    parts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.getbit(mask, k) == 1)
    return groups.withColumn(name, F.explode(parts)).drop(mask)


def beside(rows: DataFrame, key: list[str], unit: list[str], having: str | None = None, **sums: Column) -> DataFrame:
    """rows with aggregates of their key beside them, and only those whose key fits `having`.

    As a window over the key would give, but the rows of no key meet in one task: aggregates are combined before the
    shuffle, and come back once per part of the key. rows should be a table; it is read twice.
    """
    dealt = rows.withColumn("_salt", salt(*unit))
    groups = dealt.groupBy(*key).agg(*[c.alias(n) for n, c in sums.items()], salts_of("_salt").alias("_salts"))
    groups = groups.where(having) if having else groups
    return dealt.join(per_salt(groups, "_salts", "_salt"), [*key, "_salt"]).drop("_salt")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Key of a row: rows that repeat both id and text are one unit, rows that share only the id are not."""
    return [F.col(id_col).alias("k_id"), F.xxhash64(F.col(text_col)).alias("k_text")]


def quoted(name: str) -> str:
    """A column's name as an expression, whatever it holds: dots are no fields."""
    return f"`{name.replace('`', '``')}`"


def same_key(a: DataFrame, b: DataFrame, names: Iterable[str] = ("k_id", "k_text")) -> Column:
    """Join condition that also matches null keys."""
    return functools.reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in names])


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


BASE = 0x9E3779B97F4A7C15 | 1
BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
IS_WORD = np.ones(256, bool)
IS_WORD[list(WS.encode())] = False
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


@functools.cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n, inverse = 1 << bits, pow(BASE, -1, 1 << 64)
    both = []
    for b in (BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    return _powers(max(12, int(n).bit_length()))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums: span_hash() reads any span's hash off them."""
    up, _ = powers(len(data))
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE_HASH[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def utf8_of(texts: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 of an Arrow batch's texts, a few at a time and without decoding them: a batch is not copied as a whole."""
    for at in range(0, len(texts), 256):
        yield from texts.slice(at, 256).cast(pa.binary()).to_pylist()


def give_back() -> None:
    """Return freed memory to the system: Python workers live on and serve later stages beside other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def slices(texts: Iterable, most: int = SLICE) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, UTF-8 texts) of consecutive groups of about `most` bytes, 32,768 texts at most; null is empty."""
    held: list[bytes] = []
    first = size = 0
    for i, t in enumerate(texts):
        b = t if isinstance(t, bytes) else t.encode("utf-8", "replace") if isinstance(t, str) else b""
        if held and (size + len(b) > most or len(held) >= 1 << 15):
            yield first, held
            held, size = [], 0
        if not held:
            first = i
        held.append(b)
        size += len(b) + 1
    if held:
        yield first, held


class Words:
    """The words of a slice of texts as arrays: start, end, doc; data holds the texts joined by a line feed."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.data = TO_LOWER[data] if lower else data
        self.n_docs = len(texts)
        self.doc_start = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.doc_start[1:])
        inside = IS_WORD[data]
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        self.start, self.end = edge[::2], edge[1::2]
        self.doc = np.searchsorted(self.doc_start, self.start, side="right") - 1
        self.n_words = np.bincount(self.doc, minlength=self.n_docs)

    def hashes(self) -> np.ndarray:
        return span_hash(prefix_hash(self.data), self.start, self.end)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index of the first word) of every window of `width` words inside one document."""
        h = self.hashes()
        n = len(h) - width + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        total = np.zeros(n, np.uint64)
        for j in range(width):
            total = total * np.uint64(0x9FB21C651E98DF25) + h[j : j + n]
        first = np.flatnonzero(self.doc[:n] == self.doc[width - 1 :])
        return mix(total[first]), first
