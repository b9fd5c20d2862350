"""Helpers shared by the operators: shared-folder tables, word splitting, hashing, blocks."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ersa.session import shared_dir

U64 = np.uint64
#: Uncompressed text bytes of one block; a longer document is a block of its own.
BLOCK_BYTES = 4 << 20


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts lineage, survives lost executors).

    The write's own shuffle files are given up as soon as it has ended, as nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ersa_llm/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names; a null text is empty."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


# ---- hashing -----------------------------------------------------------------------------

_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_GOLD = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def pair_name(a: np.ndarray, b: np.ndarray, salt: int = 1) -> np.ndarray:
    """A name for the ordered pair of names (a, b)."""
    return mix(a * U64(0xD6E8FEB86659FD93) + mix(b + U64(salt) * _GOLD))


# ---- words as arrays ---------------------------------------------------------------------

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_rng = np.random.default_rng(20240301)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C55)


def _powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), _BASE, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of a byte array."""
    inside = np.empty(len(buf) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(_SEP[buf], out=inside[1:-1].view(bool))
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit name per word, a function of its bytes alone (A-Z folded if ``lower``)."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    b = _LOWER[buf] if lower else buf
    length = ends - starts
    at = np.arange(len(buf), dtype=np.int64)
    at -= np.repeat(np.concatenate(([0], starts[1:])), np.diff(np.concatenate(([0], starts[1:], [len(buf)]))))
    table = _powers(int(length.max()))
    within = at < np.repeat(length, np.diff(np.concatenate(([0], starts[1:], [len(buf)]))))
    within &= at >= 0
    if starts[0]:
        within[: starts[0]] = False
        at[: starts[0]] = 0
        first = slice(starts[0], starts[1] if len(starts) > 1 else len(buf))
        at[first] = np.arange(first.stop - first.start)
        within[first] = at[first] < length[0]
    at[~within] = 0
    value = _BYTE[b] * table[at]
    value[~within] = 0
    return mix(np.add.reduceat(value, starts) + length.astype(np.uint64) * _GOLD)


def split_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One byte array of all texts, each followed by a line break, and the texts' start offsets (n+1)."""
    buf = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return buf, offsets


def doc_words(texts: list[bytes], lower: bool = False):
    """Words of many texts at once: (buf, starts, ends, hashes, first word index per text (n+1))."""
    buf, offsets = split_rows(texts)
    if not len(buf):
        empty = np.zeros(0, dtype=np.int64)
        return buf, empty, empty, np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    starts, ends = word_spans(buf)
    return buf, starts, ends, word_hashes(buf, starts, ends, lower), np.searchsorted(starts, offsets)


def spark_salt(*cols: str, n: int) -> F.Column:
    """A deterministic number from 0 to n-1 from row content, so a retried task repeats it."""
    return F.pmod(F.xxhash64(*cols), F.lit(n))
