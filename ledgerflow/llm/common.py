"""Helpers shared by the operators of this package: the shared folder, staging, and vectorised tokenising."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII A-Z lower-cased and nothing else, as the contracts of the queries say
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LOWER_BYTES = np.arange(256, dtype=np.uint8)
_LOWER_BYTES[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_IS_LETTER = np.zeros(256, dtype=bool)
_IS_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
# an odd multiplier and its inverse modulo 2^64: prefix hashes can be shifted back to a common origin
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only where it is unset and the master is local."""
    from ledgerflow.session import checkpoint_dir

    return checkpoint_dir(spark).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_at(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """As ``staged``, and the folder, for ``discard`` when nothing reads it any more."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that this package wrote."""
    from ledgerflow.sources.files import remove_path

    remove_path(spark, path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame hasn't, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(col):
    return F.translate(col, UPPER, LOWER)


def input_bytes(df: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of a text column: one row to the driver."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]


def next_pow2(n: int) -> int:
    return 1 << max(0, int(n) - 1).bit_length()


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["p"]) < n:
        size = next_pow2(n)
        for k, b in (("p", _BASE), ("i", _BASE_INV)):
            f = np.full(size, b, np.uint64)
            f[0] = 1
            _POWERS[k] = np.cumprod(f, dtype=np.uint64)
    return _POWERS["p"], _POWERS["i"]


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of many texts as arrays, in text order.

    hash: 64-bit hash of each word's bytes; doc: index of its text; start, end: byte positions in ``buf``;
    first: index of each text's first word (len(texts) + 1 entries). A null text has no word.
    With ``letters``, a word is a run of ASCII letters, digits and bytes of other characters instead, so that marks
    around a word don't count.
    """

    def __init__(self, texts: list, lower: bool = False, letters: bool = False):
        parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        buf = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
        if lower:
            buf = _LOWER_BYTES[buf]
        word = _IS_LETTER[buf] if letters else ~_IS_SPACE[buf]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if len(word) and word[0]:
            edge = np.concatenate(([0], edge))
        self.buf, self.start, self.end = buf, edge[0::2], edge[1::2]
        ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
        self.first = np.concatenate(([0], np.searchsorted(self.start, ends))).astype(np.int64)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.byte_ends = ends
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        """Polynomial prefix hashes modulo 2^64 in blocks, each word's moved to origin 0, then mixed."""
        out = np.empty(len(self.start), np.uint64)
        lo, step = 0, 1 << 18
        with np.errstate(over="ignore"):
            while lo < len(self.start):
                base = self.start[lo]
                hi = max(lo + 1, int(np.searchsorted(self.end, base + step, "right")))
                seg = self.buf[base : self.end[hi - 1]].astype(np.uint64) + np.uint64(1)
                p, inv = _powers(len(seg) + 1)
                pre = np.concatenate((np.zeros(1, np.uint64), np.cumsum(seg * p[: len(seg)], dtype=np.uint64)))
                s, e = self.start[lo:hi] - base, self.end[lo:hi] - base
                out[lo:hi] = mix64((pre[e] - pre[s]) * inv[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                lo = hi
        return out

    def code_points(self) -> np.ndarray:
        """Code points of each word: its bytes that don't continue a UTF-8 sequence."""
        lead = np.concatenate(([0], np.cumsum((self.buf & 0xC0) != 0x80)))
        return lead[self.end] - lead[self.start]
