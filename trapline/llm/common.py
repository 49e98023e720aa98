"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EMPTY = np.zeros(0, dtype=np.int64)
SLAB = 1 << 18  # bytes hashed at a time


@contextmanager
def uncollected():
    """Keeps the collector of cycles from walking large tables of strings again and again; nothing inside makes cycles."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def free_name(wanted: str, taken: list[str]) -> str:
    """A column name that is not taken, whatever the case of its letters."""
    used = {c.lower() for c in taken}
    while wanted.lower() in used:
        wanted = f"_{wanted}"
    return wanted


def digest(column: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(column))


def chunks(batch: pa.RecordBatch, column: str, budget: int = 2 << 20, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``rows`` texts that hold about ``budget`` bytes; a longer text comes alone."""
    sizes = np.asarray(batch.column(column).cast(pa.large_binary()).fill_null(b"").to_numpy(zero_copy_only=False), dtype=object)
    ends = np.cumsum([len(x) for x in sizes]) if len(sizes) else EMPTY
    at, done = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, min(at + rows, int(np.searchsorted(ends, done + budget, side="right"))))
        yield batch.slice(at, to - at)
        at, done = to, int(ends[to - 1])


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in a row, and where each text begins (plus the end)."""
    parts = [x.encode() if x else b"" for x in texts.to_pylist()]
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in parts], out=starts[1:])
    return np.frombuffer(b"".join(parts), dtype=np.uint8), starts


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; equal stays equal, different stays different."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


@lru_cache(maxsize=2)
def _powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(_BASE, n), powers(_BASE_INVERSE, n + 1)


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(data)
    up, down = _powers_for(SLAB) if n <= SLAB else (powers(_BASE, n), powers(_BASE_INVERSE, n + 1))
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span; spans are in order.

    A hash does not depend on where its span lies, so about ``SLAB`` bytes are looked at
    at a time and memory follows the longest span, not the data.
    """
    out = np.zeros(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + SLAB, side="right")))
        out[at:to] = _hash_spans(data[low:int(ends[to - 1])], starts[at:to] - low, ends[at:to] - low)
        at = to
    return out


_WORD = np.zeros(256, dtype=bool)
_WORD[ord("0"):ord("9") + 1] = _WORD[ord("a"):ord("z") + 1] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


class Words:
    """Words of a run of texts: A-Z lower-cased, digits, a-z and everything beyond ASCII.

    ``doc`` has the place of each word's text in the batch, ``first`` each text's
    first word (plus the end), ``hash`` 64 bits for each word.
    """

    def __init__(self, texts: pa.Array):
        raw, bounds = flat_bytes(texts)
        self.data = _LOWER[raw]
        inside = np.zeros(len(raw) + 1, dtype=bool)
        inside[:-1] = _WORD[self.data]
        begins = inside[:-1].copy()
        begins[1:] &= ~inside[:-2]
        edges = bounds[(bounds > 0) & (bounds < len(raw))]
        begins[edges] = inside[edges]
        stops = inside[:-1] & ~inside[1:]
        stops[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = span_hashes(self.data, self.start, self.end)

    def words(self, begin: int, end: int) -> list[str]:
        data = self.data
        return [data[s:e].tobytes().decode() for s, e in zip(self.start[begin:end], self.end[begin:end])]

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they lie in one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = np.zeros(n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                out = out * np.uint64(_BASE) + self.hash[j:j + n]
        return mix(out), self.doc[:n] == self.doc[k - 1:]
