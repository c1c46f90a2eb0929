"""Helpers shared by the operators: shared storage, tables, hashing of text with numpy."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a new local one where that is unset and all tasks run
    in the driver (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="corpusgraph-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again: survives the loss of executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blocks_of(rows: int, per_block: int) -> int:
    return max(1, -(-rows // per_block))


def uniform_key(*cols: Column | str, seed: int = 0) -> Column:
    """A 64-bit hash that differs with seed."""
    return F.xxhash64(F.lit(seed).cast("long"), *cols)


# --- words of many texts at once -------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_BASE = 0xD1342543DE82EF95
_BLOCK = 1 << 16


def _power_table(base: int) -> np.ndarray:
    factors = np.full(_BLOCK, base, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


_POW, _IPOW = _power_table(_BASE), _power_table(_inverse(_BASE))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _powers(table: np.ndarray, base: int, at: np.ndarray) -> np.ndarray:
    """base ** at mod 2**64 for positions beyond the table as well."""
    low = table[at & (_BLOCK - 1)]
    high = at >> 16
    top = int(high.max(initial=0))
    if top == 0:
        return low
    step = pow(base, _BLOCK, 1 << 64)
    steps = np.array([pow(step, i, 1 << 64) for i in range(top + 1)], np.uint64)
    return low * steps[high]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` of every text, A-Z lower-cased, in order; and the number of words of each text."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    with np.errstate(over="ignore"):
        at = np.arange(len(data), dtype=np.int64)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[_LOWER[data]] * _powers(_POW, _BASE, at), out=sums[1:])
        words = (sums[ends] - sums[starts]) * _powers(_IPOW, _inverse(_BASE), starts)
        words = mix64(words + (ends - starts).astype(np.uint64) * _ODD)
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])))
    return words, counts


def shingles(words: np.ndarray, counts: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-word shingles of each text (of all its words, where it has fewer than n), sorted
    within a text; and their number by text. A text without words has none."""
    sets = []
    first = np.concatenate([[0], np.cumsum(counts)])
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, len(words) - n + 1), np.uint64)
        factor = np.uint64(1)
        for i in range(n):
            full += words[i : i + len(full)] * factor
            factor = factor * np.uint64(_BASE)
        full = mix64(full)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= n:
                sets.append(np.unique(full[a : b - n + 1]))
            elif b > a:
                powers = _POW[: b - a]
                sets.append(mix64(np.array([(words[a:b] * powers).sum(dtype=np.uint64) + np.uint64(b - a) * _ODD])))
            else:
                sets.append(np.zeros(0, np.uint64))
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


def portions(texts: list[str | None], most: int = 1 << 19):
    """(first, last) of runs of texts with some `most` characters together, so that arrays over them stay small."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size > most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
