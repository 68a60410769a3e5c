"""64-bit FNV-1a hashes of words, salted or not, as Arrow functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values of the published FNV-1a algorithm.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MASK = (1 << 64) - 1


def hash64(data: bytes) -> int:
    h = FNV_START
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & MASK
    return h


def hash_many(values: list[bytes]) -> np.ndarray:
    """``hash64`` of many values, a byte of all of them at a time; those that have ended drop out."""
    order = np.array(sorted(range(len(values)), key=lambda i: -len(values[i])), np.int64)
    sizes = np.array([len(values[i]) for i in order], np.int64)
    data = np.frombuffer(b"".join(values[i] for i in order), np.uint8).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    h = np.full(len(values), FNV_START, np.uint64)
    for at in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(-sizes, -at, side="left"))  # values longer than ``at`` come first
        h[:n] = (h[:n] ^ data[starts[:n] + at]) * np.uint64(FNV_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


def word_hashes(salt: int, words: list[str]) -> list[str]:
    """``word_hash`` of many words."""
    front = salt.to_bytes(8, "big")
    return [f"{h:x}" for h in hash_many([front + w.encode() for w in words]).tolist()]


def word_hash(salt: int, word: str) -> str:
    return f"{hash64(salt.to_bytes(8, 'big') + word.encode()):x}"


def salted(word: Column, salt: int) -> Column:
    @F.pandas_udf(StringType())
    def run(words: pd.Series) -> pd.Series:
        held = words.dropna()
        return pd.Series(word_hashes(salt, list(held)), index=held.index, dtype=object).reindex(words.index).where(words.notna(), None)

    return run(word)
