"""Reproducible shuffle and sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelith.llm._common import number_rows, ship, table


@dataclass(frozen=True)
class Feistel:
    """A permutation of 0..n-1: a balanced Feistel network over the next power of four, walked until it is back below n."""

    n: int
    seed: int = 0
    rounds: int = 6

    @property
    def half(self) -> int:
        return max(1, (max(self.n - 1, 1).bit_length() + 1) // 2)

    def _f(self, x: np.ndarray, r: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            z = x + np.uint64((self.seed * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % 2**64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return (z ^ (z >> np.uint64(31))) & np.uint64((1 << self.half) - 1)

    def _pass(self, x: np.ndarray, back: bool) -> np.ndarray:
        bits, low = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> bits, x & low
        for r in reversed(range(self.rounds)) if back else range(self.rounds):
            if back:
                left, right = right ^ self._f(left, r), left
            else:
                left, right = right, left ^ self._f(right, r)
        return (left << bits) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._pass(np.asarray(x, dtype=np.uint64), back)
        todo = np.flatnonzero(out >= self.n)
        while todo.size:
            out[todo] = self._pass(out[todo], back)
            todo = todo[out[todo] >= self.n]
        return out.astype(np.int64)

    def place(self, row_no: np.ndarray) -> np.ndarray:
        return self._walk(row_no, False)

    def row_at(self, place: np.ndarray) -> np.ndarray:
        return self._walk(place, True)


def locate(row_no: int, n: int, n_shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number, without any table."""
    return divmod(int(Feistel(n, seed).place(np.array([row_no]))[0]), n_shards)[::-1]


def row_of(shard: int, slot: int, n: int, n_shards: int, seed: int = 0) -> int:
    """The row number that is at a shard's slot; the inverse of locate()."""
    return int(Feistel(n, seed).row_at(np.array([slot * n_shards + shard]))[0])


def shuffle_shards(df: DataFrame, n_shards: int, seed: int = 0) -> DataFrame:
    """Rows of df with row_no, shard and slot. Counts of shards differ by one at most; slots are gapless from 0.

    A row's number depends on the rows' values only (see number_rows), its place on the number, the
    count of rows and the seed. Nulls are values like others; equal rows get numbers of their own; an
    empty table gives an empty one. Columns that clash with row_no, shard or slot are replaced.
    """
    df = df.drop("row_no", "shard", "slot")
    ship(df.sparkSession)
    n = df.count()
    walk = Feistel(n, seed)

    @F.pandas_udf("long")
    def place(row_no: pd.Series) -> pd.Series:
        return pd.Series(walk.place(row_no.to_numpy()))

    numbered = number_rows(df, rows=n)
    at = place("row_no")
    both = F.struct(F.pmod(at, F.lit(n_shards)).cast("int").alias("shard"), F.floor(at / n_shards).cast("long").alias("slot"))
    return numbered.select(*[F.col(f"`{c}`") for c in numbered.columns], both.alias("place of the row")).select(*[F.col(f"`{c}`") for c in numbered.columns], "`place of the row`.*")


def op3_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    out = shuffle_shards(rows, 24, seed=2024)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no")
