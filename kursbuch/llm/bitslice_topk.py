"""Exact top-k search over a bit-sliced index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import stage

#: Scaled components from this size on are wide: they do not enter the index, whose sums are of 64 bits.
WIDE = float(1 << 22)
#: Rows of a block of the index, and what a block has at least where they are few.
ROWS, FEW_ROWS = 32_768, 8192
#: Slices of the quantised attributes that are added up; the rest is resolved on whole values.
SLICES = 7


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


class BitSlicedIndex:
    """Vertical bitmaps of a block of integer vectors: slice b of attribute d has a bit for each row.

    Attributes are shifted to begin at 0 and quantised to their ``slices`` highest bits."""

    def __init__(self, values: np.ndarray, slices: int = SLICES):
        self.values = values
        self.rows, self.dims = values.shape
        self.low = values.min(0) if self.rows else np.zeros(self.dims, np.int64)
        shifted = values - self.low
        self.width = max(1, int(shifted.max(initial=0)).bit_length())
        self.kept = min(slices, self.width)
        self.shift = self.width - self.kept
        top = (shifted >> self.shift).astype(np.uint64)
        words = -(-self.rows // 64)
        padded = np.zeros((words * 64, self.dims), np.uint64)
        padded[: self.rows] = top
        bits = np.empty((self.dims, self.kept, words), np.uint64)
        for b in range(self.kept):
            plane = ((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
            bits[:, b] = np.ascontiguousarray(np.packbits(plane.T, axis=1, bitorder="little")).view(np.uint64)
        #: The slices and their complements.
        self.bits = np.stack([bits, ~bits], 1)
        valid = np.zeros(words * 64, np.uint8)
        valid[: self.rows] = 1
        self.valid = np.packbits(valid, bitorder="little").view(np.uint64)

    def scores(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices, lowest first, of the sum over attributes of |weight| times the quantised value.

        For a negative weight the value is counted from its upper end instead: the complement
        of its slices. A weight's set bits say to which places of the sum a slice is added; each
        place's bitmaps are reduced by full adders, three to a sum and a carry."""
        sizes = np.abs(weights)
        places: list[list[np.ndarray]] = []
        for at in range(int(sizes.max(initial=0)).bit_length()):
            chosen = np.flatnonzero((sizes >> at) & 1)
            if not len(chosen):
                continue
            block = self.bits[chosen, (weights[chosen] < 0).astype(np.int64)]
            for b in range(self.kept):
                while len(places) <= at + b:
                    places.append([])
                places[at + b].append(block[:, b])
        out, p = [], 0
        while p < len(places):
            maps = np.concatenate(places[p]) if places[p] else np.zeros((1, len(self.valid)), np.uint64)
            while len(maps) > 1:
                n = len(maps) // 3
                if n:
                    a, b, c = maps[:n], maps[n : 2 * n], maps[2 * n : 3 * n]
                    half = a ^ b
                    carry = a & b
                    carry |= half & c
                    np.bitwise_xor(half, c, out=maps[2 * n : 3 * n])
                    maps = maps[2 * n :]
                else:
                    carry, maps = maps[:1] & maps[1:2], maps[:1] ^ maps[1:2]
                if p + 1 == len(places):
                    places.append([])
                places[p + 1].append(carry)
            out.append(maps[0])
            p += 1
        return out

    def top(self, weights: np.ndarray, k: int, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, score) of the rows that can be among the k best, exactly scored, best first.

        From the highest slice down the rows are narrowed to those that decide place k; that
        gives the k-th largest quantised score. A row's true score is at most the lost low
        bits above its quantised one, so rows further below are out; the boundary rows that
        remain are scored on their whole values."""
        alive = self.valid if mask is None else self.valid & mask
        slices = self.scores(weights)
        left, need, least = alive.copy(), k, 0
        for b in range(len(slices) - 1, -1, -1):
            ones = left & slices[b]
            n = int(np.bitwise_count(ones).sum())
            if n >= need:
                left, least = ones, least | 1 << b
            else:
                need -= n
                left = left & ~slices[b]
        lost = int(np.abs(weights).sum()) * ((1 << self.shift) - 1)
        floor = max(0, least - (-(-lost // (1 << self.shift))))
        above, equal = np.zeros_like(alive), alive
        for b in range(max(len(slices), floor.bit_length()) - 1, -1, -1):
            s = slices[b] if b < len(slices) else np.zeros_like(alive)
            if floor >> b & 1:
                equal = equal & s
            else:
                above, equal = above | (equal & s), equal & ~s
        rows = np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), bitorder="little"))
        exact = self.values[rows] @ weights
        return rows, exact


def whole(x: float, scale: float) -> int:
    """floor(scale * x), also where the product is no finite double."""
    y = x * scale
    return math.floor(y) if math.isfinite(y) else math.floor(Fraction(x) * Fraction(scale))


def key_of(score: int) -> bytes:
    """Bytes in the order of scores where these do not fit 64 bits; one value for all that do."""
    if -(1 << 63) <= score < 1 << 63:
        return b"\x80"
    size = (abs(score).bit_length() + 7) // 8
    digits = size.to_bytes(2, "big") + abs(score).to_bytes(size, "big")
    return b"\xff" + digits if score > 0 else b"\x00" + bytes(255 - c for c in digits)


class WholeNumbers:
    """Vectors of Python ints. Doubles with a bound of their error say which rows can be among
    the best; these are scored exactly."""

    def __init__(self, values: list[list[int]]):
        self.values = values
        self.floats = self._floats(values)

    @staticmethod
    def _floats(values: list[list[int]]) -> np.ndarray | None:
        """Divided by a power of two so that none is above 1; None if doubles do not hold them."""
        bits = max((abs(x).bit_length() for v in values for x in v), default=0)
        return np.ldexp(np.array(values, np.float64), -bits) if bits <= 1000 else None

    def top(self, weights: list[int], k: int, skip: np.ndarray) -> list[tuple[int, int]]:
        """(row, score) of the rows, without ``skip``, that can be among the k best."""
        rows = np.flatnonzero(~skip)
        w = self._floats([weights])
        if self.floats is not None and w is not None and len(rows) > k:
            about = self.floats[rows] @ w[0]
            # the last term stands for what is lost where products are too small for a double
            off = (np.abs(self.floats[rows]) @ np.abs(w[0])) * ((len(weights) + 4) * 2.0**-51) + len(weights) * 2.0**-1000
            rows = rows[about + off >= np.partition(about - off, len(rows) - k)[len(rows) - k]]
        return [(int(r), sum(a * b for a, b in zip(self.values[r], weights, strict=True))) for r in rows]


class Block:
    """Rows of one length: those of ordinary components in a bit-sliced index, the wide ones as whole numbers."""

    def __init__(self, rows: pd.DataFrame, scale: float):
        rows = rows.sort_values("vec_id", kind="stable")
        self.rows, self.scale, self.every = rows, scale, None
        wide = rows["w"].notna().to_numpy()
        self.ids = rows["vec_id"].to_numpy(np.int64)
        self.near, self.far = self.ids[~wide], self.ids[wide]
        self.index = BitSlicedIndex(np.stack([np.asarray(v, np.int64) for v in rows["v"][~wide]])) if len(self.near) else None
        self.far_rows = WholeNumbers([self._ints(None, w) for w in rows["w"][wide]])

    def _ints(self, v, w) -> list[int]:
        return [int(x) for x in v] if w is None else [whole(float(x), self.scale) for x in w]

    def best(self, q: int, v, w, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows for one query. A query of ordinary components meets such rows in the
        index; every other pair is scored on whole numbers."""
        if w is not None:
            if self.every is None:
                self.every = WholeNumbers([self._ints(a, b) for a, b in zip(self.rows["v"], self.rows["w"], strict=True)])
            hits = [(int(self.ids[r]), s) for r, s in self.every.top(self._ints(v, w), k, self.ids == q)]
        else:
            hits = []
            if self.index is not None:
                mask = None
                lo, hi = np.searchsorted(self.near, q), np.searchsorted(self.near, q, "right")
                if hi > lo:
                    own = np.ones(len(self.index.valid) * 64, np.uint8)
                    own[lo:hi] = 0
                    mask = np.packbits(own, bitorder="little").view(np.uint64)
                at, score = self.index.top(np.asarray(v, np.int64), k, mask)
                first = np.lexsort((self.near[at], -score))[:k]
                hits = [(int(self.near[at[i]]), int(score[i])) for i in first]
            if len(self.far):
                hits += [(int(self.far[r]), s) for r, s in self.far_rows.top(self._ints(v, w), k, self.far == q)]
        return sorted(hits, key=lambda h: (-h[1], h[0]))[:k]


def _answers(batches: Iterator[pd.DataFrame], k: int, scale: float) -> Iterator[pd.DataFrame]:
    """Rows sorted by block, length and role: a block's vectors come first and are indexed once, then its
    queries stream by. Only one block is held."""
    at, held, block = None, [], None
    for pdf in batches:
        found: list[tuple[int, int, int | None, bytes]] = []
        for key, part in pdf.groupby(["rb", "dims", "asks"], sort=False):
            if key[:2] != at:
                at, held, block = key[:2], [], None
            if not key[2]:
                held.append(part)
                continue
            if block is None and held:
                block, held = Block(pd.concat(held), scale), []
            if block is None:
                continue
            for q, v, w in zip(part["vec_id"], part["v"], part["w"], strict=True):
                for i, s in block.best(int(q), v, w, k):
                    size = key_of(s)
                    found.append((int(q), i, s if size == b"\x80" else None, size))
        # column by column: a frame of rows would make doubles of scores beside a null
        columns = list(zip(*found, strict=True)) or [()] * 4
        types = {"query_id": "int64", "vec_id": "int64", "score": "Int64", "size": "object"}
        yield pd.DataFrame({c: pd.array(list(x), dtype=t) if t == "Int64" else pd.Series(list(x), dtype=t) for (c, t), x in zip(types.items(), columns, strict=True)})


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query.

    Components become floor(scale * x). Vectors that are null, hold a null or a non-finite
    component, or have no id, take no part. Large components are multiplied and ranked as whole
    numbers of any size; a score that does not fit 64 bits is given as null at its right rank. Ties go to the smaller
    id. A row is no candidate of a query with its own id; rows that repeat an id are
    candidates of others each by itself, repeated queries count once. Vectors of different
    lengths have no product and do not meet.

    Vectors are dealt by hash of the id into blocks, each vector to one; every block gets all queries, a
    given share of the table, after its vectors. So each block's index is built once and the queries
    stream by. A block gives its k best rows of a query, from which the overall ones are taken.
    """
    spark = vectors.sparkSession
    ship(spark)

    def ints(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        value = F.transform(v, lambda x: F.floor(x.cast("double") * float(scale)).cast("int"))
        wide = F.exists(v, lambda x: F.abs(x.cast("double") * float(scale)) >= WIDE)
        df = df.filter(usable(v) & F.col(id_col).isNotNull())
        return df.select(
            F.col(id_col).cast("long").alias("vec_id"),
            F.when(~wide, value).alias("v"),
            F.when(wide, v.cast("array<double>")).alias("w"),
            F.size(v).alias("dims"),
        )

    rows, asked = stage(ints(vectors), "vectors"), stage(ints(queries).dropDuplicates(["vec_id"]), "queries")
    n = rows.count()
    blocks = max(1, -(-n // ROWS), min(16, -(-n // FEW_ROWS)))
    dealt = rows.withColumn("rb", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("asks", F.lit(False))
    sent = asked.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(True))
    both = dealt.unionByName(sent).repartition(blocks, "rb").sortWithinPartitions("rb", "dims", "asks")
    best = both.mapInPandas(lambda batches: _answers(batches, k, float(scale)), "query_id long, vec_id long, score long, size binary")
    order = Window.partitionBy("query_id").orderBy(F.col("size").desc(), F.col("score").desc(), F.col("vec_id"))
    ranked = best.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
