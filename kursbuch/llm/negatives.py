"""Hard negatives by product quantisation with stored residual norms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .bitslice_topk import FEW_ROWS, ROWS, WIDE, key_of, usable, whole
from .common import stage

#: Vectors on which the codebooks are fitted, codes of a book, dimensions of a part, and rounds of the fit.
SAMPLE, CODES, PART, ROUNDS = 4096, 256, 2, 6
#: Anchors whose tables are looked up together, and rows at a time.
ANCHORS, CHUNK = 64, 8192


def fit_codebooks(sample: np.ndarray, codes: int = CODES, seed: int = 7) -> list[np.ndarray]:
    """For each part of the dimensions, its centroids, rounded to whole numbers: k-means on the sample."""
    rng, books = np.random.default_rng(seed), []
    for at in range(0, sample.shape[1], PART):
        points = sample[:, at : at + PART].astype(np.float64)
        different = np.unique(points, axis=0)
        centers = different[rng.permutation(len(different))[:codes]]
        for _ in range(ROUNDS):
            nearest = _nearest(points, centers)
            many = np.bincount(nearest, minlength=len(centers))
            sums = np.stack([np.bincount(nearest, p, len(centers)) for p in points.T], 1)
            centers = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], centers)
        books.append(np.unique(np.rint(centers).astype(np.int64), axis=0))
    return books


def _nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (-2 * points @ centers.T + (centers**2).sum(1)).argmin(1)


class Quantised:
    """Rows of one length as codes and norms of what the codes leave out.

    Centroids are whole numbers, so a looked-up score is exact for the coded vector, and the true one is at most
    the product of the anchor's and the residual's norm away from it."""

    def __init__(self, values: np.ndarray, books: list[np.ndarray]):
        self.values, self.books = values, books
        self.codes = np.empty((len(books), len(values)), np.uint8)
        square = np.zeros(len(values))
        for m, book in enumerate(books):
            part = values[:, m * PART : m * PART + book.shape[1]]
            for at in range(0, len(values), CHUNK):
                self.codes[m, at : at + CHUNK] = _nearest(part[at : at + CHUNK].astype(np.float64), book.astype(np.float64))
            square += ((part - book[self.codes[m]]).astype(np.float64) ** 2).sum(1)
        self.residual = np.sqrt(square) * (1 + 1e-12)

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of every row (across) with each anchor (down)."""
        about = np.empty((len(anchors), len(self.values)))
        for at in range(0, len(self.values), CHUNK):
            total = 0.0
            for m, book in enumerate(self.books):
                table = book.astype(np.float64) @ anchors[:, m * PART : m * PART + book.shape[1]].astype(np.float64).T
                total = total + table[self.codes[m, at : at + CHUNK]]
            about[:, at : at + CHUNK] = np.asarray(total).T
        norm = np.sqrt((anchors.astype(np.float64) ** 2).sum(1)) * (1 + 1e-12)
        # products of parts are whole numbers below 2^53 but for wide sums: their rounding is far below one part in 2^40
        off = norm[:, None] * self.residual[None] + np.abs(about) * 2.0**-40 + 2.0**-20
        return about - off, about + off


class Block:
    """The rows of a block that have one length: quantised ones, and wide ones as Python's whole numbers."""

    def __init__(self, rows: pd.DataFrame, books: dict[int, list[np.ndarray]], scale: float):
        rows = rows.sort_values("vec_id", kind="stable")
        self.scale = scale
        wide = rows["w"].notna().to_numpy()
        self.ids, self.labels = rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
        self.near, self.far = np.flatnonzero(~wide), np.flatnonzero(wide)
        dims = int(rows["dims"].iloc[0])
        values = np.stack([np.asarray(v, np.int64) for v in rows["v"][~wide]]) if len(self.near) else np.zeros((0, dims), np.int64)
        self.index = Quantised(values, books.get(dims) or fit_codebooks(values[:SAMPLE])) if dims and len(values) else None
        self.values = values
        self.wide = [ints(None, w, scale) for w in rows["w"][wide]]

    def answers(self, anchors: list[dict], same: bool, k: int) -> Iterator[tuple[dict, int, list[tuple[int, int]]]]:
        """For each anchor and each of its windows (least and most of the hundredfold score) the k best rows of the
        same or of another label: (anchor, window, [(id, score)]). Rows whose bounds miss the window, or lie
        below k rows that are surely inside, are out; the others are scored exactly."""
        plain = [a for a in anchors if a["w"] is None]
        for at in range(0, len(plain), ANCHORS):
            group = plain[at : at + ANCHORS]
            weights = np.stack([np.asarray(a["v"], np.int64) for a in group])
            low, high = self.index.bounds(weights) if self.index is not None else (np.zeros((len(group), len(self.near))),) * 2
            for i, a in enumerate(group):
                mine = (self.ids[self.near] != a["vec_id"]) & ((self.labels[self.near] == a["label"]) == same)
                far = self._wide_hits(a, [int(x) for x in a["v"]], same)
                for n, window in enumerate(a["windows"]):
                    rows = candidates(low[i], high[i], mine, window, k)
                    exact = self.values[rows] @ weights[i]
                    yield a, n, inside([*zip(self.ids[self.near[rows]].tolist(), exact.tolist(), strict=True), *far], window, k)
        for a in anchors:
            if a["w"] is not None:
                weights = ints(None, a["w"], self.scale)
                near = [(int(self.ids[j]), product(v, weights)) for j, v in zip(self.near, self.values, strict=True) if self._fits(j, a, same)]
                hits = near + self._wide_hits(a, weights, same)
                for n, window in enumerate(a["windows"]):
                    yield a, n, inside(hits, window, k)

    def _wide_hits(self, a: dict, weights: list[int], same: bool) -> list[tuple[int, int]]:
        return [(int(self.ids[j]), product(v, weights)) for j, v in zip(self.far, self.wide, strict=True) if self._fits(j, a, same)]

    def _fits(self, row: int, a: dict, same: bool) -> bool:
        return self.ids[row] != a["vec_id"] and (self.labels[row] == a["label"]) == same


def product(values, weights: list[int]) -> int:
    return sum(int(x) * y for x, y in zip(values, weights, strict=True))


def inside(hits: list[tuple[int, int]], window: tuple[int, int] | None, k: int) -> list[tuple[int, int]]:
    """The k best hits whose hundredfold score is within the window; ties go to the smaller id."""
    fine = [h for h in hits if window is None or window[0] <= 100 * h[1] <= window[1]]
    return sorted(fine, key=lambda h: (-h[1], h[0]))[:k]


def candidates(low: np.ndarray, high: np.ndarray, mine: np.ndarray, window: tuple[int, int] | None, k: int) -> np.ndarray:
    """Rows of ``mine`` that, scores being from low to high, can be among the k best of the window."""
    fits, sure = mine, mine
    if window is not None:
        (l0, l1), (m0, m1) = (around(x) for x in window)
        fits = mine & (high >= l0 / 100) & (low <= m1 / 100)
        sure = fits & (low >= l1 / 100) & (high <= m0 / 100)
    floor = low[sure]
    if len(floor) > k:
        fits = fits & (high >= np.partition(floor, len(floor) - k)[len(floor) - k])
    return np.flatnonzero(fits)


def around(x: int) -> tuple[float, float]:
    """Doubles below and above a whole number of any size."""
    try:
        y = float(x)
    except OverflowError:
        return (np.finfo(float).max, np.inf) if x > 0 else (-np.inf, np.finfo(float).min)
    return y - abs(y) * 2.0**-40 - 2.0**-10, y + abs(y) * 2.0**-40 + 2.0**-10


def ints(v, w, scale: float) -> list[int]:
    return [int(x) for x in v] if w is None else [whole(float(x), scale) for x in w]


def _search(batches: Iterator[pd.DataFrame], books: dict[int, list[np.ndarray]], scale: float, same: bool, k: int, window) -> Iterator[pd.DataFrame]:
    """Rows sorted by block, length and role: a block's vectors come first and are quantised once, then the
    anchors stream by. Only one block is held."""
    at, held, block = None, [], None
    for pdf in batches:
        out: list[tuple] = []
        for key, part in pdf.groupby(["rb", "dims", "asks"], sort=False):
            if key[:2] != at:
                at, held, block = key[:2], [], None
            if not key[2]:
                held.append(part)
                continue
            if block is None and held:
                block, held = Block(pd.concat(held), books, scale), []
            if block is None:
                continue
            anchors = part[["vec_id", "label", "v", "w", "asked"]].to_dict("records")
            for a in anchors:
                a["windows"] = [window(x) for x in a["asked"]]
            for a, n, hits in block.answers(anchors, same, k):
                out += [(a["vec_id"], n, i, str(s), key_of(s), s if key_of(s) == b"\x80" else 0) for i, s in hits]
        columns = list(zip(*out, strict=True)) or [()] * 6
        types = {"anchor_id": "int64", "window": "int32", "vec_id": "int64", "score": "object", "size": "object", "plain": "int64"}
        yield pd.DataFrame({c: pd.Series(list(x), dtype=t) for (c, t), x in zip(types.items(), columns, strict=True)})


def mine(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of each anchor.

    A score is the inner product with the anchor of components floor(scale * x); higher ones come first, ties go
    to the smaller id. An anchor's positives are its first ``positives`` other rows of the same label. For each, its
    negatives are the first ``negatives`` rows of another label with low * positive_score <= 100 * negative_score
    <= high * positive_score.

    Rows whose label, vector or id is null, or whose vector holds a null or non-finite component, take no part;
    nor do vectors of different lengths meet. A row with the anchor's id is no partner of it. Rows that repeat an
    id are partners each by itself; of anchors that repeat an id, the one with the smallest label and vector counts.
    Scores are whole numbers of any size; one that does not fit 64 bits is given as null at its right
    rank. An anchor without a positive, and a positive without a negative, give no row, as does an empty
    table. Only the three columns named are read.

    The codebooks of the commonest length are fitted on SAMPLE of its vectors, those whose ids have the least
    hash; rarer lengths have books of their block. Every row is quantised. Rows are dealt by hash of the id into blocks, whatever their label; the anchors, a given share
    of the table, pass by each block twice: first for their positives, then with the windows that these give.
    Each time a block gives as many rows of a window as are asked for, from which the overall ones are taken.
    """
    spark = vectors.sparkSession
    ship(spark)

    def prepared(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        wide = F.exists(v, lambda x: F.abs(x.cast("double") * float(scale)) >= WIDE)
        df = df.filter(usable(v) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        return df.select(
            F.col(id_col).cast("long").alias("vec_id"),
            F.col(label_col).cast("long").alias("label"),
            F.when(~wide, F.transform(v, lambda x: F.floor(x.cast("double") * float(scale)).cast("int"))).alias("v"),
            F.when(wide, v.cast("array<double>")).alias("w"),
            F.size(v).alias("dims"),
        )

    rows = stage(prepared(vectors), "vectors")
    first = prepared(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "dims", "v", "w")).alias("a"))
    asked = stage(first.select("vec_id", "a.*"), "anchors")
    n = rows.count()
    blocks = max(1, -(-n // ROWS), min(16, -(-n // FEW_ROWS)))
    common = rows.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    books: dict[int, list[np.ndarray]] = {}
    if common is not None and common["dims"]:
        held = rows.filter(F.col("v").isNotNull() & (F.col("dims") == common["dims"])).orderBy(F.xxhash64("vec_id"), "vec_id", "v").select("v").limit(SAMPLE).toPandas()
        if len(held):
            books[common["dims"]] = fit_codebooks(np.stack([np.asarray(v, np.int64) for v in held["v"]]))

    def search(asking: DataFrame, same: bool, k: int, window) -> DataFrame:
        dealt = rows.withColumn("rb", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("asks", F.lit(False))
        sent = asking.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(True))
        both = dealt.withColumn("asked", F.lit(None).cast("array<string>")).unionByName(sent)
        found = both.repartition(blocks, "rb").sortWithinPartitions("rb", "dims", "asks").mapInPandas(
            lambda batches: _search(batches, books, float(scale), same, k, window),
            "anchor_id long, window int, vec_id long, score string, size binary, plain long",
        )
        best = Window.partitionBy("anchor_id", "window").orderBy(F.col("size").desc(), F.col("plain").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    own = search(asked.withColumn("asked", F.array(F.lit(""))), True, positives, lambda _: None)
    own = own.select(F.col("anchor_id").alias("of"), (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive"))
    own = stage(own, "positives")
    each = F.transform(F.sort_array(F.collect_list(F.struct("place", "positive"))), lambda x: x["positive"])
    windows = asked.join(own.groupBy("of").agg(each.alias("asked")), asked["vec_id"] == F.col("of")).drop("of")
    other = search(windows, False, negatives, lambda x: (low * int(x), high * int(x)))
    joined = other.join(own, (F.col("anchor_id") == F.col("of")) & (F.col("window") == F.col("place")))
    score = lambda c: F.expr(f"try_cast({c} as bigint)")
    return joined.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        score("positive").alias("positive_score"), score("score").alias("negative_score"),
    )
