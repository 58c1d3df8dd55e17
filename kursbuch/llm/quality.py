"""Quality classifier: random-indexing word vectors, pooled, and a small calibrated network."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import fresh, resident, stage, text_or_empty

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE = 6000
#: Words that get a vector from their contexts; others have their index vector.
VOCABULARY = 20_000
#: Dimensions of the word vectors, and of the shape vectors beside them.
DIMS, SHAPE_DIMS = 64, 32
#: Non-zero entries of an index vector.
NONZERO = 8
#: Words on either side that count as context.
NEAR = 2
HIDDEN = 32
#: Words whose vectors a worker keeps.
MEMO = 100_000
#: Characters after which a long text is cut into parts.
CHARS = 1 << 20

_CORE = re.compile(r"\w+").search
_SPACE = re.compile(r"\s").search


def index_vectors(keys: list[str], dims: int = DIMS) -> np.ndarray:
    """Sparse vectors of +1 and -1 whose places follow from a hash of each key."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(k.encode("utf-8", "replace")) for k in keys), np.uint64, len(keys))
    out = np.zeros((len(keys), dims), np.float32)
    rows = np.arange(len(keys))
    for _ in range(NONZERO):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        at = ((h >> np.uint64(40)) % np.uint64(dims)).astype(np.int64)
        out[rows, at] += np.where(h >> np.uint64(63), np.float32(1), np.float32(-1))
    return out


def core(word: str) -> str:
    m = _CORE(word)
    return m[0].lower() if m else ""


def parts(word: str) -> tuple[str, str]:
    """The core of a word, and how it looks: case, digits, and the signs around its letters."""
    m = _CORE(word)
    if not m:
        return "", f"|{word[:4]}|"
    inner = m[0]
    case = "d" if inner[0].isdigit() else "U" if len(inner) > 1 and inner.isupper() else "C" if inner[0].isupper() else "l"
    return inner.lower(), f"{word[: m.start()][-2:]}{case}{word[m.end() :][:4]}"


def cuts(text: str, chars: int = CHARS // 4) -> Iterator[str]:
    """The text in parts of about so many characters, cut before white space: no word is split."""
    begin = 0
    while begin < len(text):
        m = _SPACE(text, begin + chars) if begin + chars < len(text) else None
        end = m.start() if m else len(text)
        yield text[begin:end]
        begin = end


def context_sums(texts: Iterable[str]) -> dict[str, np.ndarray]:
    """Of each word, the sum of the index vectors of its neighbours, and at the end its count.

    A long text is gone through in parts, each with the last words of the one before."""
    memo: dict[str, np.ndarray] = {}
    out: dict[str, np.ndarray] = {}
    for text in texts:
        held: list[str] = []
        first, parts = 0, cuts(text)
        part = next(parts, None)
        while part is not None:
            held += [c for w in part.split() if (c := core(w))]
            part = next(parts, None)
            # what has all its neighbours in ``held``
            last = len(held) if part is None else max(first, len(held) - NEAR)
            if last > first:
                new = list(set(held).difference(memo))
                memo.update(zip(new, index_vectors(new), strict=True))
                m = np.stack([memo[w] for w in held])
                near = np.zeros_like(m)
                for d in range(1, NEAR + 1):
                    near[d:] += m[:-d]
                    near[:-d] += m[d:]
                names, at = np.unique(np.asarray(held[first:last], object), return_inverse=True)
                sums = np.zeros((len(names), DIMS + 1), np.float32)
                np.add.at(sums[:, :DIMS], at, near[first:last])
                sums[:, DIMS] = np.bincount(at, minlength=len(names))
                for w, s in zip(names, sums, strict=True):
                    if w in out:
                        out[w] += s
                    else:
                        out[w] = s.copy()
            drop = max(0, last - NEAR)
            held, first = held[drop:], last - drop
            if len(memo) > MEMO:
                memo.clear()
    return out


class Pool:
    """Document features: the mean of its words' vectors, and a few counts."""

    width = DIMS + SHAPE_DIMS + 6

    def __init__(self, contexts: dict[str, np.ndarray]):
        self.contexts = contexts
        self.number: dict[str, int] = {}
        self.table = np.zeros((1024, DIMS + SHAPE_DIMS), np.float32)

    def _learn(self, new: list[str]) -> None:
        number, first = self.number, len(self.number)
        number.update(zip(new, range(first, first + len(new)), strict=True))
        while len(number) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        cores, shapes = zip(*map(parts, new), strict=True)
        rows = self.table[first : first + len(new)]
        rows[:, :DIMS] = index_vectors(cores)
        kinds = {s: i for i, s in enumerate(set(shapes))}
        rows[:, DIMS:] = index_vectors(list(kinds), SHAPE_DIMS)[[kinds[s] for s in shapes]]
        rows /= np.float32(np.sqrt(NONZERO))
        get = self.contexts.get
        for i, c in enumerate(cores):
            v = get(c)
            if v is not None:
                rows[i, :DIMS] = v

    def features(self, texts: Sequence) -> np.ndarray:
        """One row for each text of a list or an Arrow column."""
        out = np.zeros((len(texts), self.width), np.float32)
        for i in range(len(texts)):
            text = texts[i]
            self._fill(text if isinstance(text, str) else text.as_py(), out[i])
        return out

    def _fill(self, text: str, row: np.ndarray) -> None:
        counts: Counter[str] = Counter()
        for part in cuts(text):
            counts.update(part.split())
        if not counts:
            return
        times = np.fromiter(counts.values(), np.float32, len(counts))
        total, kinds = float(times.sum(dtype=np.float64)), list(counts)
        sums = np.zeros(DIMS + SHAPE_DIMS, np.float32)
        for i in range(0, len(kinds), MEMO // 4):
            if len(self.number) > MEMO:
                self.number.clear()
            some = kinds[i : i + MEMO // 4]
            new = [w for w in some if w not in self.number]
            if new:
                self._learn(new)
            at = np.fromiter(map(self.number.__getitem__, some), np.int64, len(some))
            sums += times[i : i + len(some)] @ self.table[at]
        row[: DIMS + SHAPE_DIMS] = sums / total
        lines = text.split("\n")
        row[-6:] = (
            np.log1p(total) / 8,
            len(kinds) / total,
            len(text) / total / 8,
            len(set(lines)) / len(lines),
            times.max() / total,
            np.log1p(len(lines)) / 6,
        )


@dataclass
class Network:
    """Two layers over standardised features; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return h @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 1) -> Network:
    """Fitted by Adam on four fifths of the rows; the last fifth picks the epoch and the temperature.

    With one class only, or fewer than 20 rows, the score is the share of label 1 (a half
    without rows)."""
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    if len(y) < 20 or y.min() == y.max():
        share = min(0.999, max(0.001, float(y.mean()))) if len(y) else 0.5
        d = x.shape[1] if x.ndim == 2 else Pool.width
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[used].mean(0), x[used].std(0) + 1e-3
    net = Network(mean, scale, rng.normal(0, 0.2, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), 0.0)
    par = [net.w1, net.b1, net.w2, np.array([0.0])]
    m, v, step, best = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par], 0, (np.inf, None)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(used), max(1, len(used) // 64)):
            s = (x[batch] - mean) / scale
            h = np.tanh(s @ par[0] + par[1])
            z = h @ par[2] + par[3][0]
            g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[batch]) / len(batch)
            back = np.outer(g, par[2]) * (1 - h * h)
            grads = [s.T @ back + 1e-3 * par[0], back.sum(0), h.T @ g + 1e-3 * par[2], np.array([g.sum()])]
            step += 1
            for i, grad in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                par[i] = par[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        net.w1, net.b1, net.w2, net.b2 = par[0], par[1], par[2], float(par[3][0])
        loss = _loss(net.logits(x[held]), y[held])
        if loss < best[0]:
            best = (loss, [p.copy() for p in par])
    net.w1, net.b1, net.w2, net.b2 = best[1][0], best[1][1], best[1][2], float(best[1][3][0])
    z = net.logits(x[held])
    net.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=lambda t: _loss(z / t, y[held]))
    return net


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, mod 3; fold 1 is held out. A null id counts as ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[dict, Network]:
    """Word vectors and network from at most ``sample`` labelled documents outside the held-out
    fold: those with the smallest hashes of the id. Labels other than 0 and 1 are ignored; of
    several for one document the majority counts, ties as 0. Nothing but the text is an input.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 1))
    known = known.groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) > 0.5).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    # At most ``sample`` rows are broadcast. Of rows that repeat an id the smallest text counts: reruns agree.
    rows = texts.join(F.broadcast(known), "id").groupBy("id").agg(F.first("y").alias("y"), F.min("text").alias("text"))
    rows = stage(rows, "labelled")

    def contexts(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for w, s in context_sums(t.as_py() for t in batch.column("text")).items():
                sums[w] = sums[w] + s if w in sums else s
        names = list(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([s.astype(np.float32).tobytes() for s in sums.values()], pa.binary())], ["word", "sums"]
        )

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, np.ndarray] = {}
        for w, s in zip(pdf["word"], pdf["sums"], strict=True):
            v = np.frombuffer(s, np.float32)
            out[w] = out[w] + v if w in out else v
        return pd.DataFrame([(w, float(v[DIMS]), v.tobytes()) for w, v in out.items()], columns=["word", "times", "sums"])

    # Sums of small integers: exact in any order.
    words = rows.select("text").mapInArrow(contexts, "word string, sums binary")
    words = words.groupBy(F.pmod(F.xxhash64("word"), F.lit(32))).applyInPandas(total, "word string, times double, sums binary")
    words = stage(words, "words")
    # The least count at which no more than VOCABULARY words are left; words of one count stay or go together.
    counts = words.groupBy("times").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.col("times").desc()))
    least = counts.withColumn("upto", upto).filter(F.col("upto") <= VOCABULARY).agg(F.min("times")).first()[0]
    vocabulary = {}
    for r in words.filter(F.col("times") >= (float("inf") if least is None else least)).orderBy("word").collect():
        v = np.frombuffer(bytes(r["sums"]), np.float32)[:DIMS]
        norm = float(np.linalg.norm(v))
        vocabulary[r["word"]] = (v / norm if norm else v).astype(np.float32)
    sent = spark.sparkContext.broadcast(vocabulary)

    def pooled(batches):
        pool = Pool(sent.value)
        for batch in batches:
            feats = [x.tobytes() for x in pool.features(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(feats, pa.binary())], ["id", "y", "x"])

    kind = dict(rows.dtypes)["id"]
    got = rows.select("id", "y", "text").mapInArrow(pooled, f"id {kind}, y int, x binary").orderBy("id").collect()
    x = np.stack([np.frombuffer(bytes(r["x"]), np.float32) for r in got]) if got else np.zeros((0, Pool.width))
    return vocabulary, fit(x, np.array([r["y"] for r in got], np.float64))


def _pool(sent) -> Pool:
    """One for each model and worker process."""
    key = getattr(sent, "_jbroadcast_id", None) or id(sent.value)
    return resident(("pool", key), lambda: Pool(sent.value))


def score(docs: DataFrame, model: tuple[dict, Network], text_col: str = "text") -> Column:
    """The probability of label 1 as a column; null texts score as empty ones."""
    vocabulary, net = model
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        features = _pool(sent).features(texts)
        return pa.array(net.score(features.astype(np.float64)), pa.float64())

    return of(text_or_empty(text_col))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row for each document: id, held_out, score, predicted (1 where score >= 0.5)."""
    model = train(docs, labels, id_col, text_col, sample=sample)
    out = docs.select(F.col(id_col), (fold(F.col(id_col)) == 1).alias("held_out"), score(docs, model, text_col).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """docs without those that the classifier predicts as 0; all columns stay."""
    s = fresh(docs, "_score")
    return docs.withColumn(s, score(docs, train(docs, labels, id_col, text_col, sample=sample), text_col)).filter(F.col(s) >= 0.5).drop(s)
