"""Best-fit packing of token sequences by non-negative least squares over length patterns."""

from __future__ import annotations

import json
from array import array
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType
from tokenizers import Tokenizer

from ..shipping import ship
from .common import fresh, resident, shuffle_partitions, stage, text_or_empty
from .pretokens import Splitter, is_latin
from .token_count import byte_letters

#: Pre-tokens that a worker remembers, and the longest one.
MEMO, MEMO_CHARS = 300_000, 48
#: Bytes of ids, and rows, given out at a time.
FLUSH_BYTES, FLUSH_ROWS = 1 << 22, 8192
#: The splitting of byte-level vocabularies. A fixed value.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents of a pattern at most, and the share of a sequence that a pattern may leave empty.
DOCUMENTS, SLACK = 3, 1 / 64
#: Steps of the least squares.
STEPS = 600


class IdBytes:
    """Texts as little-endian unsigned 32-bit ids, as the tokenizers library gives them for a byte-level vocabulary.

    The library itself encodes any text with a letter beyond Latin-1 or a special string inside. Other texts
    are split here, where no version of Unicode makes a difference, and each pre-token is encoded once by
    the same vocabulary and remembered."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split, self.memo, self.pieces = Splitter(BYTE_LEVEL), {}, None
        before, vocab = spec["pre_tokenizer"], spec["model"]["vocab"]
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in merges]
        plain = not spec["normalizer"] and before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        # Ranks are ids where each merge makes the next id; other vocabularies are left to the library.
        if plain and all(a < b for a, b in zip(made, made[1:], strict=False)):
            byte_of = {c: b for b, c in enumerate(byte_letters())}
            ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in self.special}
            self.pieces = tiktoken.Encoding("pieces", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _new(self, piece: str) -> bytes:
        ids = array("I", self.pieces(piece)).tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.pieces is None or not is_latin(text) or any(s in text for s in self.special):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        get, new = self.memo.get, self._new
        return b"".join([get(p) or new(p) for p in self.split(text)])


def cut(docs: DataFrame, path: str, end_id: int, capacity: int = 1024, text_col: str = "text") -> DataFrame:
    """The documents' ids in pieces: the other columns of docs, piece, start, length, ids.

    A document's ids are the library's without special tokens, then ``end_id``; null texts are empty and so
    have that id alone. A document of more than ``capacity`` ids is cut so that all pieces but the first
    are of that length. ``ids`` is binary: little-endian unsigned 32-bit numbers. Where docs has a column
    of one of these names, that one stays and the new one gets underscores in front. Rows that repeat stay
    rows of their own; an empty table gives none. Texts are encoded whole, the pieces of a batch given
    out a few megabytes at a time.
    """
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c != text_col]
    kept = docs.select(*rest)
    fields = [StructField(fresh(kept, n), t) for n, t in (("piece", IntegerType()), ("start", LongType()), ("length", LongType()), ("ids", BinaryType()))]
    schema = StructType([*(docs.schema[c] for c in rest), *fields])
    end = array("I", [end_id]).tobytes()

    def run(batches):
        coder = resident(("id bytes", path), lambda: IdBytes(path))
        for batch in batches:
            texts, rows, size = batch.column(len(rest)), [], 0

            def given(batch=batch):
                nonlocal rows, size
                at, piece, start, ids = zip(*rows, strict=True)
                own = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(rest))]
                sizes = [len(x) // 4 for x in ids]
                rows, size = [], 0
                new = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())]
                return pa.RecordBatch.from_arrays([*own, *new], schema.names)

            for i, text in enumerate(texts):
                data = coder.encode(text.as_py()) + end
                first = len(data) // 4 % capacity or capacity
                begin, upto, piece = 0, first, 0
                while begin < len(data) // 4:
                    rows.append((i, piece, begin, data[4 * begin : 4 * upto]))
                    size += 4 * (upto - begin)
                    begin, upto, piece = upto, upto + capacity, piece + 1
                    if size >= FLUSH_BYTES or len(rows) >= FLUSH_ROWS:
                        yield given()
            if rows:
                yield given()

    return docs.select(*rest, text_or_empty(text_col)).mapInArrow(run, schema)


def length_patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of DOCUMENTS lengths (0: none), rising, that all but fill a sequence: each shorter part is completed by
    the longest length that still fits."""
    fit = np.zeros(capacity + 1, np.int64)  # the longest present length up to each
    fit[present] = present
    fit = np.maximum.accumulate(fit)
    one = np.stack([np.zeros_like(present), np.zeros_like(present), present], 1)
    two = np.stack([np.zeros_like(present), present, fit[capacity - present]], 1)
    a, b = (x.ravel() for x in np.meshgrid(present, present, indexing="ij"))
    near = (a <= b) & (a + 2 * b <= capacity)
    a, b = a[near], b[near]
    every = np.concatenate([one, two, np.stack([a, b, fit[capacity - a - b]], 1)])
    fine = (every[:, 2] >= every[:, 1]) & (every.sum(1) >= capacity * (1 - SLACK))
    return np.unique(every[fine][:, ::-1], axis=0)


def fit_counts(patterns: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that make the used lengths come nearest to the histogram: non-negative
    least squares with the lengths as weights, by accelerated projected gradients with restarts."""
    weight = np.arange(len(counts)) / (len(counts) - 1)
    size = len(counts)

    def used(x):
        return sum(np.bincount(part, x, size) for part in patterns.T) * weight

    def back(r):
        r = r * weight
        r[0] = 0.0
        return r[patterns[:, 0]] + r[patterns[:, 1]] + r[patterns[:, 2]]

    scale = counts.max()
    h = counts / scale * weight
    v = np.ones(len(patterns))
    for _ in range(20):
        v = back(used(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * (v @ back(used(v))))
    x, y, t = np.zeros(len(patterns)), np.zeros(len(patterns)), 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - step * back(used(y) - h))
        if (y - new) @ (new - x) > 0:
            t = 1.0
        then = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = new, new + (t - 1) / then * (new - x), then
    return x * scale


@dataclass(frozen=True)
class Plan:
    """Where the n-th piece of a length goes. Row i: pieces first[i] .. first[i] + many[i] - 1 of length[i] fill, by
    each[i] side by side, the sequences from sequence[i] on at offset[i]. Sorted by length and first."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the nth piece (from 0) of a length."""
        begins = np.searchsorted(self.length, length)
        ends = np.searchsorted(self.length, length, "right")
        while True:  # the last row of the length that begins at nth or before, all pieces halving at once
            open_ = ends - begins > 1
            if not open_.any():
                break
            mid = (begins + ends) // 2
            low = self.first[np.minimum(mid, len(self.first) - 1)] <= nth
            begins, ends = np.where(open_ & low, mid, begins), np.where(open_ & ~low, mid, ends)
        k = nth - self.first[begins]
        return self.sequence[begins] + k // self.each[begins], self.offset[begins] + k % self.each[begins] * self.length[begins]


class _Room:
    """Sequences being filled: by the room they have left, what is inside and how many are so."""

    def __init__(self, counts: np.ndarray):
        self.capacity, self.left = len(counts) - 1, counts.copy()
        self.groups: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = defaultdict(list)

    def add(self, lengths: list[int], n: int) -> None:
        """Up to n sequences of these lengths, as many as there are pieces for."""
        once = tuple((x, lengths.count(x)) for x in sorted(set(lengths)))
        n = min([n, *(int(self.left[x]) // m for x, m in once)])
        if n > 0:
            for x, m in once:
                self.left[x] -= m * n
            self.groups[self.capacity - sum(lengths)].append((once, n))

    def best_fit(self) -> None:
        """All pieces that are left, longest first, each where the least room is left; many at a time."""
        groups = self.groups
        for length in range(self.capacity, 0, -1):
            need = int(self.left[length])
            for room in range(length, self.capacity):
                if not need:
                    break
                held, groups[room], per = groups[room], [], room // length
                for inside, n in held:
                    full = min(n, need // per)
                    need -= full * per
                    if full:
                        groups[room - per * length].append(((*inside, (length, per)), full))
                    if n > full and 0 < need < per:
                        groups[room - need * length].append(((*inside, (length, need)), 1))
                        full, need = full + 1, 0
                    if n > full:
                        groups[room].append((inside, n - full))
            per = self.capacity // length
            if need // per:
                groups[self.capacity - per * length].append((((length, per),), need // per))
            if need % per:
                groups[self.capacity - need % per * length].append((((length, need % per),), 1))
            self.left[length] = 0

    def sequences(self) -> int:
        return sum(n for held in self.groups.values() for _, n in held)


def roundings(x: np.ndarray) -> list[np.ndarray]:
    """Whole repeat counts: all rounded down; halves rounded up; and their running sum rounded down, along the
    patterns sorted by longest part, so that the patterns of one part keep their sum."""
    upto = np.floor(np.cumsum(x) + 1e-6)
    return [r.astype(np.int64) for r in (np.floor(x + 1e-6), np.floor(x + 0.5), np.diff(upto, prepend=0.0))]


def make_plan(histogram: dict[int, int], capacity: int) -> Plan:
    """The packing of so many pieces of each length, of which there are at most ``capacity``.

    Patterns of few documents repeat as often as least squares say, rounded; what is left is packed by best fit into
    the room that is left or new sequences. Of three roundings the one that makes fewest sequences is taken. The
    work depends on the capacity, not on the number of pieces."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    present = np.flatnonzero(counts)
    patterns = length_patterns(present, capacity) if len(present) else np.zeros((0, DOCUMENTS), np.int64)
    x = fit_counts(patterns, counts) if len(patterns) else np.zeros(0)
    best = None
    for repeats in roundings(x):
        tried = _Room(counts)
        for j in np.argsort(-repeats, kind="stable")[: np.count_nonzero(repeats)]:
            tried.add([int(v) for v in patterns[j] if v], int(repeats[j]))
        tried.best_fit()
        if best is None or tried.sequences() < best.sequences():
            best = tried
    rows, first, sequence = [], defaultdict(int), 0
    for room in sorted(best.groups):
        for inside, n in best.groups[room]:
            offset = 0
            for length, m in inside:
                rows.append((length, first[length], m, sequence, offset))
                first[length] += m * n
                offset += m * length
            sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return Plan(*table, sequences=sequence)


def pack(pieces: DataFrame, capacity: int = 1024, length_col: str = "length") -> DataFrame:
    """pieces with sequence_id and offset (long): each sequence's pieces lie without gaps from 0 on and are
    ``capacity`` long together at most.

    A piece whose length is null, below 1 or above the capacity gets a null sequence and offset. Rows that
    repeat are pieces of their own. Where pieces has columns of these names already, the new ones get underscores in
    front. An empty table gives an empty one. All columns must be of types that can be sorted.

    The driver sees the histogram of lengths, of ``capacity`` numbers at most. The pieces of a length are numbered
    in parts, chosen by a hash of the whole row: how many each part has is added up over the parts, so that a
    length of any frequency is numbered by many tasks. Equal rows can stand for one another, so it does not matter
    which of them comes first if a part is numbered again.
    """
    spark = pieces.sparkSession
    ship(spark)
    seq, off = fresh(pieces, "sequence_id"), fresh(pieces, "offset")
    part, nth, before, size = (fresh(pieces, n) for n in ("_part", "_nth", "_before", "_size"))
    length = F.col(length_col).cast("long")
    fine = length.isNotNull() & length.between(1, capacity)
    parts = 4 * shuffle_partitions(spark)
    dealt = pieces.withColumn(size, F.when(fine, length)).withColumn(part, F.pmod(F.xxhash64(*pieces.columns), F.lit(parts)).cast("int"))
    dealt = stage(dealt, "pieces")
    counts = stage(dealt.groupBy(size, part).count(), "lengths")
    found = counts.filter(F.col(size).isNotNull()).groupBy(size).agg(F.sum("count").alias("n")).collect()
    plan = make_plan({r[0]: r["n"] for r in found}, capacity)
    upto = Window.partitionBy(size).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(size).alias("_s"), F.col(part).alias("_p"), F.coalesce(F.sum("count").over(upto), F.lit(0)).alias(before))
    own = Window.partitionBy(size, part).orderBy(*pieces.columns)
    numbered = dealt.withColumn(nth, F.row_number().over(own).cast("long"))
    joined = numbered.join(starts, F.col(size).eqNullSafe(F.col("_s")) & (F.col(part) == F.col("_p")), "left")
    ready = joined.select(*pieces.columns, F.col(size), (F.col(before) + F.col(nth) - 1).alias(nth))
    schema = StructType([*pieces.schema, StructField(seq, LongType()), StructField(off, LongType())])

    def run(batches):
        for batch in batches:
            k = batch.num_columns - 2
            sizes, at = batch.column(k), batch.column(k + 1)
            known = sizes.is_valid().to_numpy(zero_copy_only=False)
            s = sizes.fill_null(0).to_numpy(zero_copy_only=False)[known]
            where, offset = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
            if len(s):
                where[known], offset[known] = plan.place(s, at.to_numpy(zero_copy_only=False)[known])
            new = [pa.array(x, pa.int64(), mask=~known) for x in (where, offset)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *new], schema.names)

    return ready.mapInArrow(run, schema)


def sequences(packed: DataFrame, length_col: str = "length", ids_col: str = "ids", capacity: int = 1024) -> DataFrame:
    """sequence_id, length, ids of every sequence of ``pack``: its pieces' ids end to end. Pieces without a sequence
    are in none."""
    inside = packed.filter(F.col("sequence_id").isNotNull()).groupBy("sequence_id")
    out = inside.agg(F.sum(length_col).alias("length"), F.sort_array(F.collect_list(F.struct("offset", ids_col))).alias("_all"))
    whole = F.aggregate("_all", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x[ids_col]))
    return out.select("sequence_id", "length", whole.alias("ids"))
