"""N-gram Jaccard join by PartEnum signatures."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import attach, fresh, release, resident, stage, text_or_empty

_U = np.uint64
#: Ratio of the largest to the smallest size of a band; bands overlap so that any two sets
#: that can be similar have one in common.
BAND = 1.6
#: Elements that a signature should rest on, on average, for the smallest sets of a band.
ELEMENTS = 2.0
#: Parts beyond those that the differences can spoil, as a share of these: some may be left out
#: for being thin, and of the others similar sets have so many more than one in common.
SPARE, EXTRA = 0.25, 0.1
#: Words whose hashes a worker keeps.
MEMO = 300_000


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            if len(self) >= MEMO:
                self.clear()
            self[word] = h
        return h


def _hash() -> _WordHash:
    return resident("word hashes", _WordHash)


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Of each text, its distinct n-word shingles as sorted 64-bit hashes; with fewer words, the
    whole sequence is one; without words there are none.

    Bytes split at the ASCII white space, and only A to Z change case."""
    split = [t.encode("utf-8", "replace").lower().split() for t in texts]
    ends = np.cumsum([len(w) for w in split], dtype=np.int64)
    h = np.fromiter(map(_hash().__getitem__, chain.from_iterable(split)), _U, int(ends[-1]) if len(ends) else 0)
    out = np.full(len(h), n, _U)
    for i in range(min(n, len(h))):
        out[: len(h) - i] = mix64(out[: len(h) - i] * _U(0x9E3779B97F4A7C15) + h[i:])
    sets, begin = [], 0
    for words, end in zip(split, ends.tolist(), strict=True):
        if len(words) >= n:
            sets.append(np.unique(out[begin : end - n + 1]))
        elif words:
            x = np.full(1, len(words), _U)
            for i in range(begin, end):
                x = mix64(x * _U(0x9E3779B97F4A7C15) + h[i])
            sets.append(x)
        else:
            sets.append(np.empty(0, _U))
        begin = end
    return sets


@dataclass(frozen=True)
class Scheme:
    """PartEnum for sets of size low to high whose symmetric difference is at most k.

    The domain is cut into n1 parts and each of them into n2; the signatures of a set are its
    projections on every choice of n2 - k2 cells of a part. By the pigeonhole principle at
    least ``spare + extra + 1`` parts hold at most k2 of the differences, and each of these has a
    choice of cells without any. A set may leave out ``spare`` parts, so similar sets have
    ``extra + 1`` signatures in common at least.
    """

    band: int
    low: int
    high: int
    k: int
    n1: int
    n2: int
    k2: int
    spare: int
    extra: int


def _choose(size: float, k: int) -> tuple[int, int, int, int, int]:
    """n1, n2, k2, spare, extra: the fewest signatures among choices whose projections rest on enough elements."""
    best = None
    for k2, n2 in ((0, 1), (1, 2), (1, 3), (2, 4), (2, 5), (3, 6)):
        need = k // (k2 + 1) + 1
        spare, extra = int(need * SPARE), int(need * EXTRA)
        n1 = need + spare + extra
        subsets = math.comb(n2, k2)
        elements = size * (n2 - k2) / (n1 * n2)
        cost = (elements < ELEMENTS, -elements if elements < ELEMENTS else n1 * subsets)
        if best is None or cost < best[0]:
            best = (cost, (n1, n2, k2, spare, extra))
    return best[1]


@lru_cache(maxsize=64)
def _schemes(num: int, den: int, upto: int) -> list[Scheme]:
    """Schemes for sizes 1 to upto at similarity num / den."""
    gamma = num / den
    ratio = max(BAND, 1 / gamma + 0.05)
    out, low, band = [], 1, 0
    while True:
        high = max(low, int(low * ratio))
        # Two sets of a and b elements are similar iff they differ in at most (1-g)(a+b)/(1+g).
        k = (den - num) * 2 * high // (den + num)
        out.append(Scheme(band, low, high, k, *_choose(low, k)))
        if high >= upto:
            return out
        # The next band begins low enough to hold every set that is similar to one beyond this.
        low, band = max(low + 1, math.ceil((high + 1) * num / den)), band + 1


def schemes_of(size: int, num: int, den: int) -> list[Scheme]:
    upto = 1 << max(12, int(size).bit_length())
    return [s for s in _schemes(num, den, upto) if s.low <= size <= s.high]


def quota(size: int, num: int, den: int) -> int:
    """Signatures that a set of this size shares, at least, with any set that is similar to it."""
    return 1 + min(s.extra for s in schemes_of(size, num, den))


def signatures(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of the set), for all sets together.

    Projections of few elements say little and are shared by many sets. A set leaves out its
    thinnest parts, as many as ``spare`` allows: those with fewer elements (in their thinnest
    choice) than the (spare + 1)-th thinnest. Nothing is lost by that: of two similar sets,
    spare + extra + 1 parts or more agree, and have the same size in both; whichever of the sets drops
    the larger sizes drops at most spare of them.
    """
    groups: dict[Scheme, list[int]] = {}
    for i, s in enumerate(sets):
        if len(s):
            for scheme in schemes_of(len(s), num, den):
                groups.setdefault(scheme, []).append(i)
    sig, of = [], []
    for c, members in groups.items():
        flat = np.concatenate([sets[i] for i in members])
        local = np.repeat(np.arange(len(members)), [len(sets[i]) for i in members])
        h = mix64(flat + _U((c.band + 1) * 0x632BE59BD9B4E019 & (2**64 - 1)))
        part = ((h >> _U(32)) * _U(c.n1) >> _U(32)).astype(np.int64)
        cell = ((h & _U(0xFFFFFFFF)) * _U(c.n2) >> _U(32)).astype(np.int64)
        at = (local * c.n1 + part) * c.n2 + cell
        cells = len(members) * c.n1 * c.n2
        sums = np.zeros(cells, _U)
        np.add.at(sums, at, mix64(h))
        count = np.bincount(at, minlength=cells).reshape(len(members), c.n1, c.n2)
        sums = sums.reshape(len(members), c.n1, c.n2)
        choices = list(combinations(range(c.n2), c.n2 - c.k2))
        shape = (len(members), c.n1, len(choices))
        value, held = np.empty(shape, _U), np.empty(shape, np.int64)
        parts = np.arange(c.n1, dtype=_U)
        for j, choice in enumerate(choices):
            held[:, :, j] = count[:, :, choice].sum(2)
            salt = mix64(parts * _U(len(choices)) + _U(j) + _U((c.band + 1) << 40))
            value[:, :, j] = mix64(sums[:, :, choice].sum(2, dtype=_U) ^ salt) + held[:, :, j].astype(_U)
        # The parts with the emptiest projections go: all below the size that the (spare + 1)-th has.
        thin = held.min(2)
        least = np.partition(thin, c.spare, axis=1)[:, c.spare]
        keep = np.broadcast_to((thin >= least[:, None])[:, :, None], shape)
        row = np.broadcast_to(np.arange(len(members))[:, None, None], shape)[keep]
        sig.append(value[keep])
        of.append(np.asarray(members)[row])
    if not sig:
        return np.empty(0, _U), np.empty(0, np.int64)
    return np.concatenate(sig), np.concatenate(of)


def _batches(column, chars: int = 1 << 21):
    """Texts of an Arrow column, in lists of about so many characters."""
    held, size = [], 0
    for x in column:
        held.append(x.as_py())
        size += len(held[-1])
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit identity of each set; 0 for sets without elements."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros(len(sets), _U)
    some = np.flatnonzero(sizes)
    if len(some):
        flat = mix64(np.concatenate([sets[i] for i in some]))
        sums = np.add.reduceat(flat, np.cumsum(sizes[some]) - sizes[some], dtype=_U)
        out[some] = mix64(sums ^ mix64(sizes[some].astype(_U))) | _U(1)
    return out.view(np.int64)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the connected components of the links, labelled by their smallest node.

    Each round every node takes the smallest label among its own and its neighbours', and
    then the label's label, so paths shorten by half; rounds end when no label changes.
    """
    edges = stage(links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(F.col(b), F.col(a))).distinct(), "edges")
    labels = stage(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).withColumnRenamed("x", "node"), "labels")
    while True:
        seen = edges.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = lower.join(jump, "low").select("node", F.col("label").alias("old"), F.least("low", "far").alias("label"))
        before, labels = labels, stage(new, "labels")
        release(before)
        if not labels.filter("old != label").limit(1).count():
            release(edges)
            return labels.select("node", "label")


def _rows(sig: pa.Array, *rest) -> pa.RecordBatch:
    *numbers, own = rest
    columns = [sig, *(pa.array(x.astype(np.int64)) for x in numbers), pa.array(np.full(len(sig), own))]
    return pa.RecordBatch.from_arrays(columns, ["sig", "node", "size", "lead", "lead_size", "own"])


def _run_members(batches: Iterable[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by signature and node, those whose signature has several nodes, each with
    the first node of its run. Only the run's beginning is carried from batch to batch.

    Rows of negative size are no signatures but say what a document's set is; they go through,
    with the set's quota as lead_size."""
    sig0, lead0, size0, last0, seen0 = None, 0, 0, 0, 0
    for batch in batches:
        sig, node, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "node", "size"))
        own = size < 0
        if own.any():
            n = -1 - size[own].astype(np.int64)
            quotas = {x: quota(x, num, den) if x else 0 for x in set(n.tolist())}
            yield _rows(batch.column("sig").filter(pa.array(own)), node[own], n, np.zeros_like(n), np.fromiter(map(quotas.get, n.tolist()), np.int64, len(n)), True)
            sig, node, size = sig[~own].astype(np.int64), node[~own], size[~own]
        if not len(sig):
            continue
        again = np.append(sig0 is not None and sig[0] == sig0 and node[0] == last0, (sig[1:] == sig[:-1]) & (node[1:] == node[:-1]))
        sig, node, size = sig[~again], node[~again], size[~again]
        if not len(sig):
            continue
        start = np.append(sig0 is None or sig[0] != sig0, sig[1:] != sig[:-1])
        index = np.arange(len(sig))
        first = np.maximum.accumulate(np.where(start, index, -1))
        carried = first < 0
        lead = np.where(carried, lead0, node[first])
        lead_size = np.where(carried, size0, size[first]).astype(np.int32)
        place = np.where(carried, index + seen0, index - first)
        second, member = place == 1, place >= 1
        both = lambda first, then: np.concatenate([first[second], then[member]])
        yield _rows(pa.array(both(sig, sig)), both(lead, node), both(lead_size, size), both(lead, lead), both(lead_size, lead_size), False)
        sig0, lead0, size0, last0, seen0 = sig[-1], lead[-1], lead_size[-1], node[-1], place[-1] + 1


class _Join:
    """The parameters of one join, and its steps over staged tables."""

    def __init__(self, n: int, num: int, den: int):
        self.n, self.num, self.den = n, num, den

    def signed(self, rows: DataFrame) -> DataFrame:
        """sig, node, size, lead, lead_size, own: for each document a row (own) with its id, set and
        number of shingles, and the signatures that several sets share. Texts are read once."""
        n, num, den = self.n, self.num, self.den

        def sign(batches):
            for batch in batches:
                ids, at = batch.column("id"), 0
                for texts in _batches(batch.column("text")):
                    here = ids.slice(at, len(texts))
                    at += len(texts)
                    sets = shingle_sets(texts, n)
                    nodes = np.where(here.is_valid().to_numpy(zero_copy_only=False), fingerprints(sets), 0)
                    sizes = np.array([len(s) for s in sets], np.int32)
                    sig, of = signatures([s if x else s[:0] for s, x in zip(sets, nodes, strict=True)], num, den)
                    names = ["sig", "node", "size"]
                    yield pa.RecordBatch.from_arrays([here, pa.array(nodes), pa.array(-1 - sizes)], names)
                    yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(nodes[of]), pa.array(sizes[of])], names)

        by_sig = rows.mapInArrow(sign, "sig long, node long, size int").repartition("sig").sortWithinPartitions("sig", "node")
        schema = "sig long, node long, size long, lead long, lead_size long, own boolean"
        return by_sig.mapInArrow(lambda batches: _run_members(batches, num, den), schema)

    def sets(self, rows: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
        """node, shingles: the whole sets of the wanted nodes, each from one of its documents."""
        n = self.n

        def run(batches):
            for batch in batches:
                want, at = batch.column("node").to_numpy(zero_copy_only=False), 0
                for texts in _batches(batch.column("text")):
                    sets = shingle_sets(texts, n)
                    # An id may stand for several texts: only that of the node is wanted.
                    kept = np.flatnonzero(fingerprints(sets) == want[at : at + len(texts)])
                    found = [sets[i].view(np.int64) for i in kept]
                    yield pa.RecordBatch.from_arrays([pa.array(want[at + kept]), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])
                    at += len(texts)

        chosen = nodes.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"))
        texts = rows.join(chosen, "id").select("node", "text")
        return texts.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])

    def possible(self, a: Column, b: Column) -> Column:
        return F.least(a, b) * self.den >= F.greatest(a, b) * self.num

    def rarest(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """sig, node, size, quota, weight: runs of the rarest shingles in place of hot runs.

        Two sets that link share one of the first n - ceil(t n) + 1 elements of each, in any order that
        is the same for all. Frequent shingles come last here, so a passage that very many documents
        hold makes a run only among those that hold little else. The HEAVY most frequent shingles
        are told to the tasks; all others count as equally rare, in the order of their hashes."""
        num, den = self.num, self.den
        hot = sets.join(members.select("node").distinct(), "node", "left_semi")
        often = hot.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))
        heavy = often.filter("n > 8").orderBy(F.col("n").desc(), "shingle").limit(HEAVY).orderBy("shingle").toPandas()
        sent = hot.sparkSession.sparkContext.broadcast((heavy["shingle"].to_numpy(np.int64), heavy["n"].to_numpy(np.int64)))

        def first(batches):
            keys, times = sent.value
            for batch in batches:
                nodes, chosen, of, sizes = batch.column("node").to_numpy(), [], [], []
                for i, s in enumerate(batch.column("shingles")):
                    v = s.values.to_numpy()
                    n = np.zeros(len(v), np.int64)
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, v), len(keys) - 1)
                        n = np.where(keys[at] == v, times[at], 0)
                    chosen.append(v[np.lexsort((v, n))[: len(v) - -(-len(v) * num // den) + 1]])
                    of.append(np.full(len(chosen[-1]), nodes[i]))
                    sizes.append(np.full(len(chosen[-1]), len(v)))
                if chosen:
                    columns = [np.concatenate(x).astype(np.int64) for x in (chosen, of, sizes)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["sig", "node", "size"])

        return hot.select("node", "shingles").mapInArrow(first, "sig long, node long, size long").select("*", F.lit(1).cast("long").alias("quota"), F.lit(1).cast("long").alias("weight"))

    def blocks(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """Links across labels within the clusters that hot runs make.

        A cluster is what shared hot runs connect. Its nodes outside of its largest label meet all
        of its nodes, in blocks: a task gets two blocks of whole sets, however large the cluster."""
        num, den = self.num, self.den
        # Nodes of one label are in one cluster anyway, so labels are connected, not nodes.
        seen = members.select("sig", "label").distinct()
        first = seen.groupBy("sig").agg(F.min("label").alias("b"))
        edges = seen.join(first, "sig").select(F.col("label").alias("a"), "b").filter("a <> b").distinct()
        cluster = components(edges).select(F.col("node").alias("label"), F.col("label").alias("cluster"))
        nodes = members.select("node", "label").distinct().join(cluster, "label")
        counts = nodes.groupBy("cluster", "label").agg(F.count("*").alias("k"))
        most = counts.groupBy("cluster").agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("n"))
        most = most.select("cluster", F.col("top.label").alias("most"), F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
        nodes = stage(nodes.join(most, "cluster").join(sets, "node").withColumn("place", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), "clusters")
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        few = nodes.filter("label <> most").select("cluster", F.col("place").alias("i"), every.alias("j"), "node", "label", "shingles")
        many = nodes.select("cluster", every.alias("i"), F.col("place").alias("j"), "node", "label", "shingles")
        key = ["cluster", "i", "j"]
        met = few.groupBy(*key).cogroup(many.groupBy(*key))
        return met.applyInPandas(lambda x, y: _link_blocks(x, y, num, den), "a long, b long")

    def verify(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Of pairs a, b those that link, by their whole sets."""
        x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        met = pairs.join(x, "a").join(y, "b").select("a", "b", both.alias("both"), (F.size("x") + F.size("y") - both).alias("all"))
        return met.filter(F.col("both") * self.den >= F.col("all") * self.num).select("a", "b")


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of runs with several labels, with their label, the run's most frequent one and its size."""
    named = members.select("sig", "node", "size", "quota", "weight").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = named.groupBy("sig", "label").agg(F.count("*").alias("k"))
    mixed = counts.groupBy("sig").agg(F.max(F.struct("k", "label")).alias("top"), F.count("*").alias("labels"), F.sum("k").alias("n"))
    mixed = mixed.filter("labels > 1").select("sig", F.col("top.label").alias("most"), "n")
    return named.join(mixed, "sig")


def _pairs(small: DataFrame, join: _Join) -> DataFrame:
    """a, b: the pairs across labels of runs that are not hot which share as many runs as their quota."""
    b = [F.col("node").alias("b"), F.col("size").alias("b_size"), F.col("label").alias("b_label")]
    few = small.filter("label != most")
    differ = (F.col("label") != F.col("b_label")) & join.possible(F.col("size"), F.col("b_size"))
    once = (F.col("b_label") == F.col("most")) | (F.col("node") < F.col("b"))
    pairs = few.join(small.select("sig", *b, F.col("quota").alias("b_quota")), "sig").filter(differ & once)
    pairs = pairs.groupBy(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))
    pairs = pairs.agg(F.count("*").alias("n"), F.min(F.least("quota", "b_quota")).alias("least"))
    return pairs.filter("n >= least").select("a", "b")


def _link_blocks(few: pd.DataFrame, many: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Links between two blocks of sets with different labels: for each of the few, one with each label."""
    out: list[tuple[int, int]] = []
    if len(few) and len(many):
        x, y = [np.asarray(v, np.int64) for v in few["shingles"]], [np.asarray(v, np.int64) for v in many["shingles"]]
        common = np.intersect1d(np.concatenate(x), np.concatenate(y))
        both = np.zeros((len(x), len(y)), np.float32)
        for i in range(0, len(common), 4096):  # exact: counts are far below 2^24
            part = common[i : i + 4096]
            m = [np.zeros((len(side), len(part)), np.float32) for side in (x, y)]
            for side, rows in zip((x, y), m, strict=True):
                for k, v in enumerate(side):
                    at = np.minimum(np.searchsorted(part, v), len(part) - 1)
                    rows[k, at[part[at] == v]] = 1
            both += m[0] @ m[1].T
        sizes = np.add.outer([len(v) for v in x], [len(v) for v in y])
        labels = many["label"].to_numpy()
        hit = (both * den >= (sizes - both) * num) & (few["label"].to_numpy()[:, None] != labels[None, :])
        for i in np.flatnonzero(hit.any(1)):
            at = np.flatnonzero(hit[i])
            _, first = np.unique(labels[at], return_index=True)
            out += [(int(few["node"].iloc[i]), int(many["node"].iloc[j])) for j in at[first]]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


#: Runs with more members are not paired off: their sets form runs by their rarest shingles, and what is
#: as hot again is compared in blocks of sets.
HOT_RUN = 48
#: Frequent shingles that are told to the tasks for that.
HEAVY = 200_000
#: Sets of a block.
BLOCK = 400


def similar_classes(
    docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each document: id, n_shingles, set_id, component_id.

    Two documents link when den * |intersection| >= num * |union| of their shingle sets;
    component_id is the smallest id that links lead to. Documents without words (or with a
    null text) link with nothing and are their own component; rows with a null id too, and
    theirs is null. Rows that repeat an id are rows of their own with one id.

    Ids are integers.

    1. Documents with the same set are one node (set_id). Every node's PartEnum signatures are
       sorted by signature; copies fall together there. Nodes that share fewer signatures
       than their quota have no partner and leave.
    2. In each run of equal signatures the nodes are paired with the one that is in the most and
       largest runs; each node keeps its heaviest such partner, and that pair is verified on the whole
       sets. These links give first labels.
    3. Runs whose nodes have different labels are left. Their pairs across labels, all that reach the
       quota, are verified. The sets of hot runs form new runs by their rarest shingles instead, and
       what is as hot again is compared in blocks of sets. Then every pair that can link is either
       verified or within one component, so the components are those of all links.
    """
    spark = docs.sparkSession
    ship(spark)
    join = _Join(n, num, den)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    signed = stage(join.signed(rows), "signed")
    nodes = signed.filter("own").select(F.col("sig").alias("id"), F.when(F.col("node") != 0, F.col("node")).alias("node"), F.col("size").alias("n_shingles"), F.col("lead_size").alias("quota"))
    # A set that is similar to another is in as many runs as its quota says, or more.
    quotas = nodes.filter("node is not null").groupBy("node").agg(F.min("quota").alias("quota"))
    shared = signed.filter("not own")
    active = shared.groupBy("node").agg(F.count("*").alias("n")).join(quotas, "node").filter("n >= quota").select("node", "quota")
    runs = shared.select("sig", "node", "size").join(active, "node")
    several = runs.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1")
    runs = stage(runs.join(several, "sig"), "runs")
    # Who is in many and large runs is the likeliest to link with the others there.
    weights = runs.groupBy("node").agg(F.sum("n").alias("weight"))
    plain, runs = runs, stage(runs.join(weights, "node"), "weighed")
    release(plain)
    sets = stage(join.sets(rows, nodes, runs.select("node").distinct()), "sets")

    other = [F.col("node").alias("b"), F.col("size").alias("b_size")]
    lead = runs.groupBy("sig").agg(F.max(F.struct("weight", *other)).alias("lead")).select("sig", F.col("lead.weight").alias("b_weight"), "lead.b", "lead.b_size")
    pairs = runs.join(lead, "sig").filter((F.col("node") != F.col("b")) & join.possible(F.col("size"), F.col("b_size")))
    pairs = pairs.groupBy(F.col("node").alias("a")).agg(F.max(F.struct("b_weight", "b")).alias("lead")).select("a", F.col("lead.b").alias("b"))
    links = stage(join.verify(pairs, sets), "links")
    labels = components(links)

    # Whoever is not of a run's largest label meets all others of it that have another.
    members = stage(_mixed(runs, labels), "mixed")
    release(runs)
    if members.limit(1).count():
        rare = stage(_mixed(join.rarest(members.filter(F.col("n") > HOT_RUN), sets), labels), "rarest")
        pairs = _pairs(members.filter(F.col("n") <= HOT_RUN), join).union(_pairs(rare.filter(F.col("n") <= HOT_RUN), join)).distinct()
        more = stage(join.verify(pairs, sets).union(join.blocks(rare.filter(F.col("n") > HOT_RUN), sets)), "links")
        release(members, rare)
        if more.limit(1).count():
            labels = components(links.union(more))

    # The smallest id of each component. Copies were joined at their node first.
    least = nodes.filter("node is not null").groupBy("node").agg(F.min("id").alias("least"))
    least = stage(least.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "least")
    top = least.groupBy("label").agg(F.min("least").alias("component"))
    by_node = attach(least.select("node", "label"), top, ["label"], F.xxhash64("node"), 16).select("node", "component")
    out = attach(nodes, by_node, ["node"], F.xxhash64("id"), 16)
    return out.select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.col("node").alias("set_id"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"),
    )


def keep_first(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, that with the smallest id; all columns stay.

    A document is an id and a text: of rows that repeat both all stay or go together, and rows that repeat an id
    with another text are judged by their own. Rows with a null id, a null or empty text, or no words stay. An
    empty table gives an empty one; column names may be any.
    """
    found = stage(similar_classes(docs, n, num, den, id_col, text_col).withColumnRenamed(id_col, "id").filter("id is not null"), "classes")
    lost = F.col("component_id") < F.col("id")
    fates = found.groupBy("id").agg(F.min(lost).alias("all"), F.max(lost).alias("any"))
    gone = fates.filter("all").select("id", F.lit(None).cast("long").alias("mark"))
    # Ids whose rows differ: the few texts that repeat them tell their sets once more.
    mixed = fates.filter("any and not all").select("id")
    if mixed.limit(1).count():
        rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).join(mixed, "id", "left_semi")
        rows = rows.withColumn("mark", F.xxhash64("text")).distinct()
        signed = _Join(n, num, den).signed(rows.select(F.col("mark").alias("id"), "text").distinct()).filter("own")
        marks = rows.select("id", "mark").join(signed.select(F.col("sig").alias("mark"), F.col("node").alias("set_id")).distinct(), "mark")
        gone = gone.union(found.filter(lost).join(marks, ["id", "set_id"]).select("id", "mark").distinct())
    key, mark = fresh(docs, "_gone"), fresh(docs, "_mark")
    gone = gone.select(F.col("id").alias(key), F.col("mark").alias(mark))
    same = (docs[id_col] == F.col(key)) & (F.col(mark).isNull() | (F.col(mark) == F.xxhash64(text_or_empty(text_col))))
    return docs.join(gone, same, "left_anti")
