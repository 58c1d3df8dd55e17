"""Token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers

from ..shipping import ship
from .common import resident, text_or_empty
from .pretokens import Splitter, is_latin

#: Entries after which the memo of pre-token counts is emptied.
MEMO = 600_000
#: Longest pre-token, in characters, that the memo keeps.
MEMO_CHARS = 48
#: Bytes of new pre-tokens that are merged together.
MERGE_BYTES = 1 << 21
#: Characters from which on a pre-token's rounds keep the places of each rank: rounds over the whole of it,
#: one for each rank, would take time with the square of its length.
LONG = 4096
NONE = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


class Counter:
    """Counts as the library's tokenizer file tells: added tokens, normalizer, splitter, BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.path = path
        self.agreed: set[str] = set()
        added = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.split = Splitter(split["pattern"]["Regex"])
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.width = len(vocab)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.memo: dict[str, int] = {}

    def _ranks(self, sym: np.ndarray) -> np.ndarray:
        """Rank of each neighbouring pair, NONE where the vocabulary has no merge."""
        key = sym[:-1] * self.width + sym[1:]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def merge_long(self, data: bytes) -> int:
        """Symbols left of one long piece: as ``merge``, with the places of each rank kept in arrays.

        A round takes the lowest rank there is, replaces all its places at once and files the pairs
        that come about under their ranks, so a round costs what it changes and not the piece's length."""
        sym = self.first[np.frombuffer(data, np.uint8)]
        sym[-1] = self.last[data[-1]]
        n = len(sym)
        # one more place at the end, which is before the first and after the last and pairs with nothing
        sym = np.append(sym, -1)
        before, after = np.append(n, np.arange(n)), np.append(np.arange(1, n + 1), 0)
        before[n] = n - 1
        places: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def rank_at(at: np.ndarray) -> np.ndarray:
            x, y = sym[at], sym[after[at]]
            key = x * self.width + y
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            return np.where((x >= 0) & (y >= 0) & (self.keys[found] == key), self.rank[found], NONE)

        def file(at: np.ndarray) -> None:
            rank = rank_at(at)
            at, rank = at[rank < NONE], rank[rank < NONE]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            heads = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else []
            for r, part in zip(rank[heads].tolist() if len(rank) else [], np.split(at, heads[1:]), strict=False):
                if r not in places:
                    places[r] = []
                    heapq.heappush(waiting, r)
                places[r].append(part)

        file(np.arange(n - 1))
        left = n
        while waiting:
            r = heapq.heappop(waiting)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[rank_at(at) == r]  # the others have merged otherwise since
            if not len(at):
                continue
            # In a run of overlapping places (equal symbols), every second one counts.
            begin = np.maximum.accumulate(np.where(np.append(True, after[at[:-1]] != at[1:]), np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            gone = after[at]
            sym[at], sym[gone] = self.made[r], -1
            after[at] = after[gone]
            before[after[at]] = at
            left -= len(at)
            file(np.unique(np.concatenate([before[at], at])))
        return left

    def merge(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each piece (none empty) after all merges.

        All pieces lie end to end in one array. In each round every piece takes the lowest
        rank among its own pairs and replaces all places of that pair, from the left where
        they overlap; pieces without a pair are done and leave the array.
        """
        counts = np.array([len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(counts)
        sym = self.first[data]
        sym[ends - 1] = self.last[data[ends - 1]]
        owner = np.repeat(np.arange(len(pieces)), counts)
        while len(sym) > 1:
            rank = np.append(self._ranks(sym), NONE)
            rank[:-1][owner[:-1] != owner[1:]] = NONE
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, heads)
            lengths = np.diff(np.append(heads, len(sym)))
            low = np.repeat(lowest, lengths)
            hit = (rank == low) & (low < NONE)
            if not hit.any():
                break
            # In a run of overlapping places (equal symbols), every second one counts.
            at = np.flatnonzero(hit)
            run = np.append(True, np.diff(at) > 1)
            begin = np.maximum.accumulate(np.where(run, at, 0))
            at = at[(at - begin) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            live = low < NONE
            np.subtract.at(counts, owner[at], 1)
            keep &= live
            sym, owner = sym[keep], owner[keep]
        return counts

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    @cached_property
    def disputed(self) -> set[str]:
        """Marks that the library orders or composes otherwise than this interpreter does."""
        out, nfc = set(), normalizers.NFC()
        for c in map(chr, range(0x300, 0x110000)):
            if unicodedata.combining(c) or unicodedata.decomposition(c):
                apart = unicodedata.normalize("NFD", c)
                for s in (apart, f"a{c}\u0307", f"a{c}\u0323"):
                    if nfc.normalize_str(s) != unicodedata.normalize("NFC", s):
                        out |= {c, *apart[1:]}
        return out

    def differ(self, text: str) -> bool:
        for c in set(text) - self.agreed:
            if unicodedata.category(c) == "Cn" or c in self.disputed:
                return True
            self.agreed.add(c)
        return False

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if not is_latin(text):
            text = unicodedata.normalize("NFC", text)
        # Each letter by itself: a final sigma is no special case. White space is left as it is:
        # the pattern drops it, one space or many.
        return text.replace("Σ", "σ").lower()

    def _grow(self, memo: dict[str, int], pieces: set[str]) -> None:
        """Adds the counts of these pre-tokens to memo."""
        batch: list[str] = []
        size = 0
        for p in [*sorted(pieces, key=len), None]:
            if p is not None and len(p) >= LONG:
                memo[p] = self.merge_long(p.encode("utf-8", "replace"))
                continue
            if batch and (p is None or size > MERGE_BYTES):
                memo.update(zip(batch, self.merge([q.encode("utf-8", "replace") for q in batch]).tolist(), strict=True))
                batch, size = [], 0
            if p is not None:
                batch.append(p)
                size += len(p)

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings.

        Case, composition and classes of letters come from this interpreter's Unicode tables. Where a text
        holds a character on which the library's tables may differ, being newer or older, its own
        normalizer and splitter are asked."""
        if is_latin(text) or not self.differ(text):
            return self.split(self.normal(text))
        normal = self.library.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens, and how many special strings stand between them."""
        if self.special is None or not self.special.search(text):
            return self.words(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in self.words(part)], len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; pre-tokens repeat, so each is merged when first met."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        split = [self.pieces(t) for t in texts]
        new = set().union(*(ps for ps, _ in split)).difference(memo)
        if new:
            self._grow(memo, new)
        get = memo.__getitem__
        out = [sum(map(get, ps)) + n for ps, n in split]
        for p in new:
            if len(p) > MEMO_CHARS:
                del memo[p]
        return out


def counter(path: str) -> Counter:
    return resident(("counter", path), lambda: Counter(path))


def token_counts(
    docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 1 << 20
) -> DataFrame:
    """One row for each document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null texts are empty: no bytes, no tokens. Special strings inside a text are one token
    each, as the library has them by default. Texts are taken together up to ``batch_chars``
    characters, so a batch of long texts needs no more memory than one of short ones.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def run(batches):
        c = counter(path)
        for batch in batches:
            counts: list[int] = []
            held: list[str] = []
            chars = 0
            for text in batch.column("text"):
                held.append(text.as_py())
                chars += len(held[-1])
                if chars >= batch_chars:
                    counts += c.count(held)
                    held, chars = [], 0
            counts += c.count(held)
            size = pc.cast(pc.binary_length(batch.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), size, pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = dict(rows.dtypes)["id"]
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

