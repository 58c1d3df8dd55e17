"""Byte-level BPE as a lazily determinised transducer, and streaming decoding."""

from __future__ import annotations

import base64
import codecs
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..shipping import ship
from .common import fresh, resident, text_or_empty
from .pretokens import Splitter

#: Entries after which a memo is emptied: memory stays bounded on any input.
MEMO = 400_000
#: States that are stored, and pre-tokens that may leave them before a new generation begins.
STATES, MISSES = 30_000, 240_000
#: Ids of a batch that encode gives out.
FLUSH_IDS = 1 << 20
#: Longest pre-token, in bytes, that the memo keeps.
MEMO_BYTES = 48

class Transducer:
    """Reads the bytes of one pre-token, gives its BPE tokens.

    Every prefix of the input has one encoding, and it is the encoding of a shorter prefix
    plus a last token; a token may follow another iff the two, joined and merged from
    scratch, come out as these two. So after each byte it is enough to know the last token of
    each prefix that a later token can still reach back to. All of that is fixed by
    the last token given out and the bytes read since, which is the state. A token is given
    out once every prefix that can still be extended has it in its encoding: at the latest
    after as many bytes as the longest token has.

    States and transitions are made when first met. While STATES of them are stored, the rest of a
    pre-token that leaves them is run through the same rules without being stored; after MISSES
    such pre-tokens all states are given up and made anew from what the input holds by then.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        heads = set()
        for token in ranks:
            heads.update(token[:i] for i in range(1, len(token)))
        self.heads = heads  # proper prefixes of tokens
        #: Of each piece that is a token or begins one: its id or -1, and whether it begins one.
        self.known = {x: (ranks.get(x, -1), x in heads) for x in heads.union(ranks)}
        self.start = (-1, b"")
        self.ids = {self.start: 0}
        self.states = [self.start]
        self.lasts = [((0, -1, 0),)]
        self.next: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.misses = 0

    def _renew(self) -> None:
        """Gives up all states but the first."""
        del self.states[1:], self.lasts[1:], self.next[1:]
        self.next[0].clear()
        self.ids = {self.start: 0}
        self.misses = 0

    def _merge(self, data: bytes) -> list[bytes]:
        """The merges applied by rank, from single bytes."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get = self.ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        if a < 0:
            return True
        key = (a, b)
        ok = self.pairs.get(key)
        if ok is None:
            x, y = self.bytes_of[a], self.bytes_of[b]
            ok = self.pairs[key] = self._merge(x + y) == [x, y]
        return ok

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        committed, pending = self.states[state]
        # (end, token, start of that token) for each prefix of pending, beginning with the empty one.
        table = {end: (token, begin) for end, token, begin in self.lasts[state]}
        data = pending + bytes([byte])
        n = len(data)
        for begin in range(max(0, n - self.longest), n):
            token = self.ranks.get(data[begin:])
            if token is not None and begin in table and self.follows(table[begin][0], token):
                table[n] = (token, begin)
                break
        else:
            raise ValueError(f"no token ends at byte {byte}: the vocabulary lacks single bytes")
        # Prefixes that a later token can begin at: the end, and where data[p:] begins a token.
        # What all of their encodings have in common is settled.
        open_ends = {p for p in range(max(0, n - self.longest + 1), n) if p in table and data[p:] in self.heads}
        open_ends.add(n)
        kept = set(open_ends)
        while len(open_ends) > 1:
            p = max(open_ends)
            open_ends.remove(p)
            open_ends.add(table[p][1])
            kept.add(table[p][1])
        shared = open_ends.pop()
        out: list[int] = []
        p = shared
        while p:
            token, p = table[p]
            out.append(token)
        out.reverse()
        lasts = tuple((p - shared, table[p][0], table[p][1] - shared) for p in sorted(kept) if p >= shared)
        key = (out[-1] if out else committed, data[shared:])
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.states)
            self.states.append(key)
            self.lasts.append(lasts)
            self.next.append({})
        found = self.next[state][byte] = (to, tuple(out))
        return found

    def _simulate(self, state: int, rest: bytes) -> list[int]:
        """As stepping through rest and ending, without making states."""
        pending = self.states[state][1]
        table = {end: (token, begin) for end, token, begin in self.lasts[state]}
        data, known, pairs = pending + rest, self.known.get, self.pairs
        n0 = len(pending)
        live = [p for p in sorted(table) if p < n0 and data[p:n0] in self.heads]
        live.append(n0)
        for n in range(n0 + 1, len(data) + 1):
            still, last = [], None
            for begin in live:
                found = known(data[begin:n])
                if found is None:
                    continue
                token, more = found
                if more:
                    still.append(begin)
                if last is None and token >= 0:
                    before = table[begin][0]
                    ok = pairs.get((before, token))
                    if ok is None:
                        ok = self.follows(before, token)
                    if ok:
                        last = (token, begin)
            if last is None:
                raise ValueError("the vocabulary lacks single bytes")
            table[n] = last
            still.append(n)
            live = still
        return self._unwind(table, len(data))

    @staticmethod
    def _unwind(table: dict[int, tuple[int, int]], p: int) -> list[int]:
        out = []
        while p:
            token, p = table[p]
            out.append(token)
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        if len(self.pairs) > MEMO:
            self.pairs.clear()
        if self.misses >= MISSES:
            self._renew()
        state, out, moves = 0, [], self.next
        for i, byte in enumerate(data):
            found = moves[state].get(byte)
            if found is None:
                if len(self.states) >= STATES:
                    self.misses += 1
                    return out + self._simulate(state, data[i:])
                found = self._step(state, byte)
            state, given = found
            if given:
                out += given
        # The end of the input settles the rest.
        table = {end: (token, begin) for end, token, begin in self.lasts[state]}
        return out + self._unwind(table, len(self.states[state][1]))


class Memo(dict):
    """Pre-token to its ids, written in decimal and joined by spaces."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, piece: str) -> str:
        data = piece.encode("utf-8", "replace")
        whole = self.machine.ranks.get(data)  # as the library does: a listed pre-token is one token
        out = str(whole) if whole is not None else " ".join(map(str, self.machine.encode(data)))
        if len(data) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = out
        return out


class StreamDecoder:
    """Token ids in, text out, at any cut between them.

    A token may end inside a character; the incremental UTF-8 machine keeps its state (the
    bytes of an unfinished character) until the next token. Bytes that are no UTF-8 become
    U+FFFD, an unfinished character at the end too.
    """

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def decode_stream(bytes_of: dict[int, bytes], ids: list[int], step: int = 8192) -> Iterator[str]:
    decoder = StreamDecoder(bytes_of)
    for i in range(0, len(ids), step):
        yield decoder.feed(ids[i : i + step])
    yield decoder.finish()


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = Splitter(pattern)
        self.machine = Transducer(ranks)
        self.memo = Memo(self.machine)
        self.text_bytes = {str(v): k for k, v in ranks.items()}

    def encode_text(self, text: str) -> str:
        """The ids of the whole text, joined by spaces."""
        return " ".join(map(self.memo.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        joined = self.encode_text(text)
        return list(map(int, joined.split(" "))) if joined else []

    def decode(self, ids: list[int]) -> str:
        return "".join(decode_stream(self.machine.bytes_of, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process; the vocabulary is read on the executor."""
    return resident(("bpe", path, pattern), lambda: Codec(read_ranks(path), pattern))


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_tokens, ids_sha256, decoded_sha256, exact.

    Null texts are empty ones: no tokens, and the digest of nothing. ``exact`` tells whether
    decoding gave the text back. Rows that repeat an id or a text are rows of their own; a text of
    any length is read whole, its ids decoded in parts. Only the two columns named are read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def run(batches):
        c = codec(path, pattern)
        lookup = c.text_bytes.__getitem__
        for batch in batches:
            n, ids_sha, out_sha, exact = [], [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                joined = c.encode_text(text)
                ids = joined.split(" ") if joined else []
                machine, back, same = codecs.getincrementaldecoder("utf-8")("replace"), hashlib.sha256(), []
                for i in range(0, len(ids), 16_384):
                    part = b"".join(map(lookup, ids[i : i + 16_384]))
                    back.update(part)
                    same.append(machine.decode(part))
                same.append(machine.decode(b"", True))
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                out_sha.append(back.hexdigest())
                exact.append("".join(same) == text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string()), pa.array(exact, pa.bool_())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"],
            )

    kind = dict(rows.dtypes)["id"]
    out = rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")
    return out.withColumnRenamed("id", id_col)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """docs without the text and with its token ids as ``array<int>``.

    Null and empty texts give []. Texts of any length are encoded whole, repeated rows each by
    itself. Where docs has a column ``out_col`` already, that one stays and the ids get the name with
    underscores in front. Ids are held as 32-bit numbers and given out by about FLUSH_IDS, so a worker's
    memory does not grow with the rows of a batch.
    """
    ship(docs.sparkSession)
    out_col = fresh(docs, out_col)
    rest = [c for c in docs.columns if c != text_col]
    schema = StructType([*(docs.schema[c] for c in rest), StructField(out_col, ArrayType(IntegerType()))])

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            texts, begin, ends, ids = batch.column(len(rest)), 0, array("i", [0]), array("i")
            for i in range(len(texts)):
                joined = c.encode_text(texts[i].as_py())
                if joined:
                    ids.extend(map(int, joined.split(" ")))
                ends.append(len(ids))
                if len(ids) >= FLUSH_IDS or i + 1 == len(texts):
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                    kept = [batch.column(k).slice(begin, len(lists)) for k in range(len(rest))]
                    yield pa.RecordBatch.from_arrays([*kept, lists], schema.names)
                    begin, ends, ids = i + 1, array("i", [0]), array("i")

    return docs.select(*rest, text_or_empty(text_col)).mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", out_col: str = "text") -> DataFrame:
    """docs with the text of its token ids; null ids give a null text."""
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def text(ids):
        c = codec(path, pattern)
        return ids.map(lambda x: None if x is None else c.decode(list(x)))

    return docs.withColumn(out_col, text(F.col(ids_col)))
