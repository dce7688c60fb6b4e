"""Operator 5: byte-level BPE encoding and decoding.

A pre-token is merged with a hierarchical-bitmap rank queue.  Each merge rank has a bucket of linked-list
positions; two levels of 256-way bitmaps say which buckets hold any, and find-first-set walks them to the
lowest rank, whose positions are taken from left to right.  Entries whose pair has changed since are stale and
skipped.  A merge costs the same at any length, so a pre-token of millions of bytes stays near-linear.  Many
pre-tokens share one queue, laid end to end: no pair crosses an end, so each is merged as it would be alone,
and finding the lowest rank is paid once for all of its positions.

Text is cut where a token must begin anyway: before a single space between two non-blank characters.  Such
chunks repeat, so their ids are kept in a bounded table per worker; every other text takes the whole
pattern.  The result is the same on both ways.

Edge cases: null and empty texts give no ids and decode to no bytes; texts may be of any length;
repeated rows give repeated results; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bound_batches, fresh

#: Entries of each table of known chunks and pre-tokens, and the longest chunk kept.
TABLE_ENTRIES = 600_000
TABLE_CHARS = 48
#: Bytes of pre-tokens that share a queue, and characters of texts whose unknown chunks are met together.
QUEUE_BYTES = 1 << 13
TOGETHER_CHARS = 2 << 20
#: The single bits, for words of 256 and for the word that tells which of them have any.
_BIT = [1 << i for i in range(4096)]


class _Irregular(Exception):
    """A chunk whose ends are blank: its text is cut by the whole pattern instead."""


class _Table(dict):
    """Ids by chunk, filled when asked."""

    def __init__(self, make, room: int):
        super().__init__()
        self.make, self.room = make, room

    def __missing__(self, key):
        got = self.make(key)
        if len(key) <= TABLE_CHARS:
            if len(self) >= self.room:
                self.clear()
            self[key] = got
        return got


class ByteBPE:
    """Encodes and decodes by a rank file and a splitting pattern."""

    def __init__(self, rank_file: str, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(rank_file).read_bytes().splitlines())}
        self.vocab = {r: t for t, r in self.ranks.items()}
        self.names = {r: str(r) for r in self.vocab}
        self.find = regex.compile(pattern).findall
        self.words = [0] * ((max(self.vocab) >> 8) + 1)
        self.pieces = _Table(lambda piece: self.merge(piece.encode()), TABLE_ENTRIES // 2)
        self.heads = _Table(self._head, TABLE_ENTRIES // 4)
        self.tails = _Table(self._tail, TABLE_ENTRIES)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        return self.merge_all([piece])[0] if whole is None else (whole,)

    def merge_all(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each pre-token, none of which is a token itself."""
        get, words = self.ranks.get, self.words
        piece, top, one = b"".join(pieces), 0, _BIT
        n, ends = len(piece), list(accumulate(map(len, pieces)))
        edge = bytearray(n + 1)  # where a pre-token begins
        edge[0] = 1
        for i in ends:
            edge[i] = 1
        buckets: dict[int, list[int]] = {}  # rank -> positions; a bit of ``words`` for each, a bit of ``top`` for each word
        pair = [get(piece[i : i + 2]) for i in range(n)]
        for i in ends:
            pair[i - 1] = None
        for i, rank in enumerate(pair):
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    words[rank >> 8] |= one[rank & 255]
                    top |= one[rank >> 8]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while top:
            w = (top & -top).bit_length() - 1
            bits = words[w]
            bit = (bits & -bits).bit_length() - 1
            rank = w << 8 | bit
            words[w] = bits = bits & (bits - 1)
            if not bits:
                top &= top - 1
            at = buckets.pop(rank)
            if len(at) > 1:
                at.sort()
            done = 0
            for i in at:
                done += 1
                if pair[i] != rank:  # stale
                    continue
                j = after[i]
                k = after[j]
                pair[j] = None
                after[i] = k
                sooner = False
                if not edge[k]:
                    before[k] = i
                    pair[i] = new = get(piece[i : after[k]])
                    if new is not None:
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            buckets[new] = [i]
                            words[new >> 8] |= one[new & 255]
                            top |= one[new >> 8]
                        sooner = new <= rank
                else:
                    pair[i] = None
                if not edge[i]:
                    h = before[i]
                    pair[h] = new = get(piece[h:k])
                    if new is not None:
                        if new in buckets:
                            buckets[new].append(h)
                        else:
                            buckets[new] = [h]
                            words[new >> 8] |= one[new & 255]
                            top |= one[new >> 8]
                        sooner = sooner or new <= rank
                if sooner and done < len(at):  # what has come up goes before the rest of this bucket
                    buckets.setdefault(rank, []).extend(at[done:])
                    words[w] |= one[bit]
                    top |= one[w]
                    break
        out, i = [], 0
        for end in ends:
            ids = []
            while i < end:
                k = after[i]
                ids.append(get(piece[i:k]))
                i = k
            out.append(tuple(ids))
        return out

    def _split(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, self.find(text))))

    def _head(self, chunk: str) -> tuple[int, ...]:
        if not chunk or chunk[-1].isspace():
            raise _Irregular
        return self._split(chunk)

    def _tail(self, chunk: str) -> tuple[int, ...]:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Irregular
        pieces = self.find(" " + chunk)
        return self.merge(pieces[0].encode()) if len(pieces) == 1 else tuple(chain.from_iterable(map(self.pieces.__getitem__, pieces)))

    def learn(self, chunks: set[str]) -> None:
        """Puts the ids of unknown chunks into the table, as far as it takes them; what it does not take is merged when its turn comes."""
        new = [c for c in chunks - self.tails.keys() if c and len(c) <= TABLE_CHARS and c.strip() == c][:TABLE_ENTRIES]
        for a in range(0, len(new), step := TABLE_ENTRIES // 16):
            cut = [(c, self.find(" " + c)) for c in new[a : a + step]]
            got: dict[str, tuple[int, ...]] = {}
            pieces, size = [], 0
            for piece in set(chain.from_iterable(x for _, x in cut)):
                if (known := self.pieces.get(piece)) is not None:
                    got[piece] = known
                    continue
                data = piece.encode()
                whole = self.ranks.get(data)
                if whole is not None:
                    got[piece] = (whole,)
                    continue
                pieces.append((piece, data))
                size += len(data)
                if size >= QUEUE_BYTES:
                    got.update(zip((p for p, _ in pieces), self.merge_all([d for _, d in pieces]), strict=True))
                    pieces, size = [], 0
            if pieces:
                got.update(zip((p for p, _ in pieces), self.merge_all([d for _, d in pieces]), strict=True))
            for table, found in ((self.pieces, got), (self.tails, {c: got[x[0]] if len(x) == 1 else tuple(chain.from_iterable(map(got.__getitem__, x))) for c, x in cut})):
                if len(table) + len(found) > table.room:
                    table.clear()
                table.update(found)

    def encode_all(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each text; what their chunks have in common is merged once."""
        a = 0
        while a < len(texts):
            z, size = a, 0
            while z < len(texts) and size < TOGETHER_CHARS:
                size += len(texts[z] or "")
                z += 1
            self.learn(set(chain.from_iterable((t or "").split(" ")[1:] for t in texts[a:z])))
            yield from map(self.encode, texts[a:z])
            a = z

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        chunks = text.split(" ")
        try:
            head = self.heads[chunks[0]]
            return [*head, *chain.from_iterable(map(self.tails.__getitem__, chunks[1:]))]
        except _Irregular:
            return list(chain.from_iterable(map(self.pieces.__getitem__, self.find(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))

    def named(self, ids: Iterable[int]) -> str:
        """The ids in decimal, joined by commas."""
        return ",".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(rank_file: str, pattern: str) -> ByteBPE:
    """One per worker process, with its tables."""
    return ByteBPE(rank_file, pattern)


def encode_column(docs: DataFrame, rank_file: str, pattern: str, column: str = "text", ids: str = "ids", decodes: str | None = None) -> DataFrame:
    """``docs`` with the ids of ``column`` as an array; every other column as it was (a taken name gets an underscore).

    ``decodes`` names one more column: whether the ids decode to the bytes of the text.
    """
    bound_batches(docs.sparkSession)
    made = fresh(docs, *(x for x in (ids, decodes) if x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(rank_file, pattern)
        for b in batches:
            texts = b.column(b.schema.get_field_index(column)).to_pylist()
            got = list(bpe.encode_all(texts))
            new = [pa.array(got, pa.list_(pa.int32()))]
            if decodes:
                new.append(pa.array([bpe.decode(x) == (t or "").encode() for x, t in zip(got, texts, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *made])

    return docs.mapInArrow(run, _schema(docs) + f", `{made[0]}` array<int>" + f", `{made[-1]}` boolean" * bool(decodes))


def decode_column(encoded: DataFrame, rank_file: str, pattern: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of the ids; null ids give no bytes, a taken name gets an underscore."""
    bound_batches(encoded.sparkSession)
    data, = fresh(encoded, data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(rank_file, pattern)
        for b in batches:
            got = pa.array([bpe.decode(x or ()) for x in b.column(b.schema.get_field_index(ids)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, got], [*b.schema.names, data])

    return encoded.mapInArrow(run, _schema(encoded) + f", `{data}` binary")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """One row per document: number of ids, their digest, and the digest of the bytes decoded from them."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(rank_file, pattern)
        for b in batches:
            counts, ids_sha, text_sha = [], [], []
            for ids in bpe.encode_all(b.column(1).to_pylist()):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(bpe.named(ids).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
