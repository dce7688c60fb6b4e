"""Operator 4: token ids in grammar-compressed shard files.

Documents are dealt by ranges of doc_id and sorted, so shards hold them in ascending order.  Each shard of about SHARD_TOKENS ids
is compressed by Re-Pair: pairs of neighbouring symbols are counted, frequent pairs become nonterminals, most frequent first, and the
sequence is rewritten, until no pair pays.  A round replaces many pairs at once: a symbol is either a left or a
right side in it, so no two replacements overlap; a pair of equal symbols takes every second place of a run.  A shard
stores rules, the expansion length of each rule, the sequence and each document's count, so ids at any
offset are decoded from the symbols that cover them.

A shard is one binary value: the magic ``RPS1``, a header of little-endian 64-bit counts (documents, ids, rules, symbols,
first nonterminal, bytes of an id), then arrays: doc ids, their null flags, ids of each document, rules (left, right), expansion lengths,
symbols.  Shards are rows of Parquet files with their partition and number, whose order is the order of the ids.

Text is cut at spaces and line ends, which no token spans; each distinct piece is encoded by the tokenizers library once for
each worker and kept in a bounded table.  A piece that is a Latin word, with or without closing marks, goes straight to the
library's merge model in the form that its normalizer and splitter would give it; all others take the whole way.

Edge cases: null and empty texts have the end id alone; texts of any length (one longer than a shard has a shard to
itself); null doc ids come first; repeated rows are kept; an empty table gives no shard and an empty result.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, partitions, written

SHARD_TOKENS = 1 << 20
#: Most rounds; occurrences from which a rule of sixteen bytes pays; share of the symbols below which rounds end.
ROUNDS, MIN_PAIRS, MIN_GAIN = 16, 8, 0.02
TABLE_ENTRIES = 1_200_000
TABLE_CHARS = 64
MAGIC = b"RPS1"
#: Marks that may close a word, and the end of the Latin letters, for the short way of encoding.
MARKS, LATIN_END = ".,!?;:*$%&#|", "\u0250"


def pair_keys(left: np.ndarray, right: np.ndarray, narrow: bool) -> np.ndarray:
    """Pairs as one number each: two 16-bit halves while symbols are that few, else two 32-bit halves."""
    if narrow:
        return left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
    return left.astype(np.uint64) << np.uint64(32) | right


def frequent_pairs(seq: np.ndarray, least: int, narrow: bool) -> np.ndarray:
    """Pairs of neighbours that occur ``least`` times or more, most frequent first."""
    keys = pair_keys(seq[:-1], seq[1:], narrow)
    keys.sort()
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    n = np.diff(edges)
    often = np.flatnonzero(n >= least)
    often = often[np.lexsort((keys[edges[often]], -n[often]))]
    return keys[edges[often]]


def choose(lefts: list[int], rights: list[int]) -> list[int]:
    """Which of the pairs, in order of frequency, to replace together: no symbol is on both sides, twins stand alone."""
    left, right, twin = set(), set(), set()
    take = []
    for i, (a, b) in enumerate(zip(lefts, rights, strict=True)):
        if a == b:
            if a not in left and a not in right:
                twin.add(a)
                take.append(i)
        elif a not in right and b not in left and a not in twin and b not in twin:
            left.add(a)
            right.add(b)
            take.append(i)
    return take


def re_pair(seq: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Rules (n, 2) and the sequence over them; rule i stands for symbol ``first + i``."""
    seq = seq.astype(np.uint32)
    rules: list[np.ndarray] = []
    made = 0
    for _ in range(ROUNDS):
        n = len(seq)
        if n < 2 * MIN_PAIRS:
            break
        narrow = first + made <= 1 << 16
        pairs = frequent_pairs(seq, MIN_PAIRS, narrow)
        half = 16 if narrow else 32
        sides = [(pairs >> pairs.dtype.type(half)).astype(np.int64), (pairs & pairs.dtype.type((1 << half) - 1)).astype(np.int64)]
        take = np.array(choose(*(x.tolist() for x in sides)), np.int64)
        if not len(take):
            break
        take = take[np.argsort(pairs[take])]
        chosen, lefts, rights = pairs[take], sides[0][take], sides[1][take]
        is_left, is_right = np.zeros(first + made, bool), np.zeros(first + made, bool)
        is_left[lefts] = True
        is_right[rights] = True
        at = np.flatnonzero(is_left[seq[:-1]] & is_right[seq[1:]])
        keys = pair_keys(seq[at], seq[at + 1], narrow)
        rule = np.searchsorted(chosen, keys)
        rule[rule == len(chosen)] = 0
        hit = chosen[rule] == keys
        at, rule = at[hit], rule[hit]
        if (lefts == rights).any():
            same = lefts[rule] == rights[rule]
            start = np.concatenate([[True], ~(same[1:] & same[:-1] & (at[1:] == at[:-1] + 1))])
            since = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
            keep = ~same | (since % 2 == 0)
            at, rule = at[keep], rule[keep]
        # a pair that lost its places to a run of equal symbols gets no rule
        used = np.bincount(rule, minlength=len(chosen)) > 0
        number = np.cumsum(used) - 1
        seq[at] = (first + made + number[rule]).astype(np.uint32)
        keep = np.ones(n, bool)
        keep[at + 1] = False
        seq = seq[keep]
        rules.append(np.stack([lefts[used], rights[used]], axis=1).astype(np.uint32))
        made += int(used.sum())
        if len(at) < MIN_GAIN * n:
            break
    return (np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)), seq


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each rule stands for; a rule only names earlier ones."""
    size = np.ones(first + len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        size[first + i] = size[a] + size[b]
    return size[first:]


class Shard:
    """A shard read from its bytes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard")
        docs, self.n_ids, rules, symbols, self.first, width = struct.unpack_from("<6q", data, 4)
        at = 52

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += got.nbytes
            return got

        self.doc_ids, self.none, self.counts = take("<i8", docs), take("u1", docs).astype(bool), take("<i8", docs)
        self.rules, self.lengths, self.symbols = take("<u4", 2 * rules).reshape(-1, 2), take("<i8", rules), take(f"<u{width}", symbols)
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)])
        self._ends: np.ndarray | None = None

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        while (deep := symbols >= self.first).any():
            out = np.empty(len(symbols) + int(deep.sum()), np.int64)
            at = np.arange(len(symbols)) + np.cumsum(deep) - deep
            out[at] = np.where(deep, self.rules[np.where(deep, symbols - self.first, 0), 0] if len(self.rules) else 0, symbols)
            out[at[deep] + 1] = self.rules[symbols[deep] - self.first, 1]
            symbols = out
        return symbols.astype("<u4")

    def ids(self) -> np.ndarray:
        """All ids, by a table of every rule's expansion."""
        if not len(self.rules):
            return self.symbols.astype("<u4")
        size = np.concatenate([np.ones(self.first, np.int64), self.lengths])
        table = self._expand(np.arange(self.first, self.first + len(self.rules)))
        starts = np.concatenate([np.arange(self.first), self.first + np.cumsum(self.lengths) - self.lengths])
        table = np.concatenate([np.arange(self.first, dtype="<u4"), table])
        n = size[self.symbols]
        ends = np.cumsum(n)
        return table[np.repeat(starts[self.symbols] - (ends - n), n) + np.arange(int(ends[-1]))]

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``, from the symbols that cover them alone."""
        if self._ends is None:
            size = np.concatenate([np.ones(self.first, np.int64), self.lengths])
            self._ends = np.cumsum(size[self.symbols])
        start, stop = max(0, start), min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, "<u4")
        a, b = np.searchsorted(self._ends, start, "right"), np.searchsorted(self._ends, stop - 1, "right") + 1
        before = int(self._ends[a - 1]) if a else 0
        return self._expand(self.symbols[a:b])[start - before : stop - before]

    def document(self, i: int) -> np.ndarray:
        return self.slice(int(self.offsets[i]), int(self.offsets[i + 1]))


def pack(doc_ids: list[int | None], ids: list[np.ndarray], first: int) -> bytes:
    """The bytes of a shard; ``first`` is above every id."""
    seq = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    rules, symbols = re_pair(seq, first)
    width = 2 if first + len(rules) <= 1 << 16 else 4
    head = struct.pack("<6q", len(doc_ids), len(seq), len(rules), len(symbols), first, width)
    none = np.array([d is None for d in doc_ids], "u1")
    return b"".join([
        MAGIC, head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), none.tobytes(), np.array([len(x) for x in ids], "<i8").tobytes(),
        rules.astype("<u4").tobytes(), expansion_lengths(rules, first).astype("<i8").tobytes(), symbols.astype(f"<u{width}").tobytes(),
    ])


def _byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies: itself, or the next one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in shown)
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


class Encoder(dict):
    """Encodes texts by a tokenizers file; the table of ids by piece fills itself."""

    def __init__(self, file: str):
        super().__init__({"": b""})
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(file)
        self.size = self.lib.get_vocab_size(with_added_tokens=True)
        self.model, self.letters = self.lib.model, _byte_letters()
        self.closing: dict[str, bytes] = {}
        # the short way is taken only where it agrees with the whole way on words of every Latin letter
        probe = [chr(c) * 2 for c in range(65, ord(LATIN_END)) if chr(c).isalpha() and chr(c).lower().isalpha()]
        self.plain = all(
            [t.id for t in self.model.tokenize(p.lower().encode().decode("latin-1").translate(self.letters))] == self.lib.encode(p, add_special_tokens=False).ids
            for p in probe if max(p.lower()) < LATIN_END and is_normalized("NFC", p)
        ) and all(self.lib.encode("ab" + m, add_special_tokens=False).ids == [*self.lib.encode("ab", add_special_tokens=False).ids, *self.lib.encode(m, add_special_tokens=False).ids] for m in MARKS)

    def marks(self, text: str) -> bytes:
        got = self.closing.get(text)
        if got is None:
            got = array("I", self.lib.encode(text, add_special_tokens=False).ids).tobytes()
            if len(self.closing) < 10_000:
                self.closing[text] = got
        return got

    def __missing__(self, piece: str) -> bytes:
        word = piece.rstrip(MARKS)
        low = word.lower()
        if self.plain and low.isalpha() and (low.isascii() or max(low) < LATIN_END and is_normalized("NFC", word)):
            shown = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
            got = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            if len(word) < len(piece):
                got += self.marks(piece[len(word) :])
        else:
            got = array("I", self.lib.encode(piece, add_special_tokens=False).ids).tobytes()
        if len(piece) <= TABLE_CHARS:
            if len(self) >= TABLE_ENTRIES:
                self.clear()
            self[piece] = got
        return got

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        return np.frombuffer(b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))), "<u4")


@lru_cache(maxsize=2)
def encoder(file: str) -> Encoder:
    """One per worker process, with its table."""
    return Encoder(file)


def write_shards(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """The shards of ``docs`` (doc_id, text) as a written table: part, no, n_ids, shard."""
    bound_batches(docs.sparkSession)
    n = partitions(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(n, "doc_id", "row").sortWithinPartitions("doc_id", "row").drop("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer_file)
        end = np.array([end_id], "<u4")
        first = max(enc.size, end_id + 1)
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.array([size], pa.int64()), pa.array([pack(doc_ids, held, first)], pa.binary())], ["part", "no", "n_ids", "shard"])

        for b in batches:
            for d, ids in zip(b.column(0).to_pylist(), map(enc.encode, b.column(1).to_pylist()), strict=True):
                if held and size + len(ids) >= SHARD_TOKENS:
                    yield shard()
                    no, doc_ids, held, size = no + 1, [], [], 0
                doc_ids.append(d)
                held.append(np.concatenate([ids, end]))
                size += len(ids) + 1
        if held:
            yield shard()

    return written(rows.mapInArrow(run, "part int, no int, n_ids long, shard binary"), "token-shards")


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, no, start): ids before each shard, by sums of partitions and then within each."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row for each partition
    within = Window.partitionBy("part").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    return shards.select("part", "no", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("inner")).join(F.broadcast(parts), "part").select("part", "no", (F.col("base") + F.col("inner")).alias("start"))


def read_documents(shards: DataFrame) -> DataFrame:
    """One row per document, decoded from ``shards``: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, no, data in zip(*(b.column(i) for i in range(3)), strict=True):
                s = Shard(data.as_py())
                ids = s.ids()
                crc = [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * n, pa.int32()), pa.array([no.as_py()] * n, pa.int32()), pa.array(s.doc_ids, pa.int64(), mask=s.none), pa.array(s.offsets[:-1]), pa.array(s.counts), pa.array(crc, pa.int64())],
                    ["part", "no", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    rows = shards.select("part", "no", "shard").mapInArrow(run, "part int, no int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    out = rows.join(shard_starts(shards.select("part", "no", "n_ids")), ["part", "no"])
    return out.select("doc_id", (F.col("start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
