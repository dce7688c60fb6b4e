"""Operator 3: benchmark decontamination by the q-gram lemma.

An item of n characters that occurs in a text with at most e edits shares at least ``n - Q + 1 - Q * e`` q-grams with it,
all on diagonals (place in the text less place in the item) that lie within e of each other.  So the shared q-grams of each
item are counted in overlapping bands of diagonals, each twice as wide as a match can wander, and only bands
that reach the bound are aligned.  Counting is in chunks of PAIRS shared places, and a gram that items have at more than OFTEN places (a long
run of one letter) is counted by blocks of places, which bounds its share of a band from above: its cost does not grow with
places in the text times places in the items.  Aligning is a banded dynamic programme, free at both ends of the text, finds the fewest edits.  The
budget e is RATE of the item's characters, less where the bound would fall below one q-gram.

Text and items are compared in lower-case ASCII with every ASCII blank as a space, so places stay those of the text.  Items
come in blocks of bounded size to every task; a text longer than SEGMENT is scanned in overlapping segments.

Edge cases: null and empty texts hold nothing; null and empty items occur nowhere; items shorter than Q must occur
unedited; repeated documents and items each get rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fresh, written

Q, RATE = 8, 0.1
#: Characters of items that a task holds at once, and of text that it scans at once.
ITEM_CHARS, SEGMENT = 2 << 20, 1 << 20
#: Places of a gram in items from which it is counted by blocks, and pairs of places that are held at once.
OFTEN, PAIRS = 64, 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22


def codes(text: str) -> np.ndarray:
    """Code points, ASCII folded to lower case and blanks to spaces."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    c[(c >= 65) & (c <= 90)] += 32
    c[(c >= 9) & (c <= 13)] = 32
    return c


def grams(c: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q code points from each place."""
    with np.errstate(over="ignore"):
        h, width, power = c.astype(np.uint64) + np.uint64(1), 1, _BASE
        while width < Q:  # Q is a power of two
            h = h[:-width] * power + h[width:]
            power, width = power * power, width * 2
        return h * _BASE ^ (h >> np.uint64(31))


def budget(n: int) -> int:
    """Edits allowed in an item of ``n`` characters."""
    return max(0, min(int(RATE * n), (n - Q) // Q))


def fewest_edits(item: np.ndarray, text: np.ndarray, low: int, high: int, limit: int | None = None) -> tuple[int, int]:
    """Fewest edits of ``item`` against a stretch of ``text`` on diagonals ``low`` to ``high``, and where the stretch ends.

    Once every diagonal has more than ``limit`` edits the count so far is returned.
    """
    n, width = len(item), high - low + 1
    pad = np.full(n + width + 2, 0xFFFFFFFF, np.uint32)
    a, b = max(0, low), min(len(text), high + n)
    if a < b:
        pad[a - low : b - low] = text[a:b]
    step = np.arange(width)
    row = np.zeros(width, np.int64)  # edits with nothing of the item used, on each diagonal
    far = np.int64(1 << 40)
    row[(low + step < 0) | (low + step > len(text))] = far
    for i in range(n):
        cost = row + (pad[i : i + width] != item[i])
        cost[:-1] = np.minimum(cost[:-1], row[1:] + 1)
        row = np.minimum.accumulate(cost - step) + step
        if limit is not None and i % 8 == 7 and row.min() > limit:
            break
    best = int(np.argmin(row))
    return int(row[best]), low + best + n


class Items:
    """Benchmark items with the places of their q-grams."""

    def __init__(self, items: list[tuple[object, str]]):
        self.ids = [i for i, _ in items]
        self.codes = [codes(t) for _, t in items]
        self.edits = np.array([budget(len(c)) for c in self.codes], np.int64)
        self.sizes = np.array([len(c) for c in self.codes], np.int64)
        self.least = np.maximum(1, self.sizes - Q + 1 - Q * self.edits)
        self.step = self.edits + 1
        long = [k for k, c in enumerate(self.codes) if len(c) >= Q]
        hashes = [grams(self.codes[k]) for k in long]
        h = np.concatenate([np.empty(0, np.uint64), *hashes])
        item = np.repeat(np.array(long, np.int64), [len(x) for x in hashes])
        place = np.concatenate([np.empty(0, np.int64), *(np.arange(len(x)) for x in hashes)])
        order = np.argsort(h, kind="stable")
        self.item, self.place = item[order], place[order]
        self.hashes, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.short = [(k, c.tobytes()) for k, c in enumerate(self.codes) if 0 < len(c) < Q]

    def candidates(self, c: np.ndarray) -> list[tuple[int, int]]:
        """(item, first diagonal) of each band that reaches the bound."""
        if len(c) < Q or not len(self.hashes):
            return []
        h = grams(c)
        at = np.flatnonzero(self.filter[h >> np.uint64(64 - _FILTER_BITS)])
        found = np.searchsorted(self.hashes, h[at])
        found[found == len(self.hashes)] = 0
        real = self.hashes[found] == h[at]
        at, found = at[real], found[real]
        if not len(at):
            return []
        often = self.count[found] > OFTEN
        blocks = self._blocks(at[often], found[often])
        at, found = at[~often], found[~often]
        # an item must reach its bound in all before its bands are counted
        total = np.zeros(len(self.codes), np.int64)
        for item, _, count in blocks:
            total[item] += int(count.sum())
        for item, _ in self._pairs(at, found):
            total += np.bincount(item, minlength=len(total))
        near = total >= self.least
        shift = int(self.sizes.max()) + 2 * int(self.step.max())
        keys, counts = [], []
        for item, diagonal in self._pairs(at, found) if near.any() else ():
            item, diagonal = item[near[item]], diagonal[near[item]]
            band = (diagonal + shift) // self.step[item]
            key, count = np.unique(np.concatenate([item << 40 | band, item << 40 | band - 1]), return_counts=True)  # bands overlap by half
            keys.append(key)
            counts.append(count)
        for item, apart, count in blocks:
            if near[item]:  # blocks ``apart`` hold diagonals from apart - 1 to apart + 1 steps
                base = apart + shift // int(self.step[item])
                reach = np.concatenate([base + j for j in (-2, -1, 0, 1)])
                keys.append(item << 40 | np.maximum(reach, 0))
                counts.append(np.tile(count, 4))
        if not keys:
            return []
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.zeros(len(key), np.int64)
        np.add.at(count, at, np.concatenate(counts))
        item, band = key >> 40, key & ((1 << 40) - 1)
        good = count >= self.least[item]
        return list(zip(item[good].tolist(), (band[good] * self.step[item[good]] - shift).tolist(), strict=True))

    def _pairs(self, at: np.ndarray, found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(items, diagonals) of the places ``at`` whose grams are ``found``, some PAIRS at a time."""
        chunk = (np.cumsum(self.count[found]) - 1) // PAIRS
        edges = np.flatnonzero(np.diff(chunk, prepend=-1)).tolist() + [len(at)]
        for a, b in zip(edges, edges[1:], strict=False):
            n = self.count[found[a:b]]
            which = np.repeat(self.first[found[a:b]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yield self.item[which], np.repeat(at[a:b], n) - self.place[which]

    def _blocks(self, at: np.ndarray, found: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(item, apart, count) of frequent grams: pairs of places whose blocks of a step each lie ``apart`` from one another."""
        out = []
        for gram in np.unique(found).tolist():
            places = at[found == gram]
            held = slice(int(self.first[gram]), int(self.first[gram] + self.count[gram]))
            for item in np.unique(self.item[held]).tolist():
                step = int(self.step[item])
                x, n = np.unique(places // step, return_counts=True)
                y, m = np.unique(self.place[held][self.item[held] == item] // step, return_counts=True)
                low = int(x[0] - y[-1])
                sums = np.zeros(int(x[-1] - y[0]) - low + 1, np.int64)
                for k, c in zip(y.tolist(), m.tolist(), strict=True):
                    sums[x - k - low] += n * c
                apart = np.flatnonzero(sums)
                out.append((item, apart + low, sums[apart]))
        return out

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the best occurrence of each item that occurs: fewest edits, then first."""
        if not text:
            return []
        whole, best = codes(text), {}
        overlap = int((self.sizes + 2 * self.step).max()) if len(self.sizes) else 0
        for start in range(0, max(1, len(whole) - overlap), SEGMENT):
            c = whole[start : start + SEGMENT + 2 * overlap]
            for k, low in self.candidates(c):
                if k in best and not best[k][0]:  # none has fewer, and bands come in order
                    continue
                edits, end = fewest_edits(self.codes[k], c, low, low + 2 * int(self.step[k]) - 1, int(self.edits[k]))
                if edits <= self.edits[k]:
                    got = (edits, start + end, start + low)
                    best[k] = min(best.get(k, got), got)
        out = []
        for k, (edits, end, _) in best.items():
            n = int(self.sizes[k] + edits)
            back = whole[max(0, end - n) : end][::-1]
            _, used = fewest_edits(self.codes[k][::-1], back, -edits, edits)
            out.append((k, end - min(used, len(back)), end, edits))
        data = whole.tobytes() if self.short else b""
        for k, item in self.short:
            at = data.find(item)
            while at >= 0 and at % 4:
                at = data.find(item, at + 1)
            if at >= 0:
                out.append((k, at // 4, at // 4 + len(item) // 4, 0))
        return sorted(out)


def item_blocks(benchmark: DataFrame, limit: int = ITEM_CHARS) -> Iterator[Items]:
    """The items in blocks of about ``limit`` characters, one on the driver at a time."""
    rows = benchmark.select("item_id", "text").filter("text is not null and text <> ''")
    total = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-total // limit))
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Items([(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").toLocalIterator()])


def _search(docs: DataFrame, benchmark: DataFrame, keys: list[str], text: str, pick) -> DataFrame:
    spark = docs.sparkSession
    bound_batches(spark)
    kind = benchmark.schema["item_id"].dataType.simpleString()
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", item_id {kind}, start int, end int, edits int"
    out = None
    for items in item_blocks(benchmark):
        held = spark.sparkContext.broadcast(items)  # bounded by ITEM_CHARS

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            its = held.value
            for b in batches:
                rows, found = [], []
                for i, t in enumerate(b.column(len(keys)).to_pylist()):
                    got = pick(its.search(t))
                    rows += [i] * len(got)
                    found += got
                own = b.take(pa.array(rows, pa.int64()))
                cols = [pa.array([its.ids[f[0]] for f in found], pa.int64() if kind == "bigint" else None)] + [pa.array([f[j] for f in found], pa.int32()) for j in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([*own.columns[: len(keys)], *cols], [*keys, "item_id", "start", "end", "edits"])

        part = docs.select(*keys, text).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that occurs in it: doc_id, item_id, start, end (characters), edits."""
    return _search(docs, benchmark, ["doc_id"], "text", lambda got: got)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, as they were."""
    row, = fresh(docs, "_row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "clean-docs")
    hit = _search(rows, benchmark, [row], "text", lambda got: got[:1]).select(row).distinct()
    return rows.join(written(hit, "contaminated"), row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
