"""Operator 2: near duplicates by Order MinHash and banded alignment.

A text's K-word mers are labelled by occurrence (first, second, ...).  Each of ORDERS seeded orders samples the PICKS smallest
labelled mers; every two of them, in the order they have in the text, are a bucket: texts meet where they share mers in the same
order, which follows edit similarity.  Short texts have few mers, so they also meet by single ones: a text of m mers by
``min(m, LONE * (LONE / m) ** 2)``, a number that falls smoothly to none.

In a bucket every text is first compared with one leader, so a crowd of copies costs what it has members, not pairs; linked
classes are contracted, and leaders are elected anew while that settles much.  Then every pair of a bucket that is still of two
classes is looked at: those of small buckets at once, others block by block, in windows that grow eightfold: each pair belongs to one
window, and only those still of two classes when it comes are aligned.  So no pair that shares a bucket goes unseen, and no link between texts is lost.  The largest class of a
bucket has blocks of its own, which are never paired with one another.

A pair is linked if a banded alignment over words finds at least SIMILARITY of one less edits over the longer length.  Pairs that
lengths or a tally of words rule out are not aligned.  Classes are the connected components, found by contraction,
each step a written table; equal texts are one node throughout.  Nothing is collected: links, labels and sketches stay in tables.  Hot
buckets and classes are met by partial aggregation and joins whose skewed side Spark may split.

Edge cases: texts without words are copies of nothing; a text of fewer than K words is one mer; null doc ids name no class
(a class is named by its least doc_id); repeated rows are in one class; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fresh, likely, marked, scratch, written

K, ORDERS, PICKS, SIMILARITY = 5, 8, 4, 0.8
#: Mers up to which a text meets by every single one; beyond, their number falls with the square of the length.
LONE = 36
#: Pairs of two classes in a bucket, for each member of such a bucket, from which another round of leaders may come first.
DIRECT = 64
#: Members of a block, and the ratio of lengths that a level of blocks spans: beyond 1 / SIMILARITY, so links stay within neighbouring levels.
BLOCK, LEVEL = 1024, 1.26
#: Slots into which the pairs of blocks are dealt, and the pairs for each member that are so few that all left come at once.
SLOTS, FEW = 64, 0.25
#: Links that one task contracts; more are first made fewer by all tasks.
FINISH = 1 << 19
_ODD, _MUL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SEEDS = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little") for i in range(ORDERS)], np.uint64)
_WORDS_KNOWN = 1_000_000
#: Classes of words in a tally: words that one text has too many of need an edit each, so tallies rule pairs out before words are fetched.
TALLY = 256
#: Classes of a fine tally, for members of buckets of more than CROWD: texts of many words differ too little in TALLY classes.
FINE, CROWD = 4096, 64
#: Members of a bucket up to which all its pairs come at once and meet their tallies later; they are fewer bytes than the members' tallies.
LISTED = 16
#: Words of the runs that anchor a quick alignment.
ANCHOR = 3


def word_codes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """A 32-bit code of each word; ``known`` remembers them."""
    get = known.get
    out = [get(w) for w in words]
    if None in out:
        if len(known) > _WORDS_KNOWN:
            known.clear()
        for i, c in enumerate(out):
            if c is None:
                out[i] = known[words[i]] = zlib.crc32(words[i])
    return np.array(out, np.uint32)


def labelled_mers(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each K-mer, and the hash of it with its occurrence."""
    with np.errstate(over="ignore"):
        n, k = len(codes), min(K, len(codes))
        h = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            h = (h ^ codes[j : n - k + 1 + j]) * _ODD
            h ^= h >> np.uint64(31)
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = np.concatenate([[False], s[1:] == s[:-1]])
        if not same.any():
            return h, h
        at = np.arange(len(h))
        seen = at - np.maximum.accumulate(np.where(same, 0, at))
        label = np.empty(len(h), np.uint64)
        label[order] = seen.astype(np.uint64)
        return h, (h ^ label * _MUL) * _ODD


def sketch(codes: np.ndarray) -> np.ndarray:
    """The buckets: ordered pairs of the PICKS smallest labelled mers of each order, and the smallest single mers of a short text."""
    h, x = labelled_mers(codes)
    m, picks = len(h), min(PICKS, len(h))
    first, second = np.triu_indices(picks, 1)
    out = []
    with np.errstate(over="ignore"):
        step = max(1, (1 << 18) // m) if picks > 1 else ORDERS
        for a in range(0, ORDERS if picks > 1 else 0, step):
            v = (x[None, :] ^ _SEEDS[a : a + step, None]) * _MUL
            v ^= v >> np.uint64(32)
            v *= _ODD
            best = np.argpartition(v, picks - 1, axis=1)[:, :picks] if m > picks else np.tile(np.arange(picks), (len(v), 1))
            best.sort(axis=1)
            got = h[best]
            pair = (got[:, first] * _ODD ^ got[:, second]) * _MUL
            out.append(((pair ^ pair >> np.uint64(29)) * _ODD).ravel())
        lone = min(m, int(LONE * (LONE / m) ** 2))
        if lone:
            v = (h ^ _SEEDS[0]) * _MUL
            out.append(h[np.argsort(v ^ v >> np.uint64(31), kind="stable")[:lone]])
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.empty(0, np.int64)


def edits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edits between two word sequences, or ``most + 1`` if there are more."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    differ = np.flatnonzero(a[: len(b)] != b)
    head = int(differ[0]) if len(differ) else len(b)
    a, b = a[head:], b[head:]
    differ = np.flatnonzero(a[len(a) - len(b) :] != b)
    tail = len(b) - 1 - int(differ[-1]) if len(differ) else len(b)
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    return _banded(a.tolist(), b.tolist(), most) if len(b) else len(a)


def _banded(a: list[int], b: list[int], most: int) -> int:
    """Edits on the diagonals that ``most`` edits can reach, or ``most + 1``; ``a`` is the longer.

    A column of the band is two integers: bits where the count of edits rises, and where it falls, from one place of ``a`` to the
    next.  The band slides one place a column.  What lies beyond it counts one edit more than its neighbour in it, which is a
    bound from above, so a count within ``most`` is exact.
    """
    off = len(a) - len(b)
    low = (most - off) // 2  # diagonals -low to off + low
    width = off + 2 * low + 1
    mask, top, last = (1 << width) - 1, 1 << (width - 1), off + low
    where: dict[int, int] = dict.fromkeys(b, 0)
    for i, word in enumerate(a):
        if word in where:
            where[word] |= 1 << i
    rises, falls = mask & ~((1 << (low + 1)) - 1), 0  # bit k of column j is place j - low + k of a; places up to 0 are flat
    count = off
    for j, word in enumerate(b):
        same = (where[word] >> (j - low) if j >= low else where[word] << (low - j)) & mask
        rises, falls = rises >> 1 | top, falls >> 1
        free = ((same & rises) + rises ^ rises | same | falls) & mask  # the diagonal step costs nothing
        if not free >> last & 1:
            count += 1
            if count > most:
                return count
        right_up, right_down = (falls | ~(free | rises)) << 1 | 1, (free & rises) << 1
        rises, falls = (right_down | ~(free | right_up)) & mask, free & right_up & mask
    return count


def tally(codes: np.ndarray, classes: int = TALLY) -> bytes:
    """How many words fall in each of the classes, 255 at most."""
    return np.minimum(np.bincount(codes & np.uint32(classes - 1), minlength=classes), 255).astype(np.uint8).tobytes()


def at_most(a: np.ndarray, b: np.ndarray) -> int:
    """Edits of an alignment by the runs of ANCHOR words that each text has once: a bound from above."""
    if min(len(a), len(b)) < ANCHOR:
        return max(len(a), len(b))
    sides = []
    for c in (a, b):
        with np.errstate(over="ignore"):
            h = np.zeros(len(c) - ANCHOR + 1, np.uint64)
            for j in range(ANCHOR):
                h = (h ^ c[j : len(c) - ANCHOR + 1 + j]) * _ODD
                h ^= h >> np.uint64(31)
        order = np.argsort(h)
        s = h[order]
        lone = np.ones(len(s), bool)
        same = s[1:] == s[:-1]
        lone[1:] &= ~same
        lone[:-1] &= ~same
        sides.append((s[lone], order[lone]))
    (p, x), (q, y) = sides
    at = np.searchsorted(q, p)
    at[at == len(q)] = 0
    hit = q[at] == p if len(q) else np.zeros(len(p), bool)
    x, y = x[hit], y[at[hit]]
    order = np.argsort(x)
    x, y = x[order], y[order]
    forward = y > np.concatenate([[-1], np.maximum.accumulate(y)[:-1]])  # runs in the same order in both
    x, y = x[forward], y[forward]
    x, y = np.concatenate([x + j for j in range(ANCHOR)]), np.concatenate([y + j for j in range(ANCHOR)])
    x, first = np.unique(x, return_index=True)
    y = y[first]
    forward = (y > np.concatenate([[-1], np.maximum.accumulate(y)[:-1]])) & (a[x] == b[y])
    x, y = np.concatenate([[-1], x[forward], [len(a)]]), np.concatenate([[-1], y[forward], [len(b)]])
    return int(np.maximum(np.diff(x) - 1, np.diff(y) - 1).sum())


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether few enough edits suffice: an alignment word for word or by anchors may show it, else the banded one decides."""
    longest = max(len(a), len(b))
    most = int(longest * (1 - SIMILARITY) + 1e-9)
    if len(a) == len(b) and int(np.count_nonzero(a != b)) <= most:
        return True
    return at_most(a, b) <= most or edits(a, b, most) <= most


def sketched(rows: DataFrame, row: str, text: str, *more: str) -> DataFrame:
    """(row, more, key, n, buckets, tally, words) of every text; key tells equal texts, words are their codes, and all are null without a word."""
    bound_batches(rows.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            keys, ns, buckets, tallies, words = [], [], [], [], []
            for t in batch.column(1).to_pylist():
                data = (t or "").encode()
                parts = data.split()
                codes = word_codes(parts, known) if parts else None
                keys.append(hashlib.md5(data).digest() if parts else None)
                ns.append(len(parts) if parts else None)
                buckets.append(sketch(codes) if parts else None)
                tallies.append(tally(codes) if parts else None)
                words.append(codes.tobytes() if parts else None)
            made = [pa.array(keys, pa.binary()), pa.array(ns, pa.int32()), pa.array(buckets, pa.list_(pa.int64())), pa.array(tallies, pa.binary()), pa.array(words, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *made], ["row", *more, "key", "n", "buckets", "tally", "words"])

    schema = ", ".join(["row long", *(f"`{m}` {kinds[m]}" for m in more), "key binary, n int, buckets array<long>, tally binary, words binary"])
    return rows.select(F.col(row).alias("row"), text, *more).mapInArrow(run, schema)


def plausible(pairs: DataFrame, tallies: DataFrame) -> DataFrame:
    """The pairs (a, b) whose tallies leave a link possible; tallies: node, n, tally."""
    side = {x: tallies.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("tally").alias(f"tally_{x}")) for x in "ab"}
    both = pairs.join(side["b"], "b").join(side["a"], "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, TALLY).astype(np.int16) for i in (4, 5))
            d = x - y
            least = np.maximum(np.where(d > 0, d, 0).sum(axis=1), np.where(d < 0, -d, 0).sum(axis=1))
            longest = np.maximum(batch.column(2).to_numpy(), batch.column(3).to_numpy())
            keep = least <= np.floor(longest * (1 - SIMILARITY) + 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "n_a", "n_b", "tally_a", "tally_b").mapInArrow(run, "a long, b long")


def compared(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (a, b) whose words are similar; words: node, words."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    words = likely(words, nodes, "node")
    both = pairs.join(words.select(F.col("node").alias("b"), F.col("words").alias("words_b")), "b").join(words.select(F.col("node").alias("a"), F.col("words").alias("words_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "words_a", "words_b").mapInArrow(run, "a long, b long")


def _contracted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the links (a, b) of one task, by union of the greater root under the lesser."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in rows:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([root(x) for x in up], pa.int64())], ["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): root is the least node of its component.

    Links beyond FINISH are made fewer by contraction: every node takes the least of itself and its neighbours, twice over, and
    links between what is left of a component are kept.  One task contracts the rest.
    """
    edges, roots = written(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"), None

    def further(more: DataFrame) -> DataFrame:
        """``roots`` of the roots that ``more`` has."""
        if roots is None:
            return more
        return written(roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left").select("node", F.coalesce("further", "root").alias("root")), "roots")

    while edges.count() > FINISH:
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(ways.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "least")
        twice = least.join(least.select(F.col("node").alias("root"), F.col("root").alias("further")), "root").select("node", F.col("further").alias("root"))
        twice = written(twice, "least")
        roots = further(twice)
        a, b = twice.select(F.col("node").alias("a"), F.col("root").alias("x")), twice.select(F.col("node").alias("b"), F.col("root").alias("y"))
        rest = edges.join(a, "a").join(b, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = written(rest, "edges")
    return further(written(edges.coalesce(1).mapInArrow(_contracted, "node long, root long"), "finished"))


def leader_pairs(members: DataFrame, turn: int) -> DataFrame:
    """(a, b): each member of a bucket with its leader, the least by a seeded order, where they are of two classes and their lengths allow a link."""
    rank = F.xxhash64("node", F.lit(turn))
    leaders = members.groupBy("bucket").agg(F.min_by("node", rank).alias("leader"), F.min_by("n", rank).alias("size"), F.min_by("root", rank).alias("of"))
    fits = F.abs(F.col("n") - F.col("size")) <= F.greatest("n", "size") * (1 - SIMILARITY) + 1e-9
    pairs = members.join(leaders, "bucket").filter((F.col("root") != F.col("of")) & fits)
    return pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def block_pairs(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], same: bool, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of two blocks (node, n, root, tallies, fine tallies if known) in slots low to high that are of two classes and whose lengths and tallies leave a link possible."""
    with np.errstate(over="ignore"):
        h = [(t[0].astype(np.uint64) * _MUL ^ (t[0].astype(np.uint64) * _ODD >> np.uint64(31))) | np.uint64(1) for t in (x, y)]
    kinds = range(3, min(len(x), len(y)))
    sums = {k: [t[k].sum(axis=1, dtype=np.int64) for t in (x, y)] for k in kinds}
    a, b = [], []
    for i in range(len(x[0])):
        at = slice(i + 1 if same else 0, None)
        most = np.floor(np.maximum(x[1][i], y[1][at]) * (1 - SIMILARITY) + 1e-9)
        open_ = (x[2][i] != y[2][at]) & (np.abs(x[1][i] - y[1][at]) <= most)
        if high - low < SLOTS:
            with np.errstate(over="ignore"):
                slot = (h[0][i] * h[1][at]) >> np.uint64(64 - SLOTS.bit_length() + 1)
            open_ &= (slot >= low) & (slot < high)
        j = np.flatnonzero(open_)
        if not len(j):
            continue
        most, j = most[j], j + (i + 1 if same else 0)
        for k in kinds:
            common = np.minimum(x[k][i], y[k][j]).sum(axis=1, dtype=np.int64)
            keep = np.maximum(sums[k][0][i], sums[k][1][j]) - common <= most
            most, j = most[keep], j[keep]
        a.append(np.full(len(j), x[0][i]))
        b.append(y[0][j])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def class_gaps(codes: np.ndarray) -> bytes:
    """The FINE classes of the words in order, each as the gap from the one before: a byte, after one of 255 for each 255 in it.  A tally if that is shorter."""
    gaps = np.diff(np.sort(codes & np.uint32(FINE - 1)).astype(np.int64), prepend=0)
    ends = np.cumsum(gaps // 255 + 1)
    if not len(ends) or ends[-1] > FINE:
        return b"\0" + tally(codes, FINE)
    out = np.full(ends[-1], 255, np.uint8)
    out[ends - 1] = gaps % 255
    return b"\2" + out.tobytes()


def fine_tallies(members: DataFrame, words: DataFrame) -> DataFrame:
    """(node, fine), written: what the fine tally of each member of a crowd is made from, the gaps of its words' classes or, if these are more than a tally takes, the tally."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [class_gaps(np.frombuffer(x, np.uint32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], ["node", "fine"])

    crowd = members.filter(F.col("crowd") > CROWD).select("node").distinct()
    return written(likely(words, crowd, "node").join(crowd, "node").select("node", "words").mapInArrow(run, "node long, fine binary"), "fine")


def fine_tally(fine: bytes) -> bytes:
    """The tally of FINE classes, from gaps (2), words (1) or itself (0)."""
    if fine[0] == 2:
        steps = np.frombuffer(fine, np.uint8, offset=1)
        return tally(np.cumsum(steps, dtype=np.uint32)[steps < 255], FINE)
    return tally(np.frombuffer(fine[1:], np.uint32), FINE) if fine[0] else fine[1:]


def coarse_tallies(fine: np.ndarray) -> np.ndarray:
    """The tallies of TALLY classes of rows of FINE ones."""
    return np.minimum(fine.reshape(-1, FINE // TALLY, TALLY).sum(axis=1, dtype=np.uint16), 255).astype(np.uint8)


def listed_pairs(members: DataFrame, tallies: DataFrame) -> DataFrame:
    """(a, b): the pairs of members of buckets of at most LISTED that are of two classes and may be linked, by their lengths and tallies, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batch.column(0):
                x = tuple(rows.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
                a, b = block_pairs(x, x, True, 0, SLOTS)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

    few = members.filter(F.col("crowd") <= LISTED).groupBy("bucket").agg(F.collect_list(F.struct("node", "n", "root")).alias("block"))
    return plausible(written(few.select("block").mapInArrow(run, "a long, b long").distinct(), "listed"), tallies)


def open_pairs(members: DataFrame, tallies: DataFrame, fine: DataFrame, low: int, high: int) -> DataFrame:
    """(a, b): the pairs of members of a bucket of more than LISTED, in slots low to high, that are of two classes and may be linked, by their lengths and tallies.

    Members (bucket, node, n, root, crowd: members of the bucket, top: its largest class) of a bucket that fits in a block are one; others are dealt
    by hash into blocks of one level of lengths, those of the largest class apart, and pairs of blocks into tasks; so a task holds two
    blocks however large a bucket is.  Members of crowds are told by their fine tallies (node, fine) too, and bring no others.  Each member carries its lesser buckets, and a pair is told by the least that both have, so it comes once.
    """
    bound_batches(members.sparkSession)
    kind = ["bucket", "level", "own"]
    whole, level = F.col("crowd") <= BLOCK, F.floor(F.log("n") / F.log(F.lit(LEVEL))).cast("int")
    # texts meet their tallies once, not once for each bucket; a text's buckets are a sketch's at most
    members = members.filter(F.col("crowd") > LISTED)
    texts = members.groupBy("node").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.collect_set("bucket").alias("buckets"))
    texts = texts.join(tallies.select("node", "tally"), "node").join(fine, "node", "left").withColumn("bucket", F.explode("buckets"))
    placed = texts.join(members.select("bucket", "crowd", "top").distinct(), "bucket")
    finer = F.when(F.col("crowd") > CROWD, F.col("fine")).alias("fine")
    lesser = F.filter("buckets", lambda b: b < F.col("bucket")).alias("buckets")
    placed = placed.select("bucket", "node", "n", "root", F.when(finer.isNull(), F.col("tally")).alias("tally"), lesser, finer, F.when(whole, -1).otherwise(level).alias("level"), (~whole & (F.col("root") == F.col("top"))).alias("own"))
    rows = F.collect_list(F.struct("node", "n", "root", "tally", "buckets", "fine"))

    def block(rows: pa.ListScalar) -> tuple[np.ndarray, ...]:
        got = rows.values
        node, n, root, tallies = (got.field(i) for i in range(4))
        out = node.to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False).astype(np.int64), root.to_numpy(zero_copy_only=False)
        if got.field(5).null_count:
            return *out, np.frombuffer(b"".join(tallies.to_pylist()), np.uint8).reshape(-1, TALLY)
        counts = np.frombuffer(b"".join(map(fine_tally, got.field(5).to_pylist())), np.uint8).reshape(-1, FINE)
        return *out, coarse_tallies(counts), counts

    def buckets_of(*blocks: pa.ListScalar) -> dict[int, set[int]]:
        return {node: set(own) for rows in blocks for node, own in zip(rows.values.field(0).to_pylist(), rows.values.field(4).to_pylist(), strict=True)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sides = [c[i] for c in batch.columns[1:] if c[i].is_valid]  # one: the block with itself
                a, b = block_pairs(block(sides[0]), block(sides[-1]), len(sides) == 1, low, high)
                if len(a):
                    held = buckets_of(*sides)
                    keep = np.array([held[x].isdisjoint(held[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                    a, b = a[keep], b[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

    alone = placed.filter("level = -1").groupBy("bucket").agg(rows.alias("block")).select("bucket", "block").mapInArrow(run, "a long, b long")

    crowd = placed.filter("level <> -1")
    parts = written(crowd.groupBy(*kind).agg(F.count("*").alias("size")).withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int")), "parts")
    if parts.isEmpty():
        return alone
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")
    blocks = written(crowd.join(parts, kind).groupBy(*kind, part).agg(rows.alias("block")), "blocks")
    near = parts.select("bucket", "size", F.col("level").alias("level_a"), F.col("own").alias("own_a"), F.col("parts").alias("_a"), F.explode(F.array("level", F.col("level") + 1)).alias("level_b"))
    near = near.join(parts.select("bucket", F.col("level").alias("level_b"), F.col("own").alias("own_b"), F.col("parts").alias("_b")), ["bucket", "level_b"])
    level, one = F.col("level_a") == F.col("level_b"), F.col("own_a") == F.col("own_b")
    near = near.filter(~(F.col("own_a") & F.col("own_b")) & (~level | F.col("own_b") | (one & (F.col("size") > 1))))
    near = near.withColumn("part_a", F.explode(F.sequence(F.lit(0), F.col("_a") - 1)))
    near = near.withColumn("part_b", F.explode(F.sequence(F.when(level & one, F.col("part_a")).otherwise(0), F.col("_b") - 1)))
    near = near.select("bucket", *(f"{k}_{x}" for k in ("level", "own", "part") for x in "ab"), (level & one & (F.col("part_a") == F.col("part_b"))).alias("same"))
    for x in "ab":
        side = blocks.select("bucket", *(F.col(k).alias(f"{k}_{x}") for k in ("level", "own", "part")), F.col("block").alias(f"block_{x}"))
        near = near.join(side, ["bucket", *(f"{k}_{x}" for k in ("level", "own", "part"))])
    apart = near.select("bucket", "block_a", F.when(~F.col("same"), F.col("block_b")).alias("block_b")).mapInArrow(run, "a long, b long")
    return alone.unionByName(apart)


def joined(roots: DataFrame | None, found: DataFrame) -> DataFrame | None:
    """``roots`` with the classes that the links ``found`` join, written; None if they join none."""
    if roots is None:
        return None if found.isEmpty() else components(found)
    at = {x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab"}
    links = found.join(at["a"], "a", "left").join(at["b"], "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    links = written(links.filter("a <> b").distinct(), "links")
    if links.isEmpty():
        return None
    more = components(links)
    further = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    return written(further.unionByName(more.join(roots, "node", "left_anti").select("node", "root")), "roots")


def mixed(members: DataFrame, roots: DataFrame | None) -> tuple[DataFrame, int, int]:
    """The members (bucket, node, n, root, crowd, top) of buckets that are of two classes or more, how many they are, and how many pairs of two classes."""
    if roots is not None:
        members = members.drop("root").join(roots, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root"))
        members = written(members, "labelled")
    sizes = members.groupBy("bucket", "root").agg(F.count("*").alias("c")).groupBy("bucket")
    sizes = sizes.agg(F.count("*").alias("classes"), F.sum("c").alias("size"), F.sum(F.col("c").cast("double") * F.col("c")).alias("own"), F.max_by("root", F.struct("c", "root")).alias("top"))
    sizes = written(sizes.filter("classes > 1"), "mixed")
    size, left = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum((F.col("size").cast("double") * F.col("size") - F.col("own")) / 2), F.lit(0.0))).first()
    return written(members.select("bucket", "node", "n", "root").join(sizes.select("bucket", F.col("size").alias("crowd"), "top"), "bucket"), "members"), size, int(left)


def text_classes(sketches: DataFrame) -> DataFrame:
    """(row, root) of every text with a word, written, from the written ``sketched``: equal root means one class.  What it took is deleted."""
    with scratch(sketches.sparkSession) as scope:
        return scope.keep(written(_text_classes(sketches.filter("n is not null")), "classes"))


def _text_classes(sketches: DataFrame) -> DataFrame:
    nodes = written(sketches.groupBy("key").agg(F.min("row").alias("node")), "nodes")
    # equal texts are the first of them: most rows are told by the bitmap of the others
    again = written(sketches.select("key", "row").join(nodes, "key").filter("row <> node").select("row"), "again")
    told = marked(sketches.select("row", "n", "buckets"), again, "row")
    firsts = told.filter("not _hit").unionByName(told.filter("_hit").join(again, "row", "left_anti"))
    members = firsts.select(F.col("row").alias("node"), "n", F.explode("buckets").alias("bucket"))
    shared = written(members.groupBy("bucket").agg(F.count("*").alias("_n")).filter("_n > 1").select("bucket"), "shared")
    members = written(likely(members, shared, "bucket").join(shared, "bucket").select("bucket", "node", "n", F.col("node").alias("root")), "buckets")
    wanted = members.select("node").distinct()
    known = written(likely(sketches.select(F.col("row").alias("node"), "n", "tally", "words"), wanted, "node").join(wanted, "node"), "known")
    tallies, words = known.select("node", "n", "tally"), known.select("node", "words")

    roots, turn, before = None, 0, None
    members, size, left = mixed(members, None)
    while size:  # rounds of leaders, as long as each settles three quarters of the pairs that are left
        pairs = written(plausible(written(leader_pairs(members, turn), "pairs"), tallies), "likely")
        more = joined(roots, written(compared(pairs, words), "links"))
        turn, before = turn + 1, left
        if more is None:
            break
        roots = more
        members, size, left = mixed(members, roots)
        if left <= DIRECT * size or 4 * left > before:
            break
    low, width = 0, 8
    fine = fine_tallies(members, words) if size else None
    while size and low < SLOTS:  # all pairs that are left, in windows
        pairs = open_pairs(members, tallies, fine, low, low + width)
        pairs = written(pairs if low else pairs.unionByName(listed_pairs(members, tallies)).distinct(), "open")
        n, low = pairs.count(), low + width
        more = joined(roots, written(compared(pairs, words), "links")) if n else None
        if more is not None:
            roots = more
            members, size, left = mixed(members, roots)
        few = n * (SLOTS - low) <= FEW * size * width
        width = SLOTS - low if few else min(7 * low, SLOTS - low)
    named = nodes.select("key", "node") if roots is None else nodes.join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("node"))
    return sketches.select("row", "key").join(named.select("key", F.col("node").alias("root")), "key").select("row", "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and class_id, the least doc_id of its class."""
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    sketches = written(sketched(rows, "row", "text", "doc_id"), "sketches")
    whose = sketches.select("row", "doc_id").join(text_classes(sketches), "row", "left")
    names = whose.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return whose.join(names, "root", "left").select("doc_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The first document, by doc_id, of each class; texts without words all stay."""
    row, = fresh(docs, "_row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "near-docs")
    with scratch(docs.sparkSession) as scope:
        classes = scope.keep(text_classes(written(sketched(rows, row, "text"), "sketches")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = rows.select(F.col(row).alias("row"), "doc_id").join(classes, "row").groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    gone = classes.join(first.filter("n > 1").select("root", F.col("first.row").alias("kept")), "root").filter("row <> kept")
    gone = written(gone.select(F.col("row").alias(row)), "near-gone")
    return rows.join(gone, row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
