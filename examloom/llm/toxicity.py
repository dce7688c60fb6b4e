"""Operator 6: toxicity by the nearest labelled examples.

The model is a bounded sample of labelled texts (EXAMPLES of each class, lowest hash first; equal texts once).  Terms
are words and their four-letter beginnings; those that go with the label beyond chance (chi-square) are kept and weighed
by TF-IDF.  The examples stand in a block-max inverted index: postings by block of examples, with the largest
weight of each term in each block.  A query visits blocks in the order of their bounds and stops when no block left
can reach its k-th best cosine, so the neighbours are exact.  They vote with their squared cosine, toxic
and other examples weighed back to their share of the labels, and the vote is made a probability by isotonic
regression on the examples' own leave-one-out votes.  The nearest examples are the evidence.

Only rows with labels whose crc32(doc_id) mod 4 is not 2 teach; a score depends on the text alone.

Edge cases: null and empty texts, and texts without a known term, get the calibrated score of texts without terms;
of repeated labels the highest counts; without labelled rows of both classes every score is the share of toxic labels
(0 without labels); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: Bound of the model: examples of each class.
EXAMPLES = {1: 1000, 0: 1500}
BLOCK, NEIGHBOURS, MIN_DF, CUT = 64, 30, 4, 0.3
#: A term is kept from so much chi-square for each natural logarithm of the examples: more examples try more terms.
CHI = 3.6
_FOLD = bytes(ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else (32 if i < 128 else i) for i in range(256))


def words_of(text: str | None) -> Counter:
    return Counter((text or "").encode().translate(_FOLD).split())


def terms_of_word(word: bytes) -> tuple[str, ...]:
    w = word.decode("utf-8", "replace")
    return (w, "^" + w[:4])


def terms_of(text: str | None) -> Counter:
    out: Counter = Counter()
    for w, n in words_of(text).items():
        for t in terms_of_word(w):
            out[t] += n
    return out


class BlockMaxIndex:
    """Unit vectors in blocks of BLOCK; ``search`` gives the exact nearest by cosine."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        heavy = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in rows]
        self.order = np.array(sorted(range(len(rows)), key=lambda i: (heavy[i], i)), np.int64)
        self.n = len(rows)
        n_blocks = -(-self.n // BLOCK)
        self.peak = np.zeros((n_terms, n_blocks), np.float32)
        self.slot = np.full((n_blocks, n_terms), -1, np.int32)
        self.weights = []
        for b in range(n_blocks):
            own = self.order[b * BLOCK : (b + 1) * BLOCK]
            terms = np.unique(np.concatenate([rows[i][0] for i in own]))
            self.slot[b, terms] = np.arange(len(terms))
            w = np.zeros((len(terms), BLOCK), np.float32)
            for j, i in enumerate(own):
                w[self.slot[b, rows[i][0]], j] = rows[i][1]
            self.weights.append(w)
            self.peak[terms, b] = w.max(axis=1)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the ``k`` nearest with a cosine above 0, best first, lower row on ties; ``but`` is left out."""
        bound = weights @ self.peak[terms]
        rows, sims, least = [], [], 0.0
        got = 0
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or got >= k and bound[b] < least - 1e-6:
                break
            at = self.slot[b, terms]
            have = at >= 0
            cos = weights[have] @ self.weights[b][at[have]]
            own = self.order[b * BLOCK : (b + 1) * BLOCK]
            hit = np.flatnonzero(cos[: len(own)] > max(least - 1e-6, 0) if got >= k else cos[: len(own)] > 0)
            hit = hit[own[hit] != but]
            rows.append(own[hit])
            sims.append(cos[hit])
            got += len(hit)
            if got >= k:
                all_sims = np.concatenate(sims)
                least = float(np.partition(all_sims, len(all_sims) - k)[len(all_sims) - k])
        if not got:
            return np.empty(0, np.int64), np.empty(0, np.float32)
        r, s = np.concatenate(rows), np.concatenate(sims)
        best = np.lexsort((r, -np.round(s, 6)))[:k]
        return r[best], s[best]


def isotonic(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing weighted fit (pool adjacent violators)."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []  # weight, weighted label, first vote, last vote
    for v, y, w in zip(votes[order], labels[order], weights[order], strict=True):
        if pools and pools[-1][3] == v:
            pools[-1][0] += w
            pools[-1][1] += w * y
        else:
            pools.append([w, w * y, v, v])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            w2, y2, _, last = pools.pop()
            pools[-1][0] += w2
            pools[-1][1] += y2
            pools[-1][3] = last
    x = np.array([e for p in pools for e in (p[2], p[3])])
    y = np.array([p[1] / p[0] for p in pools for _ in (0, 1)])
    return x, y


class Model:
    """Terms, index and calibration from labelled texts."""

    def __init__(self, examples: list[tuple[int, str, int]], totals: dict[int, int]):
        """examples: (doc_id, text, toxic); totals: labelled rows by class, from which the examples come."""
        seen, kept = set(), []
        for x in sorted(examples, key=lambda e: e[0]):
            if x[1] and x[1] not in seen:
                seen.add(x[1])
                kept.append(x)
        self.ids = np.array([i for i, _, _ in kept], np.int64)
        self.labels = np.array([y for _, _, y in kept], np.int64)
        n, n1 = len(kept), int(self.labels.sum())
        everyone = sum(totals.values())
        self.prior = totals.get(1, 0) / everyone if everyone else 0.0
        self.terms: dict[str, int] = {}
        if not 0 < n1 < n:
            return
        counts = [terms_of(t) for _, t, _ in kept]
        df: Counter = Counter()
        toxic_df: Counter = Counter()
        for c, y in zip(counts, self.labels, strict=True):
            df.update(c.keys())
            if y:
                toxic_df.update(c.keys())

        def chi(t: str) -> float:
            d, a = df[t], toxic_df[t]
            e1, e0 = d * n1 / n, d * (n - n1) / n
            return (a - e1) ** 2 / e1 + (d - a - e0) ** 2 / e0

        self.terms = {t: i for i, t in enumerate(sorted(t for t, d in df.items() if d >= MIN_DF and chi(t) >= CHI * math.log(n)))}
        self.idf = np.array([math.log(1 + n / df[t]) for t in self.terms])
        rows = [self.vector(c) for c in counts]
        self.index = BlockMaxIndex(rows, len(self.terms)) if self.terms else None
        self.share = np.where(self.labels == 1, totals[1] / n1, totals[0] / (n - n1))
        votes = np.array([self.vote(r, but=i)[0] for i, r in enumerate(rows)])
        self.x, self.y = isotonic(votes, self.labels, self.share)

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        got = sorted((self.terms[t], c) for t, c in counts.items() if t in self.terms)
        t = np.array([i for i, _ in got], np.int64)
        w = (1 + np.log([c for _, c in got])) * self.idf[t] if got else np.empty(0)
        return t, (w / np.linalg.norm(w) if got else w).astype(np.float32)

    def vote(self, row: tuple[np.ndarray, np.ndarray], but: int = -1) -> tuple[float, np.ndarray]:
        """The share of toxic votes, -1 without neighbours, and the neighbours."""
        if not len(row[0]):
            return -1.0, np.empty(0, np.int64)
        near, cos = self.index.search(*row, NEIGHBOURS, but)
        w = cos.astype(float) ** 2 * self.share[near]
        return (float(w @ self.labels[near] / w.sum()) if w.sum() > 0 else -1.0), near

    def score(self, counts: Counter) -> tuple[float, list[int]]:
        if not self.terms:
            return self.prior, []
        vote, near = self.vote(self.vector(counts))
        return float(np.interp(vote, self.x, self.y)), self.ids[near[:5]].tolist()


def teaches(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    known = labels.filter("toxic is not null").filter(teaches(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    ids = [r for y, n in EXAMPLES.items() for r in known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]
    if not ids:
        return Model([], totals)
    spark = docs.sparkSession
    picked = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in ids], "doc_id long, toxic int")  # 2,500 rows at most
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return Model([(r["doc_id"], r["text"], r["toxic"]) for r in rows.toLocalIterator()], totals)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: held_out, score, predicted, and the ids of the nearest examples."""
    spark = docs.sparkSession
    bound_batches(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels))  # bounded by EXAMPLES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        known: dict[bytes, tuple[str, ...]] = {}
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                counts: Counter = Counter()
                for w, n in words_of(text).items():
                    terms = known.get(w)
                    if terms is None:
                        if len(known) > 500_000:
                            known.clear()
                        terms = known[w] = tuple(t for t in terms_of_word(w) if t in m.terms)
                    for t in terms:
                        counts[t] += n
                out.append(m.score(counts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, evidence array<long>")
    held = F.coalesce(~teaches(F.col("doc_id")), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "evidence")
