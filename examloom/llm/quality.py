"""Operator 7: quality rules with risk-controlled thresholds.

Each rule is a signal of the text and a cutoff, beyond which the text is rejected.  Cutoffs are not set by hand: on
the labelled holdout, for each stratum (language group) and rule, cutoffs are tried from lenient to strict, and the
strictest is taken whose false rejection rate is shown to stay under the rule's share of the risk.  The proof is the
exact binomial (Clopper-Pearson) upper bound; trying in a fixed order and stopping at the first failure keeps the
level over all cutoffs of a rule, and the level is divided by the number of strata and rules (Bonferroni).
So, with probability ``1 - DELTA``, no stratum loses more than ``ALPHA`` of those good texts to the rules that pass the fixed base
rules; what the base rules themselves reject is not part of the promise.

Counts cover every labelled document; a stratum without enough good labels to prove anything gets no cutoff.

Edge cases: null and empty texts have no words and fail the base rules; null or unknown languages form one
stratum; a null, missing or repeated label: null and missing ones teach nothing, of repeated ones the lowest counts; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fresh, written

ALPHA, DELTA = 0.05, 0.05
#: Languages with a stratum of their own; all others share one.
STRATA = ("en", "fr", "de", "es")
BINS = 200
BLANKS, SYMBOLS = " \t\n\r\x0b\x0c", "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Rule(NamedTuple):
    """A signal in 0 to 1 over the counts of a text; texts above the cutoff are rejected."""

    name: str
    signal: str


RULES = (
    Rule("symbols", "n_symbols / greatest(word_chars, 1)"),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)"),
    Rule("dup_lines", "n_dup_lines / greatest(n_lines, 1)"),
    Rule("upper", "n_upper / greatest(word_chars, 1)"),
    Rule("marks", "n_marks / greatest(word_chars, 1)"),
)


def repeat_words(ids: np.ndarray, docs: np.ndarray, n_docs: int, width: int = 5) -> np.ndarray:
    """Words of each document in ``width``-word windows that it has twice or more; ids and docs: of each word, in order.

    Windows meet by a 64-bit hash of document and words, and words are compared before windows count as equal.
    """
    n = len(ids)
    if n < width:
        return np.zeros(n_docs, np.int64)
    with np.errstate(over="ignore"):
        h = docs[: n - width + 1].astype(np.uint64)
        for j in range(width):
            h = (h ^ ids[j : n - width + 1 + j].astype(np.uint64)) * _MIX
            h ^= h >> np.uint64(29)
    at = np.flatnonzero(docs[: n - width + 1] == docs[width - 1 :])
    at = at[np.argsort(h[at], kind="stable")]
    same = h[at[1:]] == h[at[:-1]]
    a, b = at[1:][same], at[:-1][same]
    equal = docs[a] == docs[b]
    for j in range(width):
        equal &= ids[a + j] == ids[b + j]
    twice = np.zeros(n + 1, np.int32)
    starts = np.unique(np.concatenate([a[equal], b[equal]]))
    np.add.at(twice, starts, 1)
    np.add.at(twice, starts + width, -1)
    return np.bincount(docs[np.cumsum(twice[:n]) > 0], minlength=n_docs).astype(np.int64)


def counted(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The counts of each text; ``COUNTS`` names them."""
    out = {k: np.zeros(len(texts), np.int64) for k in COUNTS}
    known: dict[bytes, int] = {}
    ids: list[np.ndarray] = []
    for i, text in enumerate(texts):
        if not text:
            ids.append(np.empty(0, np.int64))
            continue
        data = text.encode()
        words = data.split()  # on ASCII blanks alone
        ids.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        out["n_words"][i] = len(words)
        out["word_chars"][i] = len(text) - sum(map(text.count, BLANKS))
        out["n_symbols"][i] = sum(map(text.count, SYMBOLS))
        lines = [x for x in data.split(b"\n") if x.strip()]
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
        codes = np.frombuffer(data, np.uint8)
        out["n_upper"][i] = int(np.count_nonzero((codes >= 65) & (codes <= 90)))
        out["n_marks"][i] = text.count("!") + text.count("?")
    docs = np.repeat(np.arange(len(texts)), [len(x) for x in ids])
    out["n_repeat_words"] = repeat_words(np.concatenate(ids) if ids else np.empty(0, np.int64), docs, len(texts))
    return out


def measured(docs: DataFrame, text: str, names: tuple[str, ...] = COUNTS) -> DataFrame:
    """``docs`` with the counts of ``text`` under ``names``, which no column has."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = counted(b.column(b.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(got[k], pa.int64()) for k in COUNTS)], [*b.schema.names, *names])

    fields = [*("`" + f.name.replace("`", "``") + "` " + f.dataType.simpleString() for f in docs.schema.fields), *(f"`{k}` long" for k in names)]
    return docs.mapInArrow(run, ", ".join(fields))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def stratum(lang: Column) -> Column:
    return F.when(lang.isin(*STRATA), lang).otherwise("other")


def signals() -> list[Column]:
    return [F.least(F.expr(r.signal).cast("double"), F.lit(1.0)).alias(f"sig_{r.name}") for r in RULES]


def base_failed() -> Column:
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def upper_bound(failures: int, trials: int, level: float) -> float:
    """The exact binomial bound: the largest rate that ``failures`` or fewer of ``trials`` leave possible at ``level``."""
    if failures >= trials:
        return 1.0
    logs = [math.lgamma(trials + 1) - math.lgamma(k + 1) - math.lgamma(trials - k + 1) for k in range(failures + 1)]
    low, high = failures / trials, 1.0
    for _ in range(60):
        p = (low + high) / 2
        terms = [c + k * math.log(p) + (trials - k) * math.log1p(-p) for k, c in enumerate(logs)] if p < 1 else [-math.inf]
        top = max(terms)
        tail = top + math.log(sum(math.exp(t - top) for t in terms)) if top > -math.inf else -math.inf
        low, high = (p, high) if tail > math.log(level) else (low, p)
    return high


def pick(counts: dict[tuple[str, str, int], int], good: dict[str, int]) -> dict[tuple[str, str], float]:
    """The cutoff of each stratum and rule.  counts: good texts by stratum, rule and bin of the signal; good: by stratum."""
    level = DELTA / (max(1, len(STRATA) + 1) * len(RULES))
    risk = ALPHA / len(RULES)
    cuts = {}
    for s, n in good.items():
        for r in RULES:
            beyond, best = 0, None
            for b in range(BINS - 1, 0, -1):  # the cutoff b/BINS rejects bins b and up
                beyond += counts.get((s, r.name, b), 0)
                if beyond > risk * n or upper_bound(beyond, n, level) > risk:
                    break
                best = b / BINS
            if best is not None:
                cuts[s, r.name] = best
    return cuts


def fit(labelled: DataFrame) -> dict[tuple[str, str], float]:
    """Cutoffs from rows (stratum, sig_*) of good texts that pass the base rules: at most strata x rules x bins counts leave the executors."""
    kinds = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.floor(F.col(f"sig_{r.name}") * BINS).cast("int").alias("bin")) for r in RULES)))
    rows = labelled.select("stratum", kinds.alias("k")).groupBy("stratum", "k.rule", "k.bin").count().collect()
    counts = {(x["stratum"], x["rule"], min(x["bin"], BINS - 1)): 0 for x in rows}
    good: dict[str, int] = {}
    for x in rows:
        counts[x["stratum"], x["rule"], min(x["bin"], BINS - 1)] += x["count"]
        if x["rule"] == RULES[0].name:
            good[x["stratum"]] = good.get(x["stratum"], 0) + x["count"]
    return pick(counts, good)


def learn(measures: DataFrame, labels: DataFrame) -> dict[tuple[str, str], float]:
    """measures: doc_id, lang and counts of every document; labels: doc_id and quality (1 is good)."""
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("good")).filter("good = 1")
    rows = measures.filter(~base_failed()).select("doc_id", stratum(F.col("lang")).alias("stratum"), *signals())
    return fit(rows.join(known, "doc_id"))


def rejected(cuts: dict[tuple[str, str], float], lang: Column) -> Column:
    """Whether a rule rejects; the cutoffs are few (strata x rules) and become part of the plan."""
    bad = F.lit(False)
    for (s, name), cut in sorted(cuts.items()):
        signal = next(F.expr(r.signal).cast("double") for r in RULES if r.name == name)
        bad = bad | ((stratum(lang) == s) & (F.floor(F.least(signal, F.lit(1.0)) * BINS) >= F.lit(round(cut * BINS))))
    return bad


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: the counts, whether the base rules fail it, and whether it is kept."""
    got = written(measured(docs.select("doc_id", "lang", "text"), "text").drop("text"), "quality")
    cuts = learn(got, labels)
    out = got.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~rejected(cuts, F.col("lang")))
    return out.select("doc_id", *COUNTS[:5], "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that no rule rejects, with the columns they had."""
    names = tuple(fresh(docs, *(f"_{k}" for k in COUNTS)))
    whole = F.struct(*(F.col(_quoted(c)) for c in docs.columns)).alias("_row")
    got = written(measured(docs, "text", names), "quality").select("doc_id", "lang", whole, *(F.col(n).alias(k) for n, k in zip(names, COUNTS, strict=True)))
    cuts = learn(got.drop("_row"), labels)
    kept = got.filter(~base_failed() & ~rejected(cuts, F.col("lang")))
    return kept.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
