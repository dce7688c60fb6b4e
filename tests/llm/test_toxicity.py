"""Operator 6: exact neighbours, monotone calibration, held-out accuracy, and edges."""

import random
import zlib

import numpy as np
from examloom.llm import toxicity as tx


def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(300):
        t = np.sort(rng.choice(80, rng.integers(0, 9), replace=False))
        w = rng.random(len(t)) + 0.1
        rows.append((t, (w / np.linalg.norm(w)).astype(np.float32) if len(t) else w.astype(np.float32)))
    index = tx.BlockMaxIndex(rows, 80)
    dense = np.zeros((300, 80))
    for i, (t, w) in enumerate(rows):
        dense[i, t] = w
    for i in range(60):
        cos = dense @ dense[i]
        cos[i] = -1
        got, sims = index.search(*rows[i], 7, but=i) if len(rows[i][0]) else (np.empty(0), np.empty(0))
        want = np.sort(cos[cos > 1e-9])[::-1][:7]
        assert np.allclose(np.sort(sims)[::-1], want, atol=1e-5) and i not in got.tolist()


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(2)
    v = rng.choice(20, 300) / 20
    y = (rng.random(300) < v**2).astype(float)
    w = rng.random(300) + 0.5
    x, f = tx.isotonic(v, y, w)
    assert (np.diff(f) >= 0).all() and (np.diff(x) >= 0).all()
    assert abs(np.interp(v, x, f) @ w - y @ w) < 1e-6


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        words = [f"w{rng.randrange(300)}" for _ in range(60)]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(60), rng.choice(["Scum,", "vile", "wretchish", "wretchely"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (None, rows[0][1]), (5, rows[5][1])]
    labels += [(None, 1), (3, None), (5, labels[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", __import__("pyspark").sql.functions.lit("x"))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = tx.score_documents(docs, known).collect()
    assert len(got) == len(rows)
    truth, wrong, held = dict(labels), 0, 0
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.held_out and r.doc_id in truth and truth[r.doc_id] is not None:
            held += 1
            wrong += r.predicted != truth[r.doc_id]
    assert held > 150 and wrong <= 0.03 * held
    assert tx.score_documents(docs.limit(0), known).count() == 0
    assert {r.score for r in tx.score_documents(docs, known.limit(0)).collect()} == {0.0}
