"""Operator 3 against a plain alignment of every item with every text."""

import random

import numpy as np
from examloom.llm import decontaminate as dc


def plain(item, text):
    """Fewest edits of ``item`` against any stretch of ``text``."""
    a, b = dc.codes(item).tolist(), dc.codes(text).tolist()
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[i] = rng.choice("abcdefgh ")
        elif kind == 1:
            s.insert(i, rng.choice("xyz"))
        else:
            del s[i]
    return "".join(s)


def cases(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    items = [" ".join(word() for _ in range(rng.randint(5, 30))) for _ in range(12)] + ["abc", "Qq", "aaaaaaaaaaaaaaaaaaaaaaaa"]
    texts = []
    for _ in range(60):
        t = " ".join(word() for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.7:
            it = rng.choice(items)
            t = t[: len(t) // 2] + edited(rng, it.upper() if rng.random() < 0.3 else it, rng.randint(0, 1 + int(len(it) * 0.13))) + t[len(t) // 2 :]
        texts.append(t)
    return items, texts + ["", "a" * 100, items[0], items[0] * 3]


def test_every_occurrence_within_the_budget_is_found():
    for seed in range(3):
        items, texts = cases(seed)
        its = dc.Items(list(enumerate(items)))
        for t in texts:
            got = {k: (s, e, n) for k, s, e, n in its.search(t)}
            for k, it in enumerate(items):
                n = plain(it, t)
                if n <= dc.budget(len(it)):
                    assert got[k][2] == n, (it, t)
                    s, e, _ = got[k]
                    assert 0 <= s <= e <= len(t) and plain(it, t[s:e]) <= n + 1
                else:
                    assert k not in got


def test_segments_meet(monkeypatch):
    items, texts = cases(7)
    its = dc.Items(list(enumerate(items)))
    long = " ".join(texts)
    want = [(k, n) for k, _, _, n in its.search(long)]
    monkeypatch.setattr(dc, "SEGMENT", 64)
    assert [(k, n) for k, _, _, n in its.search(long)] == want


def test_query_edges_and_blocks(spark, monkeypatch):
    items, texts = cases(9)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + [None, ""])] + [(None, items[1])], "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (99, None), (98, ""), (None, items[2])], "item_id long, text string")
    rows = {tuple(r) for r in dc.find_items(docs, bench).collect()}
    assert any(r[0] is None and r[1] == 1 for r in rows) and any(r[1] is None for r in rows)
    monkeypatch.setattr(dc, "ITEM_CHARS", 300)
    assert {tuple(r) for r in dc._search(docs, bench, ["doc_id"], "text", lambda g: g).collect()} == rows
    kept = dc.drop_contaminated(docs.withColumn("_row", docs.doc_id), bench)
    assert kept.columns == ["doc_id", "text", "_row"]
    hit = {r[0] for r in rows}
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(texts) + 2) if i not in hit]
    assert dc.find_items(docs.limit(0), bench).count() == 0 and dc.find_items(docs, bench.limit(0)).count() == 0


def test_alignment_stays_in_its_band():
    item, text = dc.codes("abcdefghij"), dc.codes("zzzabcdefghijzzz")
    assert dc.fewest_edits(item, text, 2, 4) == (0, 13)
    assert dc.fewest_edits(item, text, 8, 9)[0] > 0
    assert np.array_equal(dc.codes("A\tÉ"), dc.codes("a É"))


def test_long_runs_of_one_letter_need_no_memory_for_their_pairs():
    """Two million equal letters against an item of 5,000: some 10^10 pairs of places."""
    import tracemalloc

    its = dc.Items([(0, "a" * 5000), (1, "ab" * 2000), (2, "b" * 300 + "c" * 300)])
    tracemalloc.start()
    got = its.search("a" * 2_000_000)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert got == [(0, 0, 5000, 0)] and peak < 500 << 20


def test_frequent_grams_counted_by_blocks_find_what_plain_alignment_finds(monkeypatch):
    rng = random.Random(21)
    monkeypatch.setattr(dc, "OFTEN", 3)
    monkeypatch.setattr(dc, "PAIRS", 50)
    items = ["a" * 40, "ab" * 30, "abc" * 15 + "d" * 30, "the quick brown fox jumps over the lazy dog again"]
    its = dc.Items(list(enumerate(items)))
    for _ in range(60):
        it = rng.choice(items)
        t = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 50))) + edited(rng, it, rng.randint(0, 6)) + "a" * rng.randint(0, 60)
        got = {k: n for k, _, _, n in its.search(t)}
        for k, item in enumerate(items):
            n = plain(item, t)
            assert (got.get(k) == n) == (n <= dc.budget(len(item))), (item, t, n, got)
