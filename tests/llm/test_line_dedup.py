"""Operator 8 against a brute-force version: every line inside a heavy run that has an earlier copy is deleted, and blanks between two such."""

import random
import re

from examloom.llm import line_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, min_words):
    """docs: (doc_id, text) in table order; returns the deleted line numbers of each."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, i))
    seq = []  # (doc, line, text, words)
    for i in order:
        seq.append([(i, n, x, len(WORD.findall(x))) for n, x in enumerate((docs[i][1] or "").split("\n")) if WORD.search(x)])
    gone = {i: set() for i in range(len(docs))}
    flat = [(d, k) for d, s in enumerate(seq) for k in range(len(s))]
    for b, (db, kb) in enumerate(flat):
        for da, ka in flat[:b]:
            n = 0
            while kb + n < len(seq[db]) and ka + n < len(seq[da]) and seq[db][kb + n][2] == seq[da][ka + n][2]:
                n += 1
            if n and sum(x[3] for x in seq[db][kb : kb + n]) >= min_words:
                gone[seq[db][kb][0]].update(x[1] for x in seq[db][kb : kb + n])
    for s in seq:  # a blank line goes where the lines around it go
        for x, y in zip(s, s[1:]):
            if {x[1], y[1]} <= gone[x[0]]:
                gone[x[0]].update(range(x[1], y[1]))
    return gone


def check(spark, docs, min_words):
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(docs)], "doc_id long, text string, _row int").coalesce(1)
    got = {r["_row"]: r for r in line_dedup.dedup_lines(df, min_words=min_words).collect()}
    assert len(got) == len(docs)
    gone = brute(docs, min_words)
    for i, (_, t) in enumerate(docs):
        lines = (t or "").split("\n")
        want = None if t is None else "\n".join(x for n, x in enumerate(lines) if n not in gone[i])
        assert got[i].text == want, (i, t)
        assert got[i].n_dropped == len(gone[i]) and got[i].n_lines == (0 if t is None else len(lines))


def test_random_documents(spark):
    rng = random.Random(3)
    pool = ["a", "b c", "d e f", "g h i j k", "", "  ", "l m n o p q r s t u v", "w"]
    docs = []
    for i in range(60):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 14))]
        if docs and rng.random() < 0.4:
            lines[3:3] = (rng.choice(docs)[1] or "").split("\n")[:9]
        docs.append((rng.choice([None, rng.randint(0, 40)]), "\n".join(lines) if rng.random() > 0.05 else None))
    for min_words in (1, 4, 9, 25):
        check(spark, docs, min_words)


def test_edges(spark):
    long = "\n".join(f"line {i} of a long text" for i in range(400))
    check(spark, [(1, long), (2, long), (3, "x\n" + long), (4, None), (5, ""), (6, "\n\n"), (6, "\n\n"), (7, "one two " * 40), (7, "one two " * 40)], 50)
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_that_lose_nothing_do_not_cross_the_network(spark):
    """One of 200 documents loses lines: the other texts are in no shuffle (disk of line_dedup)."""
    rng = random.Random(4)
    texts = ["\n".join(f"{rng.getrandbits(64):x} {rng.getrandbits(64):x}" for _ in range(100)) for _ in range(200)]
    texts[199] = texts[0]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = line_dedup.dedup_lines(df)
        got = {r.doc_id: r.text for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == {i: "" if i == 199 else t for i, t in enumerate(texts)}
    sent, todo = 0, [out._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Exchange":
            sent += node.metrics().apply("shuffleBytesWritten").value()
    assert sent * 10 < sum(map(len, texts))
