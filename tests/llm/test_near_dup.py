"""Operator 2: alignment against the plain programme, classes against all pairs."""

import random

import numpy as np
from examloom.llm import near_dup as nd


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def changed(rng, words, n):
    w = list(words)
    for _ in range(n):
        i = rng.randrange(len(w) + 1)
        kind = rng.randrange(3)
        if kind == 0 and i < len(w):
            w[i] = f"new{rng.randrange(50)}"
        elif kind == 1:
            w.insert(i, f"new{rng.randrange(50)}")
        elif i < len(w) and len(w) > 1:
            del w[i]
    return w


def test_edits_equal_the_plain_programme():
    rng = random.Random(2)
    for _ in range(400):
        a = [rng.randrange(rng.choice([3, 50, 1000])) for _ in range(rng.randint(1, 120))]
        b = [int(str(x).replace("new", "9")) for x in changed(rng, a, rng.randint(0, 40))] if rng.random() < 0.8 else [rng.randrange(50) for _ in range(rng.randint(1, 120))]
        want = plain(a, b)
        for most in (0, 3, 24, 70, 200):
            got = nd.edits(np.array(a, np.uint32), np.array(b, np.uint32), most)
            assert got == min(want, most + 1), (a, b, most, want)


def test_anchors_bound_from_above():
    rng = random.Random(9)
    for _ in range(200):
        a = [rng.randrange(200) for _ in range(rng.randint(1, 90))]
        b = [int(str(x).replace("new", "9")) for x in changed(rng, a, rng.randint(0, 20))]
        x, y = np.array(a, np.uint32), np.array(b, np.uint32)
        assert nd.at_most(x, y) >= plain(a, b)
        assert nd.similar(x, y) == (plain(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9))


def test_recall_of_the_buckets_by_share_of_edits():
    """Pairs within the threshold that share a bucket: at least nine in ten at every length and share of edits."""
    rng = random.Random(3)
    for n in (15, 40, 60, 200, 800):
        for rate in (0.05, 0.1, 0.15, 0.19):
            met = tried = 0
            while tried < 120:
                a = [rng.randrange(1 << 30) for _ in range(n)]
                b = list(a)
                for i in rng.sample(range(n), int(rate * n)):
                    b[i] = rng.randrange(1 << 30)
                x, y = np.array(a, np.uint32), np.array(b, np.uint32)
                tried += 1
                met += bool(np.intersect1d(nd.sketch(x), nd.sketch(y)).size)
            assert met >= 0.9 * tried, (n, rate, met / tried)


def corpus(seed):
    rng = random.Random(seed)
    texts = [None, "", "  \n", "two words", "two words", "two  words", "a b c d", "x " * 3000]
    for _ in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([30, 60, 200]))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            texts.append(" ".join(changed(rng, base, rng.choice([0, 1, 2, max(1, len(base) // 30)]))))
    rng.shuffle(texts)
    return texts


def classes_of(texts):
    """Least index of each text's component over all pairs; near pairs are either clearly alike or clearly not."""
    codes = [(t or "").split() for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = codes[i], codes[j]
            if a and b and abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and (texts[i] == texts[j] or plain(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def test_classes_equal_all_pairs(spark):
    texts = corpus(11)
    want = classes_of(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
    extra = df.withColumn("row", df.doc_id).withColumn("root", df.text).withColumn("_row", df.text)
    kept = nd.keep_one(extra)
    assert kept.columns == extra.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, w in enumerate(want) if w == i})


def test_null_ids_and_empty_tables(spark):
    rows = [(None, "one two three four five six"), (None, "one two three four five six"), (4, "one two three four five six"), (4, "other words here and there now"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id) for r in nd.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 4), (None, 4), (4, 4), (4, 4), (None, None)], key=str)
    assert nd.near_duplicates(df.limit(0)).count() == 0
    assert nd.keep_one(df).count() == 3


def test_a_lone_pair_of_short_texts_with_one_mer_in_common(spark):
    """Their only shared bucket is a single mer."""
    for seed in range(100):
        rng = random.Random(seed)
        a = [f"w{rng.randrange(100000)}" for _ in range(25)]
        b = [f"z{i}" if i in (3, 7, 11, 15, 19) else w for i, w in enumerate(a)]
        x, y = (nd.sketch(nd.word_codes([w.encode() for w in t], {})).tolist() for t in (a, b))
        if len(set(x) & set(y)) == 1:
            break
    else:
        raise AssertionError("no such pair")
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, "some other words that nobody else has")], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in nd.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_a_link_of_two_texts_in_a_crowded_bucket(spark):
    """A passage brings 300 texts into the same buckets; two of them are near copies that share no mer besides it."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(40)]
    own = [[f"w{rng.randrange(100000)}" for _ in range(20)] for _ in range(299)]
    own.append([f"z{i}" if i % 5 == 4 else w for i, w in enumerate(own[150])])
    df = spark.createDataFrame([(i, " ".join(passage + o)) for i, o in enumerate(own)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(df).collect()}
    assert got == {i: 150 if i == 299 else i for i in range(300)}


def test_blocks_leave_the_pairs_that_tallies_and_lengths_leave():
    rng = random.Random(8)
    texts = [[rng.randrange(60) for _ in range(rng.randint(1, 30))] for _ in range(60)]
    texts += [t[:-1] + [rng.randrange(60)] for t in texts]
    codes = [np.array(t, np.uint32) for t in texts]
    roots = np.array([rng.randrange(90) for _ in texts])
    rows = (np.arange(len(texts)), np.array([len(t) for t in texts]), roots, np.stack([np.frombuffer(nd.tally(c), np.uint8) for c in codes]))
    for x, y, same in ((slice(0, 120), slice(0, 120), True), (slice(0, 50), slice(50, 120), False)):
        sides = tuple(r[x] for r in rows), tuple(r[y] for r in rows)
        a, b = nd.block_pairs(*sides, same, 0, nd.SLOTS)
        got = set(zip(a.tolist(), b.tolist(), strict=True))
        assert len(got) == len(a)
        windows = [set(zip(*(v.tolist() for v in nd.block_pairs(*sides, same, low, high)), strict=True)) for low, high in ((0, 1), (1, 8), (8, nd.SLOTS))]
        assert set().union(*windows) == got and sum(map(len, windows)) == len(got)
        for i in rows[0][x].tolist():
            for j in rows[0][y].tolist():
                if (i < j or not same) and roots[i] != roots[j] and nd.similar(codes[i], codes[j]):
                    assert (i, j) in got


def test_fine_tallies_leave_few_pairs_of_long_texts():
    """A crowd of long unlike texts (op2 on check_h): TALLY classes leave most pairs, fine ones few, and those of similar texts."""
    rng = random.Random(9)
    common = [rng.randrange(1 << 32) for _ in range(580)]
    codes = [np.array(common + [rng.randrange(1 << 32) for _ in range(200)], np.uint32) for _ in range(30)]
    codes.append(np.array([*codes[3][:700], *codes[4][700:]], np.uint32))
    words = [c.tobytes() for c in codes] + [np.arange(2000, dtype=np.uint32).tobytes()]
    made = [b"\1" + w if len(w) <= nd.FINE else b"\0" + nd.tally(np.frombuffer(w, np.uint32), nd.FINE) for w in words]
    assert [nd.fine_tally(x) for x in made] == [nd.tally(np.frombuffer(w, np.uint32), nd.FINE) for w in words]
    rows = (np.arange(31), np.full(31, 780), np.arange(31), *(np.stack([np.frombuffer(nd.tally(c, k), np.uint8) for c in codes]) for k in (nd.TALLY, nd.FINE)))
    coarse, fine = (set(zip(*(v.tolist() for v in nd.block_pairs(r, r, True, 0, nd.SLOTS)), strict=True)) for r in (rows[:4], rows))
    similar = {(i, j) for i in range(31) for j in range(i + 1, 31) if nd.similar(codes[i], codes[j])}
    assert similar and similar <= fine < coarse and len(fine) * 10 < len(coarse)


def test_gaps_of_classes_tell_both_tallies_in_few_bytes():
    """Members of crowds bring a byte a word to their buckets, not the word's code and a tally besides (disk of near_dedup)."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 20, 165, 1000, 4000, 9000):
        for codes in (rng.integers(0, 1 << 32, n, np.uint32), np.full(n, 4095, np.uint32)):
            made = nd.class_gaps(codes)
            assert len(made) <= min(n + 17, nd.FINE + 1)
            fine = np.frombuffer(nd.fine_tally(made), np.uint8)
            assert fine.tobytes() == nd.tally(codes, nd.FINE)
            assert nd.coarse_tallies(fine[None]).tobytes() == nd.tally(codes)


def test_small_blocks_windows_and_finish_give_the_same_classes(spark, monkeypatch):
    """A bucket of many blocks, with a largest class of its own blocks, and links contracted by all tasks."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(60)]
    texts = [" ".join(changed(rng, base, rng.randint(0, 14))) for _ in range(70)]
    texts += [" ".join(base[:25] + [f"w{rng.randrange(10**6)}" for _ in range(30)]) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wide = {r.doc_id: r.class_id for r in nd.near_duplicates(df).collect()}
    for name, small in (("BLOCK", 4), ("FINISH", 3), ("DIRECT", 0), ("FEW", 0)):
        monkeypatch.setattr(nd, name, small)
    assert {r.doc_id: r.class_id for r in nd.near_duplicates(df).collect()} == wide
    want = classes_of(texts)
    assert [wide[i] for i in range(len(texts))] == want


def test_very_long_texts(spark):
    """Texts of 30,000 words: one edited in one word of fifty, one unlike."""
    rng = random.Random(5)
    a = [f"w{rng.randrange(10**6)}" for _ in range(30_000)]
    b = [f"z{i}" if i % 50 == 0 else w for i, w in enumerate(a)]
    c = [f"w{rng.randrange(10**6)}" for _ in range(30_000)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate((a, b, c))], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in nd.near_duplicates(df).collect()} == {0: 0, 1: 0, 2: 2}
