"""Operator 4: the library's ids, shards that decode to them at any place, and the digests of the query."""

import random
import zlib

import numpy as np
import public_tokenizers as P
from examloom.llm import token_files as tf
from tokenizers import Tokenizer

FILE = P.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "\n\n", "a\x1cb  c\tDé É", "<|endoftext|>x <|startoftext|>", "İ ΑΣ Σ ΣΑΣ", "é ́x é", "　a b", "ﬁ ½ ①", "don't 'S 1234 It's. x's", "be " * 3000, "w" * 5000, "word.,!! wörd| ǅ ʼn ß ẞ ÿ", "... ,a ,", "漢字 かな 한국어"]


def texts(seed, n=300):
    rng = random.Random(seed)
    al = ["a", "B", "é", "É", " ", "  ", "\n", ".", ",", "'s", "'", "1", "²", "|", "the", "ing", "Σ", "İ", "́", "\t", "🙂", "ſ"]
    return TEXTS + ["".join(rng.choice(al) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_pieces_encode_as_whole_texts():
    lib, enc = Tokenizer.from_file(FILE), tf.Encoder(FILE)
    assert enc.plain
    for t, ids in zip(texts(1, 2000), map(enc.encode, texts(1, 2000)), strict=True):
        assert ids.tolist() == lib.encode(t or "", add_special_tokens=False).ids, t


def test_re_pair_round_trips_and_random_access():
    rng = np.random.default_rng(0)
    for n, top in ((0, 5), (1, 5), (5000, 2), (20000, 7), (20000, 400)):
        seq = rng.integers(0, top, n).astype(np.uint32)
        cuts = np.sort(rng.integers(0, n + 1, 9))
        parts = np.split(seq, cuts)
        s = tf.Shard(tf.pack([None, *range(9)], parts, top))
        assert (s.ids() == seq).all() and s.none.tolist() == [True] + [False] * 9
        for i, p in enumerate(parts):
            assert (s.document(i) == p).all()
        for _ in range(20):
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert (s.slice(a, b) == seq[a:b]).all()
        if top == 2:
            assert len(s.symbols) < n / 3
    runs = np.repeat(np.arange(50, dtype=np.uint32) % 3, 37)
    assert (tf.Shard(tf.pack([1], [runs], 3)).ids() == runs).all()


def test_query_in_order_over_many_shards(spark, monkeypatch):
    lib = Tokenizer.from_file(FILE)
    rows = [(i if i % 17 else None, t, "x") for i, t in enumerate(texts(2))]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string")
    monkeypatch.setattr(tf, "SHARD_TOKENS", 500)
    got = tf.read_documents(tf.write_shards(df, FILE, 2)).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(r[0] for r in rows if r[0] is not None)
    want, at = {}, 0
    for i, t, _ in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        at += r.n_tokens
    assert tf.read_documents(tf.write_shards(df.limit(0), FILE, 2)).count() == 0
