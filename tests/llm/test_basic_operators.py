"""Operators 1, 5, 7, 9 and 10 against brute-force versions on small tables with every edge row."""

import base64
import collections
import hashlib
import random
import re
import zlib

import public_tokenizers as P
import tiktoken
from examloom.llm import byte_bpe, quality, sharding, url_filters, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [None, "", " ", "one", "a b c d e a b c d e a b", "x\nx\n\nx \n", "#*$%&|<> !", "é" * 300, "w " * 5000, "Tab\there  and\u3000there\n\n\n", "the cat " * 40, "a" * 20000]


def docs(spark, texts=TEXTS, ids=None):
    rows = [(i if ids is None else ids[i], t, ("en", "fr", None, "xx")[i % 4], "s", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def test_sharding_law_slots_and_edges(spark):
    df = docs(spark, TEXTS * 4, [None, None, *range(len(TEXTS) * 4 - 12), *[7] * 10])
    got = sharding.shard_documents(df, 16).collect()
    assert len(got) == len(TEXTS) * 4
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    assert collections.Counter((r.size, r.text_crc32) for r in got) == collections.Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in TEXTS * 4)
    assert sharding.shard_documents(df.limit(0), 16).count() == 0


def test_sharding_weights(spark):
    df = sharding.assign(spark.range(4000), "id", [1.0, 3.0, 0.0])
    n = {r["shard"]: r["count"] for r in df.groupBy("shard").count().collect()}
    assert set(n) == {0, 1} and 2.6 < n[1] / n[0] < 3.4


def test_byte_bpe_merges_unknown_words_together():
    bpe = byte_bpe.ByteBPE(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng, calls, merge_all = random.Random(5), [], bpe.merge_all
    bpe.merge_all = lambda pieces: calls.append(len(pieces)) or merge_all(pieces)
    words = ["".join(rng.choice("abdeghinorstué가") for _ in range(rng.randint(1, 12))) + rng.choice(["", ".", ",\nx"]) for _ in range(2000)]
    texts = [None, "", " ", *(" ".join(rng.choices(words, k=50)) for _ in range(100)), "aab " * 9, "x  y \n z", "b" + "ab" * 500]
    assert list(bpe.encode_all(texts)) == [ref.encode_ordinary(t or "") for t in texts]
    assert sum(calls) > 1000 and len(calls) < 200  # not a queue for each word
    calls.clear()
    assert list(bpe.encode_all(texts[:103])) == [ref.encode_ordinary(t or "") for t in texts[:103]] and not calls


def test_byte_bpe_equals_tiktoken(spark):
    file = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(file, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("ab  \n\t\x1c\x85\u3000\u00e9漢🙂1²'s,the ") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    df = docs(spark, texts)
    got = {r.doc_id: r for r in byte_bpe.round_trip(df, file, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    both = byte_bpe.decode_column(byte_bpe.encode_column(df, file, P.PATTERN), file, P.PATTERN).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in both)
    assert byte_bpe.round_trip(df.limit(0), file, P.PATTERN).count() == 0


def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    twice = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, dup = set(), 0
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in lines
            lines.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(twice)


def test_quality_counts_and_base_rules(spark):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    for r in quality.judge_documents(docs(spark), labels).collect():
        assert tuple(r)[1:6] == brute_counts(TEXTS[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.judge_documents(docs(spark).limit(0), labels.limit(0)).count() == 0


def test_quality_bound_is_clopper_pearson():
    from math import comb

    for k, n, a in ((0, 50, 0.05), (3, 200, 0.001), (10, 40, 0.01)):
        p = quality.upper_bound(k, n, a)
        assert abs(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) - a) < 1e-6 * 10
    assert quality.upper_bound(5, 5, 0.05) == 1.0 and quality.upper_bound(0, 0, 0.05) == 1.0


def test_quality_cutoffs_hold_the_risk():
    good = {"en": 4000, "fr": 30}
    counts = {("en", r.name, 0): 3990 for r in quality.RULES} | {("en", r.name, 20): 10 for r in quality.RULES} | {("fr", r.name, 0): 30 for r in quality.RULES}
    cuts = quality.pick(counts, good)
    assert all(s == "en" for s, _ in cuts) and len(cuts) == len(quality.RULES)
    assert all(c * quality.BINS <= 20 for c in cuts.values())


def test_quality_stage_keeps_columns_and_clean_texts(spark):
    rng = random.Random(1)
    clean = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 999)) for _ in range(40)) for _ in range(700)]
    junk = [" ".join(w + "***" for w in t.split()) for t in clean[:20]]
    df = docs(spark, clean + junk).withColumnRenamed("source", "n_words")
    df = df.withColumn("lang", df.n_chars.cast("string").substr(1, 0)).withColumn("doc_id", df.doc_id)
    labels = spark.createDataFrame([(i, 1) for i in range(700)], "doc_id long, quality int")
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & set(range(700))) >= 665 and not ids & set(range(700, 720))


PAGES = [(1, "http://a/b", "<p>x</p>"), (2, None, None), (3, "u\r\nv", ""), (4, "http://é", "<p>x</p>"), (None, "http://q", "<p>x</p>"), (5, "x", "WARC/1.1\r\n\r\n" * 3), (5, "x", "WARC/1.1\r\n\r\n" * 3), (6, "y", "\u2028é\n" * 70000)]


def test_warc_round_trip(spark):
    got = warc.archive_round_trip(spark.createDataFrame(PAGES, "page_id long, url string, html string")).collect()
    assert len(got) == len(PAGES)
    seen = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    want, first = collections.Counter(), {}
    for i, _, h in sorted(PAGES, key=lambda p: (p[0] is None, p[0])):
        b = (h or "").encode()
        d = base64.b32encode(hashlib.sha1(b).digest()).decode()
        want[i, len(b), d, "revisit" if d in first else "response", first.get(d)] += 1
        first.setdefault(d, i)
    assert seen == want
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_assembles_nested_captures(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = warc.write_archives(df, f"file://{tmp_path}/w")
    rows = warc.assemble(warc.read_archives(spark, path)).collect()
    assert len(rows) == len(PAGES)
    assert all(len(r.requests) == len(r.metadata) == 1 and r.requests[0].concurrent_to == r.record_id for r in rows)
    assert {bytes(r.response.payload) for r in rows if r.response.type == "response"} == {(h or "").encode() for _, _, h in PAGES}


URLS = [None, "", "nothing", "http://", "HTTP://Sub.Example.ORG/es/x?y", "http://example.org/en/12", "https://org/", "http://xorg/", "http://a.com/fr/", "http://a.com/de/?page=2", "http://b.net/login", "http://b.net/login2", "http://b.net/LOGIN?x", "http://b.net/f.pdf", "http://b.net/f.pdf?x", "ftp://a://b/c", "http://b.net?q=a&b", "http://ads.b.net/", "http://b.net/tag/x/page/2", "http://e.net#/login", "http://a.org\n/x"]


def test_url_filters_equal_all_rules_on_all_urls(spark):
    got = {r.page_id: r for r in url_filters.judge_pages(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [r for r in url_filters.HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.host + r.path), default=None)
        pattern = next((p for p in url_filters.PATTERNS if u is not None and re.search(url_filters.to_regex(p).replace("$", r"\Z"), u.lower())), None)
        r = got[i]
        assert (r.host, r.path, r.rule, r.pattern) == (host, path, rule and rule.host + rule.path, pattern), u
        assert r.verdict == (rule.verdict if rule else "block" if pattern else "allow")
    assert url_filters.tokens_of("/login^") == ["login"] and url_filters.tokens_of("login^") == [] and url_filters.tokens_of("|a*b^c|") == ["c"]
    assert url_filters.judge_pages(spark.createDataFrame([], "page_id long, url string")).count() == 0
