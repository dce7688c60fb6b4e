"""The pipeline stage by stage on a small corpus with known junk, copies, leaks and clean documents."""

import random

import public_tokenizers as P
import tiktoken_reference
from examloom.llm import pipeline


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    rng = random.Random(8)

    def prose(n):
        return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(5000)}" for _ in range(n))

    clean = [prose(80) for _ in range(40)]
    shared, item = prose(60), " ".join("item" + str(rng.randrange(100)) for _ in range(15))
    near = clean[0].split()
    near[40] = "changed"
    rows = [*clean, "junk " * 40, "too short", shared + "\n" + prose(30), prose(30) + "\n" + shared, clean[1], " ".join(near), prose(30) + " " + item + " " + prose(20), None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, seen = docs, []
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns, name
        at = spark.createDataFrame(out.collect(), docs.schema)
        seen.append({r.doc_id: r for r in at.collect()})
    good = set(range(40))
    assert set(seen[0]) == good | {42, 43, 44, 45, 46}
    assert set(seen[1]) == good | {42, 43, 45, 46} and shared not in seen[1][43].text and shared in seen[1][42].text
    assert seen[1][43].n_chars == len(seen[1][43].text)
    assert set(seen[2]) == good | {42, 43, 46}
    assert set(seen[3]) == good | {42, 43}
    final = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} == set(seen[3])
    lib = tiktoken_reference.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert all(r.ids == lib.encode_ordinary(r.text) for r in final)
