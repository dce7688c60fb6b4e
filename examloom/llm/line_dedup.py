"""Operator 8: repeated runs of lines, DataFrame functions only.

The corpus is a sequence of line ids, documents one after another in the order of doc_id.  Prefix doubling ranks its
suffixes: rank k of a place names the bucket of suffixes that share its next ``2**k`` lines, so rank k + 1 comes from the
pair of ranks k at a place and ``2**k`` further on.  A bucket is named by its first place, and places alone in their
bucket drop out at once, so each round only carries what repeats.  The bucket of the prefix of any length m is the
pair of ranks k at its start and ``2**k`` before its end: the longest-common-prefix interval of depth m.  A run counts
from MIN_WORDS words; every repeated run of at least that is the union of its shortest heavy enough prefixes and suffixes,
so intervals of these depths reveal every maximal run.  All copies but the first in order are deleted.

Every bucket is counted by a partially aggregated ``min`` and joined back; windows hold one document only.

Edge cases: blank lines belong to no run, but go where the lines around them go; null texts stay null and empty ones empty;
repeated rows are copies, later ones by row; a null doc_id comes first; a document may be left with an empty text;
an empty table gives an empty result; columns other than text are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, in_order, marked, written

MIN_WORDS = 50
#: Bits of a place that count lines of a document: more lines than an array can have.
LINE_BITS = 28
WORD = r"[^\x20\x09-\x0D]+"


def document_order(rows: DataFrame, row: str, doc_id: str) -> DataFrame:
    """(row, doc): each document's number in the order of doc_id, then of row."""
    placed = in_order(rows.select(row, doc_id), F.col(doc_id), F.col(row))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").count()  # a row for each partition
    starts = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").select(row, (F.col("_start") + F.col("_at")).alias("doc"))


def line_table(rows: DataFrame, order: DataFrame, row: str, text: str) -> DataFrame:
    """Every line with a word: its place (document in order, line with a word), line number, words, and 128-bit id."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("text"))), lambda s: s["text"].rlike(WORD))
    lines = rows.select(row, F.posexplode(lines).alias("at", "got"))
    lines = lines.select(row, "at", F.col("got.line").alias("line"), F.regexp_count("got.text", F.lit(WORD)).cast("long").alias("words"), F.xxhash64("got.text").alias("id1"), F.xxhash64(F.lit(7), F.col("got.text")).alias("id2"))
    return lines.join(order, row).select((F.shiftleft("doc", LINE_BITS) + F.col("at")).alias("place"), "line", "words", "id1", "id2")


def buckets(df: DataFrame, *key: str) -> DataFrame:
    """``df`` with the first place that has the same key as ``rank``; rows alone in theirs are left out."""
    named = df.groupBy(*key).agg(F.min("place").alias("rank"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return df.join(named, list(key))


def repeated_runs(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, place, m, first_line, last_line) of every shortest heavy run that has a copy earlier in order."""
    doc = F.shiftright("place", LINE_BITS)
    ranked = written(buckets(lines, "id1", "id2").select("place", "line", "words", "rank", doc.alias("doc")), "line-ranks")

    near = Window.partitionBy("doc").orderBy("place")
    stretch = Window.partitionBy("doc", "stretch")
    runs = ranked.withColumn("stretch", F.col("place") - F.row_number().over(near))
    runs = runs.withColumn("upto", F.sum("words").over(stretch.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("from", F.col("upto") - F.col("words")).withColumn("all", F.max("upto").over(stretch.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ahead = stretch.orderBy("from").rangeBetween(0, min_words - 1)
    behind = stretch.orderBy("upto").rangeBetween(-(min_words - 1), 0)
    runs = runs.select(
        "doc", "place", "line", "from", "upto", "all",
        F.count("*").over(ahead).alias("m_ahead"), F.max("line").over(ahead).alias("last"), F.count("*").over(behind).alias("m_behind"), F.min("line").over(behind).alias("first"),
    )
    head = F.when(F.col("all") - F.col("from") >= min_words, F.struct(F.col("place").alias("place"), F.col("m_ahead").alias("m"), F.col("line").alias("first_line"), F.col("last").alias("last_line")))
    tail = F.when(F.col("upto") >= min_words, F.struct((F.col("place") - F.col("m_behind") + 1).alias("place"), F.col("m_behind").alias("m"), F.col("first").alias("first_line"), F.col("line").alias("last_line")))
    runs = runs.select("doc", F.explode(F.filter(F.array_distinct(F.array(head, tail)), lambda x: x.isNotNull())).alias("run")).select("doc", "run.*")
    runs = written(runs.dropDuplicates(["place", "m"]), "line-runs")

    longest = runs.agg(F.max("m").alias("m")).first()["m"] or 0
    ranks, found = ranked.select("doc", "place", "rank"), None
    for k in range(int(longest).bit_length()):
        if k:
            step = 1 << (k - 1)
            further = Window.partitionBy("doc").orderBy("place").rangeBetween(step, step)
            pairs = ranks.select("doc", "place", F.col("rank").alias("here"), F.max("rank").over(further).alias("there")).filter("there is not null")
            ranks = written(buckets(pairs, "here", "there").select("doc", "place", "rank"), "line-ranks")
        deep = runs.filter((F.col("m") >= (1 << k)) & (F.col("m") < (2 << k)))
        deep = deep.join(ranks.select("place", F.col("rank").alias("start")), "place")
        deep = deep.withColumn("_end", F.col("place") + F.col("m") - F.lit(1 << k)).join(ranks.select(F.col("place").alias("_end"), F.col("rank").alias("end")), "_end")
        later = buckets(deep, "m", "start", "end").filter("place > rank").select("doc", "place", "m", "first_line", "last_line")
        found = later if found is None else found.unionByName(later)
    return found if found is not None else runs.select("doc", "place", "m", "first_line", "last_line")


def cut_lines(found: DataFrame) -> DataFrame:
    """(doc, cuts): the lines to delete of each document as disjoint ranges in order."""
    seen = Window.partitionBy("doc").orderBy("place", "m")
    past = F.max(F.col("place") + F.col("m")).over(seen.rowsBetween(Window.unboundedPreceding, -1))
    apart = found.withColumn("_new", F.when(F.col("place") > F.coalesce(past, F.lit(-1)), 1).otherwise(0))
    apart = apart.withColumn("_no", F.sum("_new").over(seen.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = apart.groupBy("doc", "_no").agg(F.min("first_line").alias("a"), F.max("last_line").alias("b"))
    return ranges.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("cuts"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with later copies of repeated runs gone from ``text``, and two counts: lines before, lines deleted."""
    row, cuts, lines, hit = fresh(docs, "_row", "_cuts", "_lines", "_hit")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "line-docs")
    order = written(document_order(rows, row, doc_id), "line-order")
    table = written(line_table(rows, order, row, text), "line-table")
    gone = written(cut_lines(repeated_runs(table, min_words)).join(order, "doc").select(row, F.col("cuts").alias(cuts)), "line-cuts")
    # only texts that may lose lines cross the network; the others are told by a bitmap
    told = marked(rows, gone, row, hit)
    cut = told.filter(F.col(hit)).drop(hit).join(gone.hint("shuffle_hash"), row, "left")
    whole = told.filter(~F.col(hit)).drop(hit).withColumn(cuts, F.lit(None).cast(gone.schema[cuts].dataType))
    out = cut.unionByName(whole).withColumn(lines, F.split(F.col(text), "\n"))
    ends = F.concat(F.transform(cuts, lambda c: c["a"]), F.array(F.size(lines)))
    starts = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c["b"] + 1))
    kept = F.flatten(F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda g: F.slice(F.col(lines), g["s"] + 1, g["e"] - g["s"])))
    dropped = F.aggregate(cuts, F.lit(0), lambda n, c: n + c["b"] - c["a"] + 1)
    new_text = F.when(F.col(cuts).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))
    return out.select(
        *(new_text.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns),
        n_lines.alias(counts[0]), F.coalesce(dropped, F.lit(0)).alias(counts[1]),
    )
