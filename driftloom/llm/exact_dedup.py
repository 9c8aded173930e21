"""Exact dedup: sorted runs of digests merged in rounds, the rows that stay handed back down."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from driftloom.llm.components import store

#: Characters that do not count: space and the ASCII controls from tab to carriage return.
SPACE = "[\\x20\\x09-\\x0D]+"

#: Tasks that the texts of one frequent digest are read by.
SALTS = 32


def normalised(text: Column) -> Column:
    """The text without white space; a null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, "")


def merge(entries: DataFrame, keys: list[str], width: int) -> DataFrame:
    """One round: runs of `entries` are merged `width` at a time.

    Run r goes to run r div width, as in a binomial tree whose strides are powers
    of width. Spark sorts each run by its keys and merges the sorted runs. Of
    equal keys the smallest `best` and the sum of `size` stay.
    """
    up = entries.withColumn("run", F.floor(F.col("run") / width).cast("int"))
    return up.groupBy("run", *keys).agg(F.min("best").alias("best"), F.sum("size").alias("size"))


def distinct_texts(texts: DataFrame, width: int, runs: int) -> DataFrame:
    """(digest, text) of `texts` (run, digest, text) by the same rounds; whole texts are compared at every level."""
    while runs > 1:
        texts = texts.withColumn("run", F.floor(F.col("run") / width).cast("int")).distinct()
        runs = -(-runs // width)
    return texts.select("digest", "text").distinct()


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs (doc_id, text).

    Texts are equal if they are so without white space. Of equal texts the row
    with the most code points stays, then that of the smallest doc_id (null last);
    of rows alike in both, any single one.

    Every partition of the scan is a run of (digest, best row, rows). Runs are
    merged by about the root of their number, so after two rounds one is left; a
    copy that is in every partition is at most that many entries in any merge.
    The results go down the same tree, joined by run and digest, so no join sees
    more rows of one digest than one partition had. The texts of digests met more
    than once go through the same rounds and are compared whole: two texts with
    one digest would end the job with an error.

    A null text is empty. Empty texts, and those of white space only, are equal.
    Repeated rows are copies of each other. A null doc_id is kept, and is the
    keep_id of its group only if no other row has as many code points. An empty
    table gives no rows. Further columns are ignored.
    """
    whole = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("given"))
    whole = whole.withColumn("text", normalised(F.col("given"))).withColumn("digest", F.unhex(F.sha2("text", 256)))
    whole = whole.withColumn("run", F.spark_partition_id())
    rows = store(
        whole.select(
            "run", "digest", "doc_id",
            F.struct(
                (-F.coalesce(F.length("given"), F.lit(0))).cast("bigint").alias("shorter"),
                F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.monotonically_increasing_id().alias("row"),
            ).alias("best"),
        ),
        "rows",
    )
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    width = max(2, math.isqrt(runs - 1) + 1)
    levels = [store(merge(rows.withColumn("size", F.lit(1).cast("bigint")), ["digest"], 1), "level")]
    left = runs
    while left > 1:
        levels.append(store(merge(levels[-1], ["digest"], width), "level"))
        left = -(-left // width)
    top = levels.pop()
    again = top.where("size > 1").select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("doc_id", "run"), F.lit(SALTS)).cast("int").alias("salt")
    texts = whole.select("run", "digest", "text", salt).join(again, ["salt", "digest"], "left_semi").drop("salt")
    clash = distinct_texts(texts, width, runs).groupBy("digest").count().where("count > 1")
    if clash.head(1):
        raise ValueError("two texts have one digest")
    # Down the tree: what a run holds is what the run it went to holds.
    known = top.select("run", "digest", F.col("best").alias("keep"), F.col("size").alias("group_size"))
    for level in reversed(levels):
        below = level.select("digest", F.col("run").alias("from")).withColumn("run", F.floor(F.col("from") / width).cast("int"))
        known = below.join(known, ["run", "digest"]).select(F.col("from").alias("run"), "digest", "keep", "group_size")
    return rows.join(known, ["run", "digest"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("best.row") == F.col("keep.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
