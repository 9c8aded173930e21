"""Samplers seeded by hashing keys: the draw does not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from driftloom.operators.numbering import number_rows, top_n_per_group

HASH_BUCKETS = 16**4


def hash_text(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by '#'."""
    columns = [F.lit(p) if isinstance(p, int) else F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("#", *[c.cast("string") for c in columns]))


def hash_int(*parts: Column | str | int) -> Column:
    """32-bit unsigned integer from the md5 of the parts."""
    return F.conv(F.substring(hash_text(*parts), 1, 8), 16, 10).cast("bigint")


def hash_uniform(*parts: Column | str | int) -> Column:
    """Uniform number in [0, 1) from the md5 of the parts."""
    return hash_int(*parts) / F.lit(float(2**32))


def sample_exact_n(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly n rows without replacement, or all rows if there are no more.

    The n smallest hashes win. The cut is found from a histogram of hash
    prefixes, at most HASH_BUCKETS rows, so only the bucket holding the cut is
    ever ordered.
    """
    ranked = df.withColumn("_h", hash_text(key, seed))
    ranked = ranked.withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    counts = ranked.groupBy("_b").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy().orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).where(F.col("_before") < n)
    held = ranked.join(counts, "_b")
    within = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    cut = held.where(F.col("_before") + F.col("_n") > n).withColumn("_r", within)
    cut = cut.where(F.col("_before") + F.col("_r") <= n).drop("_r")
    return held.where(F.col("_before") + F.col("_n") <= n).unionByName(cut).select(*df.columns)


def subset_by_position(df: DataFrame, positions: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows at the ordinal positions listed in `positions(pos)`, in `key` order."""
    keys = number_rows(df.select(*key), key).join(positions.select("pos").distinct(), "pos", "left_semi")
    return df.join(keys, list(key))


def sample_n_per_group(
    df: DataFrame, group: str, n: int, key: str, seed: int = 0, short_groups: str = "keep"
) -> DataFrame:
    """n rows per group without replacement.

    A group with fewer rows is kept whole ("keep"), left out ("drop"), or makes
    the query fail ("error").
    """
    if short_groups != "keep":
        sizes = df.groupBy(group).agg(F.count("*").alias("_size"))
        if short_groups == "error":
            message = F.concat(F.lit("fewer rows than asked for in group "), F.col(group).cast("string"))
            enough = F.when(F.col("_size") >= n, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
        else:
            enough = F.col("_size") >= n
        df = df.join(sizes.where(enough).select(group), group)
    ranked = df.withColumn("_h", hash_text(key, seed))
    return top_n_per_group(ranked, [group], [F.col("_h"), F.col(key)], n, "draw").drop("_h")


def draws(spark: SparkSession, iterations: int, batch: int, population: int, seed: int = 0) -> DataFrame:
    """(iter, draw, pos): `batch` uniform positions in [0, population) per iteration."""
    return (
        spark.range(1, iterations + 1).withColumnRenamed("id", "iter")
        .withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(batch - 1).cast("bigint"))))
        .withColumn("pos", hash_int("iter", "draw", seed) % F.lit(population))
    )


def minibatch_with_replacement(
    numbered: DataFrame, iterations: int, batch: int, population: int, seed: int = 0, pos: str = "pos"
) -> DataFrame:
    """Rows drawn with replacement from rows numbered by `pos`; repeats stay."""
    drawn = draws(numbered.sparkSession, iterations, batch, population, seed)
    return drawn.withColumnRenamed("pos", pos).join(numbered, pos)


def sample_tensor_docs(cells: DataFrame, n_docs: int, size: int, seed: int = 0) -> DataFrame:
    """`size` documents drawn with replacement, the same for every slice,
    renumbered 0..size-1 on axis d."""
    drawn = draws(cells.sparkSession, 1, size, n_docs, seed).select(
        F.col("pos").alias("d"), F.col("draw").cast("int").alias("_new")
    )
    return cells.join(drawn, "d").select("t", "v", F.col("_new").alias("d"), "x")


def sample_time_patches(
    cells: DataFrame, n_slices: int, length: int, patches: int, seed: int = 0,
    merge_terms_and_docs: int | None = None,
) -> DataFrame:
    """Random windows of `length` slices stacked on a new axis `patch`.

    A start may fall on 0 .. n_slices-length-1. With `merge_terms_and_docs` set
    to the number of documents D, term and document share one axis v*D+d.
    """
    starts = draws(cells.sparkSession, 1, patches, n_slices - length, seed).select(
        F.col("draw").cast("int").alias("patch"), F.col("pos").cast("int").alias("_a")
    )
    # Listing the slices of each window makes this an equi-join on t.
    windows = starts.select(
        "patch", F.posexplode(F.sequence(F.col("_a"), F.col("_a") + (length - 1))).alias("_k", "t")
    )
    out = cells.join(windows, "t").withColumn("t", F.col("_k").cast("int"))
    if merge_terms_and_docs is None:
        return out.select("patch", "t", "v", "d", "x")
    merged = F.col("v").cast("bigint") * merge_terms_and_docs + F.col("d")
    return out.select("patch", "t", merged.alias("vd"), "x")


def sample_topic_words(
    shares: DataFrame, n_samples: int, seed: int = 0
) -> DataFrame:
    """Count words drawn from each topic's distribution.

    `shares(topic, term, rank, share)` holds the top words of each topic. Draws
    are placed by the running sum of shares; a topic has few top words, so the
    window and the word intervals stay small.
    """
    order = Window.partitionBy("topic").orderBy("rank")
    upto = F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = F.max("rank").over(Window.partitionBy("topic"))
    words = shares.select(
        "topic", "term", "rank", upto.alias("hi"), (upto - F.col("share")).alias("lo"),
        (F.col("rank") == last).alias("final"),
    )
    intervals = words.groupBy("topic").agg(
        F.sort_array(F.collect_list(F.struct("rank", "term", "lo", "hi", "final"))).alias("words")
    )
    numbers = F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1)))
    drawn = intervals.select("topic", "words", numbers.alias("draw")).withColumn(
        "u", hash_uniform("topic", "draw", seed)
    )
    hit = F.filter("words", lambda w: (F.col("u") < w["hi"]) | w["final"])[0]["term"]
    return drawn.select("topic", hit.alias("term")).groupBy("topic", "term").agg(F.count("*").alias("n"))
