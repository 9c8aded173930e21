"""Connected components by repeated contraction, as DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftloom.session import scratch_path


def store(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write `df` to the shared scratch folder and read it back.

    It cuts the lineage as a checkpoint does; as Parquet is packed and has known
    sizes, Spark may itself choose to broadcast a small one. A codec given packs it
    in place of Spark's own.
    """
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the files of shuffles whose result has been written.

    It does so when the driver's collector finds nothing that refers to them; a
    job of many steps asks for that between its large ones.
    """
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of `edges` can reach.

    Every round joins each node to the neighbour of least hash (or itself) and
    keeps the edges between the results: a star takes two rounds whatever its
    size, a path about as many as its length has digits. A node with very
    many edges is only ever aggregated with partial sums. Nodes are integers;
    loops only name a node; repeated edges do no harm; null ends are left out.
    """
    edges = edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).where(
        F.col("a").isNotNull() & F.col("b").isNotNull()
    )
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    live = store(both.distinct(), "edges")
    where: DataFrame | None = None

    def placed(c: str):
        return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))

    for _ in range(200):
        least = live.groupBy("a").agg(F.least(F.min(placed("b")), F.first(placed("a")))["id"].alias("to"))
        if where is None:
            where = store(least.select(F.col("a").alias("node"), F.col("to").alias("root")), "roots")
            moved = where.select(F.col("node").alias("a"), F.col("root").alias("to"))
        else:
            moved = store(least, "moves")
            where = store(
                where.join(moved.withColumnRenamed("a", "root"), "root", "left").select(
                    "node", F.coalesce("to", "root").alias("root")
                ),
                "roots",
            )
        ends = moved.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        left = live.join(moved, "a").join(ends, "b").where(F.col("to") != F.col("tb"))
        live = store(left.select(F.col("to").alias("a"), F.col("tb").alias("b")).distinct(), "edges")
        if live.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    names = where.groupBy("root").agg(F.min("node").alias("component"))
    return where.join(names, "root").select("node", "component")
