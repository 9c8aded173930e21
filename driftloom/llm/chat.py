"""Chat formatting: logged snapshots of a conversation collapse into the longest, which is rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from driftloom.llm.components import store

#: Turns rendered into one row; a longer conversation has several rows.
PART_TURNS = 1000
SUMS = ("a", "b", "c", "d")
KEY = ["pos", *SUMS]


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, run, pos, n_turns, role, text): turns in order, pos from 1.

    Rows are laid out by range on all that orders them, so one conversation may
    span many tasks; a row's place is that in its task and the rows of earlier ones.
    """
    held = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = ["conv_id", "turn", "role", F.xxhash64("text")]
    laid = held.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    laid = store(laid.withColumn("at", F.monotonically_increasing_id()).withColumn("run", F.shiftright("at", 33)), "turns")
    runs = laid.groupBy("run", "conv_id").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("run").alias("r"), F.col("conv_id").alias("c"), F.sum("rows").over(whole).alias("n_turns"),
        (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift"),
    )
    placed = laid.join(runs, (F.col("run") == F.col("r")) & F.col("conv_id").eqNullSafe(F.col("c")))
    return placed.select("conv_id", "run", (F.col("at") + F.col("shift")).alias("pos"), "n_turns", "role", "text")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Rows of `numbered` with the rolling hash of all turns up to each.

    Each turn's hash takes in its place, role and text; the four columns are sums
    of their 32-bit halves under two seeds, so a prefix's hash rolls on by adding
    a turn, within tasks and across them, and cannot overflow.
    """
    first, second = (F.xxhash64(F.lit(seed), "pos", "role", "text") for seed in (1, 2))
    low = F.lit(0xFFFFFFFF).cast("bigint")
    hashed = turns.select(
        "conv_id", "run", "pos", "n_turns", first.bitwiseAND(low).alias("a"), F.shiftrightunsigned(first, 32).alias("b"),
        second.bitwiseAND(low).alias("c"), F.shiftrightunsigned(second, 32).alias("d"),
    )
    rolling = Window.partitionBy("run", "conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = hashed.groupBy("run", "conv_id").agg(*[F.sum(s).alias(s) for s in SUMS]).select(
        F.col("run").alias("r"), F.col("conv_id").alias("v"),
        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"{s}0") for s in SUMS],
    )
    inside = hashed.select("conv_id", "run", "pos", "n_turns", *[F.sum(s).over(rolling).alias(s) for s in SUMS])
    return inside.join(runs, (F.col("run") == F.col("r")) & F.col("conv_id").eqNullSafe(F.col("v"))).select(
        "conv_id", "pos", "n_turns", *[(F.col(s) + F.col(f"{s}0")).alias(s) for s in SUMS]
    )


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id of the conversations that no longer one begins with; of equal ones the least."""
    ends = prefixes.where(F.col("pos") == F.col("n_turns")).groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"))
    longer = prefixes.where(F.col("pos") < F.col("n_turns")).select(*KEY).distinct()
    return ends.join(longer, KEY, "left_anti").select("conv_id")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, rendered): PART_TURNS turns a row, in order.

    A turn is <|im_start|>role, a line feed, its text, <|im_end|> and a line feed.
    Markers inside a role or a text are broken up by a space, so they end no turn.
    """
    def plain(c: str):
        return F.replace(F.col(c), F.lit("<|im_"), F.lit("<| im_"))

    piece = F.concat(F.lit("<|im_start|>"), plain("role"), F.lit("\n"), plain("text"), F.lit("<|im_end|>\n"))
    part = F.floor((F.col("pos") - 1) / PART_TURNS).cast("bigint").alias("part")
    rows = turns.select("conv_id", part, "n_turns", F.struct("pos", piece.alias("piece")).alias("turn"))
    return rows.groupBy("conv_id", "part", "n_turns").agg(F.array_sort(F.collect_list("turn")).alias("turns")).select(
        "conv_id", "part", "n_turns", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("rendered")
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """Maximal conversations of turns (conv_id, turn, role, text), rendered.

    A conversation whose turns are the first turns of a longer one, or equal to
    those of one with a lesser conv_id, is a snapshot and goes. Turns count as
    equal if their role and text are; their order is by turn (nulls first), then
    role, hash and bytes of the text, and repeated rows are turns of their own. A null
    role is user, a null text is empty; rows without conv_id are one
    conversation. Further columns are ignored.
    """
    placed = store(numbered(turns), "numbered")
    kept = maximal(store(prefix_hashes(placed), "prefixes")).withColumnRenamed("conv_id", "k")
    return render(placed.join(kept, F.col("conv_id").eqNullSafe(F.col("k")), "left_semi"))
