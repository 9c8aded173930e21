"""Near-duplicate vectors by an exact range join over pivot cells."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import acos

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftloom.llm import arrays
from driftloom.llm.components import components, store

#: Vectors of a label that one pivot stands for.
CELL = 1024
#: Pivots of all labels together: they are sent to every task.
MAX_PIVOTS = 2048
#: Vectors of a cell side compared at once; larger cells are cut into such blocks.
BLOCK = 2048
#: Added to angles, so rounding never loses a replica.
SLACK = 1e-6

UNITS = "vec_id bigint, label int, h1 bigint, h2 bigint, unit binary"


def _units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors at length 1 in double precision; null where no cosine exists."""
    for batch in batches:
        units = []
        for vector in batch.column("embedding").to_pylist():
            unit = None
            if vector and all(x is not None for x in vector):
                x = np.array(vector, np.float64)
                size = np.sqrt((x / np.abs(x).max()) @ (x / np.abs(x).max())) if np.isfinite(x).all() and x.any() else 0
                unit = (x / np.abs(x).max() / size).tobytes() if size else None
            units.append(unit)
        yield pa.record_batch(
            [batch.column(c) for c in ("vec_id", "label", "h1", "h2")] + [pa.array(units, pa.binary())],
            names=["vec_id", "label", "h1", "h2", "unit"],
        )


def _same_size(units: list[bytes]) -> Iterator[np.ndarray]:
    sizes = np.array([len(u) for u in units])
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def _placed(pivots: dict[int, np.ndarray], batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Label, rows and their angles to all pivots of the label; other rows are in the one cell 0 of their label."""
    labels = batch.column("label").to_numpy(zero_copy_only=False)
    units = batch.column("unit").to_pylist()
    for label in np.unique(labels).tolist():
        own = pivots.get(label)
        if own is None:
            continue
        rows = np.array([i for i in np.flatnonzero(labels == label) if len(units[i]) == own.shape[1] * 8], np.int64)
        for lo in range(0, len(rows), BLOCK):
            part = rows[lo:lo + BLOCK]
            yield label, part, np.arccos(np.clip(np.stack([np.frombuffer(units[i]) for i in part]) @ own.T, -1, 1))


def _reach(pivots: dict[int, np.ndarray]):
    """Angle of the farthest vector of each cell, by task."""
    def reach(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = {label: np.full(len(p), -1.0) for label, p in pivots.items()}
        for batch in batches:
            for label, _, angles in _placed(pivots, batch):
                np.maximum.at(far[label], angles.argmin(axis=1), angles.min(axis=1))
        rows = [(label, k, x) for label, own in far.items() for k, x in enumerate(own.tolist()) if x >= 0]
        yield pa.record_batch(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.float64()))],
            names=["label", "cell", "far"],
        )
    return reach


def _copies(least: float, pivots: dict[int, np.ndarray], reach: dict[int, np.ndarray]):
    """Each vector in its home cell, and in lower cells that may hold a partner.

    A partner at angle t lies in cell j only if the vector's angle to pivot j is
    at most its angle to its own pivot plus 2 t, and at most t more than the
    farthest member of cell j: both by the triangle inequality.
    """
    t = acos(least) + SLACK

    def copy(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = np.zeros(batch.num_rows, np.int32)
            take, cells = [np.arange(batch.num_rows)], [home]
            for label, rows, d in _placed(pivots, batch):
                home[rows] = d.argmin(axis=1)
                near = d.min(axis=1)[:, None]
                who, cell = np.nonzero(
                    (d <= near + 2 * t) & (d <= reach[label] + t) & (np.arange(d.shape[1]) < home[rows][:, None])
                )
                take.append(rows[who])
                cells.append(cell.astype(np.int32))
            rows = np.concatenate(take)
            yield pa.record_batch(
                [
                    *(batch.column(c).take(pa.array(rows)) for c in ("rep", "label", "copies", "unit")),
                    pa.array(np.concatenate(cells)), pa.array(np.arange(len(rows)) >= batch.num_rows),
                ],
                names=["rep", "label", "copies", "unit", "cell", "outer"],
            )
    return copy


def _pairs(least: float):
    """Links of a pair of blocks: how many each vector has, and a forest that joins what is linked."""
    def pair(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in arrays.whole_groups(batches, ["label", "cell", "lb", "rb"]):
            rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
            side, units = table.column("side").to_numpy(), table.column("unit").to_pylist()
            node, links, to = [], [], []
            for lo, hi in zip(starts, [*starts[1:], len(rep)]):
                for part in _same_size(units[lo:hi]):
                    rows = lo + part
                    left, right = rows[side[rows] != 1], rows[side[rows] >= 1]
                    same = bool((side[rows] == 2).any())
                    if not len(left) or not len(right):
                        continue
                    x = np.frombuffer(b"".join(units[i] for i in left)).reshape(len(left), -1)
                    y = x if same else np.frombuffer(b"".join(units[i] for i in right)).reshape(len(right), -1)
                    cosine = x @ y.T
                    hit = cosine >= least
                    for i, j in zip(*np.nonzero(np.abs(cosine - least) < 1e-12)):
                        hit[i, j] = float((x[i] * y[j]).sum() / np.sqrt((x[i] ** 2).sum() * (y[j] ** 2).sum())) >= least
                    if same:
                        np.fill_diagonal(hit, False)
                    sets = [(left, hit, copies[right])] + ([] if same else [(right, hit.T, copies[left])])
                    for ids, h, weight in sets:
                        some = np.flatnonzero(h.any(axis=1))
                        node += rep[ids[some]].tolist()
                        links += (h[some] @ weight).tolist()
                        to += [None] * len(some)
                    for a, b in _forest(hit, rep[left], rep[right]):
                        node.append(a)
                        links.append(0)
                        to.append(b)
            yield pa.record_batch(
                [pa.array(node, pa.int64()), pa.array(links, pa.int64()), pa.array(to, pa.int64())],
                names=["rep", "links", "to"],
            )
    return pair


def _forest(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges, fewer than nodes, that connect whatever the matrix of links connects."""
    rows, cols = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    if not len(rows):
        return []
    h = hit[np.ix_(rows, cols)]
    a, b = left[rows].astype(np.int64), right[cols].astype(np.int64)
    big = np.iinfo(np.int64).max
    known_a, known_b = a.copy(), b.copy()
    while True:
        new_b = np.minimum(known_b, np.where(h, known_a[:, None], big).min(axis=0))
        new_a = np.minimum(known_a, np.where(h, new_b[None, :], big).min(axis=1))
        if (new_a == known_a).all() and (new_b == known_b).all():
            break
        known_a, known_b = new_a, new_b
    edges = {(int(x), int(y)) for x, y in [*zip(a, known_a), *zip(b, known_b)] if x != y}
    return sorted(edges)


def near_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label).

    Vectors of one label are linked at a cosine of at least `least`. Equal vectors
    are one class, compared once and counted by number. Pivots, drawn by hash,
    cut each label into cells; the triangle inequality says which vectors a cell
    borrows; cells are joined on their own, large ones in blocks. Every linked
    pair meets in exactly one cell, so the join is exact.

    A vector that is null, empty, zero or holds a null or non-finite component,
    and a row without a label, has no links and is kept. Vectors of different
    lengths are never linked. Links are counted by row: repeated rows, and rows of
    one vec_id, link with each other if their vectors do. In components the rows
    of one vec_id are one node, whatever their vectors and labels; a row without
    vec_id is a node like others, names no component, and is kept. An empty table
    gives no rows. Further columns are ignored.
    """
    raw = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).select(
        "vec_id", "label", "embedding",
        F.xxhash64(F.lit(1), "label", F.col("embedding").cast("string")).alias("h1"),
        F.xxhash64(F.lit(2), "label", F.col("embedding").cast("string")).alias("h2"),
    )
    units = store(raw.mapInArrow(_units, UNITS), "units")
    valid = units.where("unit is not null and label is not null")
    classes = store(
        valid.groupBy("label", "h1", "h2").agg(
            F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("unit").alias("unit")
        ).withColumn("rep", F.monotonically_increasing_id()),
        "classes",
    )
    named = classes.drop("least")
    pivots = _pivots(named)
    inside = named.select("rep", "label", "copies", "unit")
    reach = {label: np.full(len(p), -1.0) for label, p in pivots.items()}
    # One row per pivot at most.
    far = inside.mapInArrow(_reach(pivots), "label int, cell int, far double").groupBy("label", "cell").agg(F.max("far").alias("far"))
    for row in far.collect() if pivots else []:
        reach[row["label"]][row["cell"]] = row["far"]
    dealt = store(
        inside.mapInArrow(_copies(least, pivots, reach), "rep bigint, label int, copies bigint, unit binary, cell int, outer boolean"),
        "dealt",
    )
    found = store(_in_blocks(dealt).mapInArrow(_pairs(least), "rep bigint, links bigint, to bigint"), "found")
    # The classes that one vec_id is in are one node.
    member = valid.select("vec_id", "label", "h1", "h2").where("vec_id is not null")
    several = member.groupBy("vec_id").agg(*[F.count_distinct(c).alias(c) for c in ("label", "h1", "h2")]).where(
        "label > 1 or h1 > 1 or h2 > 1"
    ).select("vec_id")
    same = member.join(several, "vec_id").join(classes.select("label", "h1", "h2", "rep"), ["label", "h1", "h2"])
    ends = same.groupBy("vec_id").agg(F.min("rep").alias("to"))
    edges = found.where("to is not null").select("rep", "to").union(same.join(ends, "vec_id").select("rep", "to"))
    groups = components(edges, "rep", "to")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = store(
        classes.drop("unit").join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("component", F.coalesce("component", "rep")),
        "groups",
    )
    least_id = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    about = joined.join(least_id, "component").select(
        "label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    held = valid.select("vec_id", "label", "h1", "h2").join(about, ["label", "h1", "h2"])
    out = held.select("vec_id", "n_links", "component_id").union(
        units.where("unit is null or label is null").select(
            "vec_id", F.lit(0).cast("bigint"), F.col("vec_id").alias("component_id")
        )
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _pivots(classes: DataFrame) -> dict[int, np.ndarray]:
    """Pivots of the labels that need more than one cell, drawn by hash; MAX_PIVOTS at most."""
    sizes = classes.groupBy("label").count().where(F.col("count") > CELL)
    sizes = sizes.orderBy(F.desc("count"), "label").limit(MAX_PIVOTS // 2).collect()
    wanted = {r["label"]: -(-r["count"] // CELL) for r in sizes}
    total = sum(wanted.values())
    if total > MAX_PIVOTS:
        wanted = {k: max(2, n * MAX_PIVOTS // total) for k, n in wanted.items()}
    if not wanted:
        return {}
    # Of a label's hashes, spread evenly over [0, 1), those below some twice the share wanted are read: a bounded number.
    size = {r["label"]: r["count"] for r in sizes}
    h = F.pmod(F.xxhash64("h1"), F.lit(1 << 30)) / float(1 << 30)
    below = F.lit(0.0)
    for label, n in wanted.items():
        below = F.when(F.col("label") == label, float((2 * n + 64) / size[label])).otherwise(below)
    drawn = classes.where(h < below).select("label", "unit", h.alias("h"), "h1", "h2").collect()
    found: dict[int, list[bytes]] = {}
    for r in sorted(drawn, key=lambda r: (r["h"], r["h1"], r["h2"])):
        own = found.setdefault(r["label"], [])
        if len(own) < wanted[r["label"]] and (not own or len(own[0]) == len(r["unit"])):
            own.append(bytes(r["unit"]))
    return {label: np.stack([np.frombuffer(u) for u in own]) for label, own in found.items()}


def _in_blocks(dealt: DataFrame) -> DataFrame:
    """Rows of (label, cell, left block, right block); side 0 left, 1 right, 2 both.

    Home vectors are left blocks; right blocks are the home blocks from the left
    one on, then the blocks of borrowed vectors.
    """
    counts = dealt.groupBy("label", "cell").agg(
        F.ceil(F.sum((~F.col("outer")).cast("int")) / BLOCK).cast("int").alias("nh"),
        F.ceil(F.sum(F.col("outer").cast("int")) / BLOCK).cast("int").alias("no"),
    )
    rows = dealt.join(counts, ["label", "cell"]).withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.when(F.col("outer"), F.col("no")).otherwise(F.col("nh"))).cast("int")
    )
    home, end = F.col("block"), F.col("nh") + F.col("no")
    as_left = F.transform(
        F.sequence(home, end - 1),
        lambda rb: F.struct(home.alias("lb"), rb.alias("rb"), F.when(rb == home, 2).otherwise(0).alias("side")),
    )
    as_right = F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest("nh", F.lit(1)) - 1), lambda lb: F.col("outer") | (lb < home)),
        lambda lb: F.struct(
            lb.alias("lb"), F.when(F.col("outer"), F.col("nh") + home).otherwise(home).alias("rb"), F.lit(1).alias("side")
        ),
    )
    spread = F.when(F.col("outer"), F.when(F.col("nh") > 0, as_right)).otherwise(F.concat(as_left, as_right))
    return (
        rows.select("label", "cell", "rep", "copies", "unit", F.explode(spread).alias("s"))
        .select("label", "cell", "s.lb", "s.rb", "s.side", "rep", "copies", "unit")
        .repartition("label", "cell", "lb", "rb").sortWithinPartitions("label", "cell", "lb", "rb")
    )
