"""Near-duplicate documents: circulant MinHash, banding and exact Jaccard on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftloom.llm import arrays
from driftloom.llm.components import components, free_shuffles, store

WORDS = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75
#: 40 bands of 5 coordinates: a pair at similarity 0.75 shares no bucket with probability 2e-5.
BANDS, ROWS = 40, 5
#: Coordinates of a signature; the bands take the first, and all estimate a similarity.
COORDINATES = 600
#: Places of the circle that the permutations act on.
CIRCLE = 1 << 20
#: Pairs that agree in fewer coordinates than this share are not compared in
#: full: at similarity 0.75 that is over four standard deviations off, which is
#: as rare as sharing no bucket.
AGREE = 0.675
#: Rounds in which each text is compared with its likeliest partner only.
ROUNDS = 1
#: Members of a bucket compared at once.
BLOCK = 1024
#: Sets of one component that are sent together to be compared in full.
PAIR_BLOCK = 64
#: Ids that every task may hold.
HELD_IDS = 2_000_000

SIGNATURE = "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, sig binary, bands array<bigint>"


@lru_cache(maxsize=1)
def circle(seed: int = 1) -> np.ndarray:
    """Row x holds pi(x), pi(x + 1), …: the coordinates of an item at place x."""
    pi = np.random.default_rng(seed).permutation(CIRCLE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: COORDINATES - 1]]), COORDINATES)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word 5-grams of each text."""
    data, offsets = arrays.utf8(column)
    data = arrays.lower_ascii(data)
    starts, ends, counts = arrays.words(data, offsets)
    hashes = arrays.part_hashes(data, starts, ends)
    n = len(hashes)
    total = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for k in range(WORDS if len(total) else 0):
        total = arrays.mix(total * arrays.ODD + hashes[k:k + len(total)])
    found = []
    for i in range(len(offsets) - 1):
        lo, hi = counts[i], counts[i + 1]
        if hi - lo >= WORDS:
            found.append(np.unique(total[lo:hi - WORDS + 1]))
        elif hi > lo:
            value = np.uint64(hi - lo)
            one = np.array([value])
            for w in hashes[lo:hi]:
                one = arrays.mix(one * arrays.ODD + w)
            found.append(one)
        else:
            found.append(np.empty(0, np.uint64))
    return found


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates from two permutations: the first places an item on the
    circle (hashed), the second is read from there on, shifted by one a coordinate."""
    rows = circle()
    places = (arrays.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(CIRCLE)).astype(np.int64)
    least = rows[places[:2048]].min(axis=0)
    for k in range(2048, len(places), 2048):
        np.minimum(least, rows[places[k:k + 2048]].min(axis=0), out=least)
    return least


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    band = arrays.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for part in arrays.slices(batches, "text"):
        sets = shingle_sets(part.column("text"))
        k1, k2, sigs, bands = [], [], [], []
        full = [i for i, s in enumerate(sets) if len(s)]
        rows = np.array([signature(sets[i]) for i in full], np.uint32).reshape(len(full), COORDINATES)
        keys = np.zeros((len(full), BANDS), np.uint64) + band
        for k in range(ROWS):
            keys = arrays.mix(keys * arrays.ODD + rows[:, k:BANDS * ROWS:ROWS].astype(np.uint64))
        at = {i: k for k, i in enumerate(full)}
        low, keys = rows.astype(np.uint8), arrays.signed(keys)
        for i, s in enumerate(sets):
            k1.append(int(arrays.mix(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)))
            k2.append(int(arrays.mix(s ^ arrays.ODD).sum(dtype=np.uint64).view(np.int64)))
            sigs.append(low[at[i]].tobytes() if len(s) else None)
            bands.append(keys[at[i]] if len(s) else [])
        yield pa.record_batch(
            [
                part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sigs, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
            ],
            names=["doc_id", "n_shingles", "k1", "k2", "sig", "bands"],
        )


def confirmed(docs: DataFrame, pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are alike enough.

    Texts of one group (node, component) stand in blocks of PAIR_BLOCK, others
    alone, and the pairs between two blocks are compared together: a text is sent
    once for each block it has a partner in, not once for each partner, and read
    into its set where it is compared. Only texts that stand in a pair are sent.
    """
    ends = store(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    label = F.coalesce("component", "doc_id").alias("label")
    named = ends.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", label)
    sizes = named.groupBy("label").agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("bigint").alias("n"))
    part = F.pmod(F.xxhash64("doc_id"), F.col("n"))
    blocks = store(named.join(sizes, "label").select("doc_id", F.xxhash64("label", part).alias("block")), "blocks")
    left, right = (blocks.select(F.col("doc_id").alias(c), F.col("block").alias(f"b{c}")) for c in "ab")
    placed = store(pairs.select("a", "b").join(left, "a").join(right, "b"), "placed")
    held = placed.select("ba", "bb", F.col("a").alias("doc_id")).union(placed.select("ba", "bb", F.col("b").alias("doc_id")))
    held = store(held.distinct(), "sent")
    free_shuffles(docs.sparkSession)
    rows = held.join(among(docs.select("doc_id", "text"), ends), "doc_id").select(
        "ba", "bb", "doc_id", F.lit(None).cast("bigint").alias("b"), "text"
    ).union(placed.select("ba", "bb", F.col("a").alias("doc_id"), "b", F.lit(None).cast("string")))
    return rows.repartition("ba", "bb").sortWithinPartitions("ba", "bb").mapInArrow(_compare, "a bigint, b bigint")


def among(table: DataFrame, ids: DataFrame) -> DataFrame:
    """`table` without rows that a join by doc_id with the written, distinct `ids` leaves out.

    Tasks leave them out before anything is shuffled, where they can hold the ids;
    with more of those all rows stay, and the join itself decides.
    """
    return table.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= HELD_IDS else table


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the pairs between two blocks those alike enough; several texts of one id are each compared."""
    for table, starts in arrays.whole_groups(batches, ["ba", "bb"]):
        ids, other = table.column("doc_id").to_pylist(), table.column("b").to_pylist()
        texts = table.select(["text"])
        a, b = [], []
        for lo, hi in zip(starts, [*starts[1:], len(ids)]):
            sets: dict[int, list[np.ndarray]] = {}
            k = int(lo)
            for part in arrays.slices(texts.slice(k, int(hi) - k).to_batches(), "text"):
                for found in shingle_sets(part.column("text")):
                    if other[k] is None:
                        sets.setdefault(ids[k], []).append(found)
                    k += 1
            for k in range(lo, hi):
                if other[k] is not None and any(_alike(x, y) for x in sets.get(ids[k], ()) for y in sets.get(other[k], ())):
                    a.append(ids[k])
                    b.append(other[k])
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are linked."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < PERCENT * len(y):
        return False
    place = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = int((y[place] == x).sum())
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def _crossing(best: bool):
    """Pairs of a block of a bucket that are in different components and agree
    enough; with `best` only each text's most agreeing partner in the block.

    A pair counts in the first band whose bucket it shares, and in no later one;
    the buckets' own keys decide that, as bytes of a signature may be equal by chance.
    """
    def cross(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in arrays.whole_groups(batches, ["bucket", "i", "j"]):
            doc, label = (table.column(c).to_numpy() for c in ("doc_id", "label"))
            block, i_, j_ = (table.column(c).to_numpy() for c in ("block", "i", "j"))
            before = table.column("before").combine_chunks()
            before, cuts = before.flatten().to_numpy(), np.append(0, np.cumsum(before.value_lengths().to_numpy()))
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            a, b, agree = [], [], []
            for lo, hi in zip(starts, [*starts[1:], len(doc)]):
                i, j = i_[lo], j_[lo]
                # All members of a bucket have as many earlier bands.
                met = before[cuts[lo]:cuts[hi]].reshape(hi - lo, -1)
                rows = np.arange(lo, hi)
                left = rows if i == j else rows[block[lo:hi] == i]
                right = rows if i == j else rows[block[lo:hi] == j]
                for k in left:
                    other = right[label[right] != label[k]]
                    if i == j and not best:
                        other = other[doc[other] > doc[k]]
                    if not len(other):
                        continue
                    other = other[~(met[other - lo] == met[k - lo]).any(axis=1)]
                    if not len(other):
                        continue
                    share = (sig[other] == sig[k]).mean(axis=1)
                    keep = share >= AGREE
                    if best:
                        keep &= np.arange(len(other)) == share.argmax()
                    a += [int(doc[k])] * int(keep.sum())
                    b += doc[other[keep]].tolist()
                    agree += share[keep].tolist()
            yield pa.record_batch(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(agree, pa.float64())], names=["a", "b", "agree"]
            )
    return cross


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs` (doc_id, text).

    Texts with equal shingle sets form one class and are looked at once. First
    every class is compared with the hub it meets in most buckets; a bucket's hub
    is the member whose buckets are fullest, in a group of copies the text the
    others are copied from. Links confirmed on full sets give components. Then,
    in buckets that still hold several components, each text is compared with the
    likeliest of another component, ROUNDS times, and at last with all of them,
    in blocks. So no pair that shares a bucket is skipped unless it is already
    connected or its signatures rule it out, and most of a group of copies costs
    one comparison a member.

    A null or empty text, or white space only, has no shingles and is linked
    with nothing. Rows with the same doc_id are one node, whatever their texts, so
    they have one component. Copies of a text without any doc_id have a null
    component and are kept. An empty table gives no rows. Further columns of
    `docs` are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    feats = store(docs.mapInArrow(_signatures, SIGNATURE), "signatures")
    full = feats.where("n_shingles > 0")
    classes = full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")).where("rep is not null")

    def reps(rows: DataFrame) -> DataFrame:
        return rows.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "k1", "k2"], "left_semi")

    items = reps(full).select("doc_id", F.posexplode("bands").alias("band", "bucket"))
    full_ = items.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    met = store(items.join(full_, "bucket"), "buckets")
    score = met.groupBy("doc_id").agg(F.sum("m").alias("score"))
    rated = met.join(score, "doc_id").select("doc_id", "bucket", F.struct("score", (-F.col("doc_id")).alias("id")).alias("rate"))
    hubs = rated.groupBy("bucket").agg((-F.max("rate")["id"]).alias("hub"))
    often = met.join(hubs, "bucket").where("doc_id != hub").groupBy("doc_id", "hub").count()
    first = often.groupBy(F.col("doc_id").alias("b")).agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("a"))
    first = store(first, "hubs")
    free_shuffles(docs.sparkSession)
    # A doc_id that stands in several classes is one node with all of them.
    several = full.where("doc_id is not null").groupBy("doc_id").agg(F.count_distinct("k1", "k2").alias("n")).where("n > 1")
    own = full.join(several.select("doc_id"), "doc_id").join(classes, ["k1", "k2"])
    own = own.where("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    ends = store(first.select(F.col("a").alias("doc_id")).union(first.select("b")).distinct(), "ids")
    pairs = store(agreeing(first.select("a", "b"), reps(among(full, ends))), "pairs")
    # A hub is sent once for each block of texts that are compared with it.
    links = confirmed(docs, pairs, first.select(F.col("b").alias("node"), F.col("a").alias("component")))
    links = store(links.union(own), "links")
    every = store(components(links), "groups")
    for turn in range(ROUNDS + 1):
        best = turn < ROUNDS
        free_shuffles(docs.sparkSession)
        labelled = met.join(every.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
            "doc_id", "band", "bucket", "m", F.coalesce("component", "doc_id").alias("label")
        )
        ends = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
        open_ = store(labelled.join(ends.select("bucket"), "bucket"), "open")
        members = store(open_.select("doc_id").distinct(), "ids")
        across = _blocks(open_, reps(among(full, members))).mapInArrow(_crossing(best), "a bigint, b bigint, agree double")
        if best:
            across = across.union(across.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree"))
            across = across.groupBy("a").agg(F.max_by("b", F.struct("agree", -F.col("b"))).alias("b"))
        pairs = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = store(links.union(confirmed(docs, store(pairs, "across"), every)), "links")
        every = store(components(links), "groups")
    named = classes.join(every, F.col("rep") == F.col("node"), "left").select(
        "k1", "k2", F.coalesce("component", "rep").alias("component_id")
    )
    # Equal sets may be a third of all rows: Spark splits this join by size.
    held = feats.select("doc_id", "n_shingles", "k1", "k2").where("n_shingles > 0").join(named, ["k1", "k2"], "left")
    out = held.select("doc_id", "n_shingles", "component_id").union(
        feats.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def agreeing(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs whose signatures agree in at least a share AGREE of their bytes."""
    left = reps.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa"))
    right = reps.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb"))
    joined = pairs.join(left, "a").join(right, "b")
    same = F.aggregate(
        F.sequence(F.lit(0), F.lit(COORDINATES - 1)), F.lit(0),
        lambda n, k: n + (F.substring("sa", k + 1, F.lit(1)) == F.substring("sb", k + 1, F.lit(1))).cast("int"),
    )
    return joined.where(same >= AGREE * COORDINATES).select("a", "b")


def _blocks(members: DataFrame, reps: DataFrame) -> DataFrame:
    """Each member of a bucket once for every pair of blocks that holds its block."""
    n = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = members.withColumn("n", n).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("n")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.join(reps.select("doc_id", "sig", "bands"), "doc_id").select(
        "bucket", "doc_id", "label", "block", "sig", F.slice("bands", F.lit(1), F.col("band")).alias("before"),
        F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
    )
    return dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
