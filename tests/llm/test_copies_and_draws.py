"""Exact copies, fill-in-middle and importance resampling against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from driftloom.llm import exact_dedup, fill_middle, resampling

FOLDER = "/root/testdata/sf0.001"
LONG = "ßtrange wörds of a very long text " * 40_000
SCHEMA = "doc_id long, text string, run string, best string, output string, rank string"


def table(spark, rows, parts=1):
    return spark.createDataFrame([(i, t, *["x"] * 4) for i, t in rows], SCHEMA).repartition(parts)


# -- exact copies -------------------------------------------------------------


def exact(rows):
    """doc_id -> (keep_id, group_size) of rows with distinct ids."""
    held = defaultdict(list)
    for i, t in rows:
        held[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i))
    return {i: (min(g)[1], len(g)) for g in held.values() for _, i in g}


@pytest.mark.parametrize("parts", [1, 2, 11])
def test_exact_groups_equal_brute_force(spark, parts):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000 + k, " one  text\n" + " " * (k % 3)) for k in range(60)] + [(20_000, None), (20_001, "\t"), (20_002, LONG)]
    found = exact_dedup.exact_groups(table(spark, rows, parts)).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in found} == exact(rows)
    assert len(found) == len(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found)
    texts = {i: re.sub("[\x20\x09-\x0d]", "", t or "") for i, t in rows}
    assert all(r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in found)


def test_only_ascii_white_space_is_left_out(spark):
    rows = [(1, "a b"), (2, "ab"), (3, "a\x0b\x0cb"), (4, "a\x1fb"), (5, "A B")]
    found = {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(table(spark, rows)).collect()}
    assert found == {1: 1, 2: 3, 3: 3, 4: 4, 5: 5}


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    rows = [(7, "same"), (7, "same"), (7, "same "), (7, "same "), (None, "alone"), (None, "alone"), (3, "tie"), (None, "tie")]
    found = exact_dedup.exact_groups(table(spark, rows, 3)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found) == Counter({
        (7, 7, 4, True): 1, (7, 7, 4, False): 3, (None, None, 2, True): 1, (None, None, 2, False): 1,
        (3, 3, 2, True): 1, (None, 3, 2, False): 1,
    })
    assert exact_dedup.exact_groups(table(spark, [])).count() == 0


def test_texts_are_compared_whole(spark):
    rows = spark.createDataFrame([(k, b"d", t) for k, t in enumerate("aabaa")], "run int, digest binary, text string")
    assert exact_dedup.distinct_texts(rows, 2, 5).count() == 2


def test_two_texts_of_one_digest_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: exact_dedup.F.lit("ab"))
    with pytest.raises(ValueError, match="digest"):
        exact_dedup.exact_groups(table(spark, [(1, "a"), (2, "b")], 2))


# -- fill-in-middle -----------------------------------------------------------


def formed(doc_id, text):
    text, n = text or "", len(text or "")
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in fill_middle.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_plain_version_and_comes_back(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    rows += [
        (None, "no id"), (None, None), (-5, None), (-6, ""), (-7, "a <S> in it"), (-8, "<P"), (-9, "<"), (-10, "é"),
        (-11, "👩‍👩‍👧 joined é"), (-12, LONG), (-13, "twice"), (-13, "twice"), (-14, "<X><p><<P><M"),
    ] + [(-100 - k, "<ü>" * (k % 5) + "M>") for k in range(100)]
    out = fill_middle.restore(fill_middle.transform(table(spark, rows, 3)))
    assert set(out.columns) == set(SCHEMA.replace(",", "").split()[::2]) | {f.name for f in fill_middle.FORMED} | {"restored"}
    found = [((r.doc_id, r.text), (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in out.collect()]
    assert Counter(found) == Counter(((i, t), formed(i, t)) for i, t in rows)
    assert out.where("restored != coalesce(text, '')").count() == 0
    assert {f for _, (_, f, *_) in found} == {"plain", "psm", "spm"}
    assert fill_middle.restore(fill_middle.transform(table(spark, []))).count() == 0


@settings(deadline=None, max_examples=150)
@given(st.lists(st.tuples(st.text("<PSM>aé😀", max_size=12), st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4)), min_size=1, max_size=8))
def test_any_batch_comes_back(rows):
    data = np.frombuffer("".join(t for t, _ in rows).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t, _ in rows])
    n, plain, swapped, p, m, out, ends = fill_middle.form(data, offsets, np.array([h for _, h in rows], np.int64))
    assert n.tolist() == [len(t) for t, _ in rows]
    for i, (t, _) in enumerate(rows):
        a, b = t[:p[i]], t[p[i]:p[i] + m[i]]
        c = t[p[i] + m[i]:]
        want = t if plain[i] else f"<S>{c}<P>{a}<M>{b}" if swapped[i] else f"<P>{a}<S>{c}<M>{b}"
        assert out[ends[i]:ends[i + 1]].tobytes().decode() == want
    back, cuts = fill_middle.unform(out, ends, plain)
    assert back.tobytes() == data.tobytes() and (cuts == offsets).all()


def test_an_output_without_its_marks_is_an_error():
    data = np.frombuffer(b"<P>a<S>b", np.uint8)
    with pytest.raises(ValueError, match="mark"):
        fill_middle.unform(data, np.array([0, 8]), np.array([False]))


# -- importance resampling ----------------------------------------------------


def resampled(rows, target, words=1, buckets=10_000, percent=10, least=20):
    def grams(text):
        found = re.findall("[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(found), [" ".join(found[i:i + k]) for k in range(1, words + 1) for i in range(len(found) - k + 1)]

    def bucket(x):
        return zlib.crc32(x.encode()) % buckets

    s, t = (Counter(bucket(g) for x in texts for g in grams(x)[1]) for texts in ([x for _, x in rows], target))
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in range(buckets)]
    found = []
    for i, text in rows:
        n, own = grams(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in own)
        found.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in found if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[:len(able) * percent // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in found)


@pytest.mark.parametrize("words, percent", [(1, 10), (3, 60)])
def test_resampling_equals_plain_version(spark, words, percent):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [
        (None, "no id " * 15), (-1, None), (-2, ""), (-3, "-- ,, "), (-4, LONG), (-5, "x" * 30_000 + " y"), (-6, "tie " * 20),
        (-6, "tie " * 20), (-7, "Ä ä É 中文字 naïve ＡＢ x [A@Z`a{z/0:9]"), (-8, "a" * 20), (-9, "b " * 19), (-10, "c " * 20),
    ]
    target = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()] + [None]
    texts = spark.createDataFrame([(t,) for t in target], "text string")
    found = resampling.resample(table(spark, rows, 3), texts, percent=percent, words=words)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in found.collect()) == resampled(rows, target, words, percent=percent)


def test_resampling_of_empty_tables(spark):
    empty = table(spark, [])
    assert resampling.resample(empty, empty).count() == 0
    rows = [(k, f"word{k} " * 25) for k in range(30)]
    found = resampling.resample(table(spark, rows, 2), empty)
    assert Counter(tuple(r) for r in found.collect()) == resampled(rows, [])


@settings(deadline=None, max_examples=50)
@given(st.lists(st.binary(max_size=20), min_size=1, max_size=30))
def test_sums_equal_the_library(parts):
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    found = resampling.crc32(data, ends - [len(p) for p in parts], ends)
    assert found.tolist() == [zlib.crc32(p) for p in parts]


def test_features_do_not_cross_texts():
    bucket, who, n = resampling.features(pa.array(["one two", None, "Two-three 4"]), 2, 1 << 20)
    want = ["one", "two", "two", "three", "4", "one two", "two three", "three 4"]
    assert bucket.tolist() == [zlib.crc32(w.encode()) % (1 << 20) for w in want]
    assert who.tolist() == [0, 0, 2, 2, 2, 0, 2, 2] and n.tolist() == [2, 0, 3]
