"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions trained in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftloom.llm import arrays
from driftloom.llm.components import store

KINDS = ("email", "ip", "card", "phone")
#: Outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
WINDOW, OVERLAP = 64, 32
#: Characters around a digit or an @ that windows cover.
MARGIN = 16
HIDDEN, WIDTH = 16, 10
#: Documents whose labelled spans a model is fitted on, and windows of either sort, at most.
SAMPLE_ROWS, SAMPLE_WINDOWS = 3000, 3000
STEPS, BATCH = 600, 64
#: Windows decoded at once.
AT_ONCE = 1024

# -- labelled spans: the patterns are fixed by the contract of the query --------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match begins where a run of digits does, and takes the whole run.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SOME = re.compile("[0-9@]")
#: What a span that the network adds may look like, by kind.
_SHAPES = tuple(map(re.compile, (
    r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+){3}", r"[0-9]([\x20.-]?[0-9])+",
    r"[+(]?[0-9][\x20().0-9-]+[0-9]",
)))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def holds(kind: str, text: str) -> bool:
    """Whether a match of a kind passes that kind's test."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in text.split("."))
    if kind == "card":
        digits = only_digits(text)
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(only_digits(text)) <= 15
    return True


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, found from each @: in long runs of letters it does not search from every letter."""
    reached, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > reached and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            reached = domain.end()
        at = text.find("@", max(at + 1, reached))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the fixed patterns, sorted."""
    if not _SOME.search(text):
        return []
    found = [(a, 0, z) for a, z in emails(text)]
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if holds(KINDS[kind], m[0])]
    return sorted(found)


# -- windows -------------------------------------------------------------------

#: Characters with a class of their own; letters are by case, digits are one class.
_OWN = "@.-_+()%: ,/[]#\n"
CLASSES = 5 + len(_OWN)


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.ones(len(points), np.uint8)
    out[(points >= 48) & (points <= 57)] = 2
    out[(points >= 97) & (points <= 122)] = 3
    out[(points >= 65) & (points <= 90)] = 4
    for k, c in enumerate(_OWN):
        out[points == ord(c)] = 5 + k
    return out


def windows(codes: np.ndarray) -> np.ndarray:
    """Starts of windows that cover every digit and @ with MARGIN on both sides.

    Where there is neither, there is no span of any kind, so no window.
    """
    marks = np.flatnonzero((codes == 2) | (codes == 5))
    if not len(marks):
        return np.empty(0, np.int64)
    gap = np.flatnonzero(np.diff(marks) > 2 * MARGIN + 2)
    first = np.maximum(0, marks[np.append(0, gap + 1)] - MARGIN)
    last = np.minimum(len(codes), marks[np.append(gap, len(marks) - 1)] + MARGIN + 1)
    step = WINDOW - OVERLAP
    return np.concatenate([np.arange(a, max(a + 1, z - OVERLAP), step) for a, z in zip(first, last)])


def cut(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.append(codes, np.zeros(WINDOW, codes.dtype))
    return padded[starts[:, None] + np.arange(WINDOW)]


def tags(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Tag of every character; where spans overlap the earlier one counts."""
    out, reached = np.zeros(length, np.uint8), 0
    for a, kind, z in spans:
        if a >= reached:
            out[a:z] = 2 + 2 * kind
            out[a] = 1 + 2 * kind
            reached = z
    return out


# -- the network ---------------------------------------------------------------


@dataclass
class Model:
    embedding: np.ndarray
    #: For each direction: input weights, state weights, bias; gates are in, forget, out, new.
    wx: list[np.ndarray]
    wh: list[np.ndarray]
    b: list[np.ndarray]
    out: np.ndarray
    out_b: np.ndarray
    #: transition[i, j]: score of tag j behind tag i.
    transition: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.wx, *self.wh, *self.b, self.out, self.out_b, self.transition]


def new_model(seed: int = 0) -> Model:
    rng = np.random.default_rng(seed)

    def weights(*shape: int) -> np.ndarray:
        return (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)

    bias = np.zeros(4 * HIDDEN, np.float32)
    bias[HIDDEN:2 * HIDDEN] = 1
    return Model(
        rng.normal(0, 0.5, (CLASSES, WIDTH)).astype(np.float32), [weights(WIDTH, 4 * HIDDEN) for _ in range(2)],
        [weights(HIDDEN, 4 * HIDDEN) for _ in range(2)], [bias.copy(), bias.copy()], weights(2 * HIDDEN, TAGS),
        np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32),
    )


def _run(model: Model, x: np.ndarray, way: int, keep: list | None = None) -> np.ndarray:
    """Hidden states (time, row, HIDDEN) of one direction over classes (row, time)."""
    n, steps = x.shape
    table = model.embedding @ model.wx[way] + model.b[way]
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out = np.empty((steps, n, HIDDEN), np.float32)
    for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
        z = table[x[:, t]] + h @ model.wh[way]
        gates = 1 / (1 + np.exp(-z[:, :3 * HIDDEN]))
        new = np.tanh(z[:, 3 * HIDDEN:])
        before, c_before = h, c
        c = gates[:, HIDDEN:2 * HIDDEN] * c + gates[:, :HIDDEN] * new
        squashed = np.tanh(c)
        h = gates[:, 2 * HIDDEN:] * squashed
        out[t] = h
        if keep is not None:
            keep.append((t, gates, new, before, c_before, squashed))
    return out


def emissions(model: Model, x: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Tag scores (time, row, TAGS) and the states they come from."""
    parts = []
    for way in (0, 1):
        steps: list | None = None if keep is None else []
        parts.append(_run(model, x, way, steps))
        if keep is not None:
            keep.append(steps)
    states = np.concatenate(parts, axis=2)
    return states @ model.out + model.out_b, states


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def gradients(model: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood of the tag paths `y`, and its gradients."""
    keep: list = []
    score, states = emissions(model, x, keep)
    steps, n, _ = score.shape
    trans = model.transition
    alpha, beta = np.empty_like(score), np.zeros_like(score)
    alpha[0] = score[0]
    for t in range(1, steps):
        alpha[t] = _lse(alpha[t - 1][:, :, None] + trans, 1) + score[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _lse(trans + (beta[t + 1] + score[t + 1])[:, None, :], 2)
    total = _lse(alpha[-1], 1)
    d_score = np.exp(alpha + beta - total[:, None])
    d_trans = np.zeros_like(trans)
    for t in range(1, steps):
        d_trans += np.exp(
            alpha[t - 1][:, :, None] + trans + (score[t] + beta[t] - total[:, None])[:, None, :]
        ).sum(axis=0)
        np.add.at(d_trans, (y[:, t - 1], y[:, t]), -1)
    at = np.arange(n)
    gold = sum(score[t, at, y[:, t]] for t in range(steps)) + sum(trans[y[:, t - 1], y[:, t]] for t in range(1, steps))
    for t in range(steps):
        d_score[t, at, y[:, t]] -= 1
    d_score /= n
    d_states = d_score @ model.out.T
    d_out = np.tensordot(states, d_score, ([0, 1], [0, 1]))
    d_emb = np.zeros_like(model.embedding)
    d_wx, d_wh, d_b = [], [], []
    for way in (0, 1):
        gx = np.zeros((CLASSES, 4 * HIDDEN), np.float32)
        gh = np.zeros_like(model.wh[way])
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        for t, gates, new, before, c_before, squashed in reversed(keep[way]):
            dh = dh + d_states[t][:, way * HIDDEN:(way + 1) * HIDDEN]
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
            dc = dc + dh * o * (1 - squashed**2)
            dz = np.concatenate([
                dc * new * i * (1 - i), dc * c_before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new**2)
            ], axis=1)
            gh += before.T @ dz
            gx += np.eye(CLASSES, dtype=np.float32)[x[:, t]].T @ dz
            dh, dc = dz @ model.wh[way].T, dc * f
        d_emb += gx @ model.wx[way].T
        d_wx.append(model.embedding.T @ gx)
        d_wh.append(gh)
        d_b.append(gx.sum(axis=0))
    grads = [d_emb, *d_wx, *d_wh, *d_b, d_out, d_score.sum(axis=(0, 1)), d_trans / n]
    return float((total - gold).mean()), grads


def train(x: np.ndarray, y: np.ndarray, seed: int = 0, steps: int = STEPS) -> Model:
    """Fit by Adam on windows of classes and tags; without windows the model says outside."""
    model = new_model(seed)
    if not len(x):
        model.out[:], model.out_b[0] = 0, 10
        return model
    rng, params = np.random.default_rng(seed), model.parameters()
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        rows = rng.choice(len(x), min(BATCH, len(x)), replace=False)
        _, grads = gradients(model, x[rows], y[rows])
        rate = 0.03 * 0.5 * (1 + np.cos(np.pi * step / (steps + 1))) * min(1, step / 20)
        for p, g, (m, v) in zip(params, grads, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= np.float32(rate) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def decode(model: Model, x: np.ndarray) -> np.ndarray:
    """The best tag path (row, time) of each window."""
    out = np.empty(x.shape, np.uint8)
    for lo in range(0, len(x), AT_ONCE):
        part = x[lo:lo + AT_ONCE]
        score, _ = emissions(model, part)
        steps, n, _ = score.shape
        best, back = score[0], np.empty((steps, n, TAGS), np.uint8)
        for t in range(1, steps):
            every = best[:, :, None] + model.transition
            back[t] = every.argmax(axis=1)
            best = every.max(axis=1) + score[t]
        tag = best.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            out[lo:lo + len(part), t] = tag
            if t:
                tag = back[t, np.arange(n), tag]
    return out


# -- spans of texts ------------------------------------------------------------


def reconciled(length: int, starts: np.ndarray, paths: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans of a text from its windows' tags.

    Each character takes the tag of the window in which it is farthest from an
    edge; spans are then read off the whole text, so one may cross windows.
    """
    best, tag = np.full(length, -1), np.zeros(length, np.uint8)
    depth = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
    for a, path in zip(starts, paths):
        z = min(length, a + WINDOW)
        # The ends of a text are no edges.
        own = depth[: z - a].copy()
        if a == 0:
            own = np.maximum(own, np.arange(WINDOW)[::-1][: z - a])
        if z == length:
            own = np.maximum(own, np.arange(z - a))
        better = own > best[a:z]
        best[a:z][better] = own[better]
        tag[a:z][better] = path[: z - a][better]
    found = []
    for at in np.flatnonzero(tag % 2 == 1):
        kind, z = (int(tag[at]) - 1) // 2, int(at) + 1
        while z < length and tag[z] == 2 + 2 * kind:
            z += 1
        found.append((int(at), kind, z))
    return found


def all_spans(model: Model, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, spans the model adds) of each text.

    An added span has a shape of its kind, passes its test and overlaps no base span.
    """
    codes = [classes(t) for t in texts]
    starts = [windows(c) for c in codes]
    cuts = [cut(c, s) for c, s in zip(codes, starts) if len(s)]
    paths = decode(model, np.concatenate(cuts)) if cuts else None
    at, out = 0, []
    for text, s in zip(texts, starts):
        base = base_spans(text)
        added = []
        if len(s):
            for a, kind, z in reconciled(len(text), s, paths[at:at + len(s)]):
                z = a + len(text[a:z].rstrip(" .-"))
                if _SHAPES[kind].fullmatch(text, a, z) and holds(KINDS[kind], text[a:z]):
                    if not any(a < y and x < z for x, _, y in base):
                        added.append((a, kind, z))
            at += len(s)
        out.append((base, added))
    return out


def varied(text: str, spans: list[tuple[int, int, int]], rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with some labelled spans written another way: phones without their
    + and with other separators, emails with spaces around the @."""
    out, moved, at, size = [], [], 0, 0
    for a, kind, z in spans:
        if a < at:
            continue
        part = text[a:z]
        if kind == 3 and rng.random() < 0.5:
            part = part.removeprefix("+").replace(" ", rng.choice([" ", "-", "."]))
        elif kind == 0 and rng.random() < 0.3:
            part = part.replace("@", " @ ")
        out += [text[at:a], part]
        size += a - at
        moved.append((size, kind, size + len(part)))
        size += len(part)
        at = z
    return "".join([*out, text[at:]]), moved


def _labelled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in arrays.slices(batches, "text"):
        rows = []
        for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
            spans = base_spans(text)
            rng = np.random.default_rng(abs(doc_id))
            for version in (0, 1):
                own, found = (text, spans) if version == 0 else varied(text, spans, rng)
                if version and not spans:
                    continue
                codes = classes(own)
                starts = windows(codes)
                if len(starts):
                    labels = cut(tags(len(own), found), starts)
                    for k, (x, y) in enumerate(zip(cut(codes, starts), labels)):
                        rows.append((doc_id, 2 * k + version, bool(y.any()), x.tobytes(), y.tobytes()))
        columns = list(zip(*rows)) or [()] * 5
        yield pa.record_batch(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()))],
            names=["doc_id", "place", "some", "x", "y"],
        )


def fit(docs: DataFrame) -> Model:
    """Train on windows of the fixed patterns' spans in a bounded sample of documents.

    SAMPLE_ROWS documents with a digit or an @ are drawn by hash, and of their
    windows SAMPLE_WINDOWS with and as many without a span. Of rows with one
    doc_id the first text in order counts; rows without a doc_id or text are not drawn.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    usable = docs.where(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull())
    chosen = usable.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS).distinct()
    # SAMPLE_ROWS numbers at most are broadcast.
    rows = usable.join(F.broadcast(store(chosen, "sample")), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    cuts = store(rows.mapInArrow(_labelled, "doc_id bigint, place bigint, some boolean, x binary, y binary"), "windows")
    order = [F.xxhash64("doc_id", "place"), "doc_id", "place", "x"]
    drawn = [
        r for some in (True, False) for r in cuts.where(F.col("some") == some).orderBy(*order).limit(SAMPLE_WINDOWS).collect()
    ]
    x, y = (
        np.frombuffer(b"".join(bytes(r[c]) for r in drawn), np.uint8).reshape(-1, WINDOW) for c in ("x", "y")
    )
    return train(x, y)


SPANS = "doc_id bigint, base array<struct<start:bigint,at:int,end:bigint>>, added array<struct<start:bigint,at:int,end:bigint>>"


def find(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, base, added): spans of every row of docs (doc_id, text), sorted by start.

    `at` numbers the kind in KINDS; places are code points, ends exclusive. A null
    or empty text has no spans. Repeated rows give repeated results, a null doc_id
    is kept. Further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("at", pa.int32()), ("end", pa.int64())]))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, "text", arrays.BLOCK // 2):
            found = all_spans(shared.value, [t or "" for t in part.column("text").to_pylist()])
            columns = [
                pa.array([[{"start": a, "at": k, "end": z} for a, k, z in spans[i]] for spans in found], kind) for i in (0, 1)
            ]
            yield pa.record_batch([part.column("doc_id"), *columns], names=["doc_id", "base", "added"])

    taken = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return taken.mapInArrow(search, SPANS)


def joined(spans):
    """kind:start:end of every span by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["at"]), s["start"], s["end"])), ","
    )


def scan_documents(docs: DataFrame) -> DataFrame:
    """Counts and digest of the fixed patterns' spans of every document, and all spans."""
    found = find(docs, fit(docs))

    def count(k: int):
        return F.size(F.filter("base", lambda s: s["at"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")

    return found.select(
        "doc_id", *[count(k) for k in range(len(KINDS))], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
    )
