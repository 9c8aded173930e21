"""SentencePiece encoding and decoding: pieces are matched by a suffix array over a batch's words."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from driftloom.llm import arrays
from driftloom.llm.words import WordIds

#: Bytes of text whose new words are indexed together.
BLOCK = 4 << 20
#: A longer word is relaxed by a queue, not in rounds with the others.
LONG = 48
#: Bytes of words and ids that a worker remembers.
REMEMBERED = 128 << 20
#: Bits of an edge's key that hold its length.
LENGTH_BITS = 8


class Pieces:
    """The vocabulary of a BPE model: pieces by text, bytes by value, texts by id."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.model = SentencePieceProcessor(model_file=path)
        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        if spec.trainer_spec.model_type != proto.TrainerSpec.BPE:
            raise ValueError("a BPE model is needed")
        m, n = self.model, self.model.vocab_size()
        texts = [m.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int32)
        plain, raw = [], []
        for i, text in enumerate(texts):
            if m.is_byte(i):
                self.byte_ids[int(text[1:-1], 16)] = i
                raw.append(bytes([int(text[1:-1], 16)]))
            elif m.is_control(i):
                raw.append(b"")
            elif m.is_unknown(i):
                raw.append(" ⁇ ".encode())
            else:
                plain.append(i)
                raw.append(text.replace("▁", " ").encode())
        self.ids = np.array(plain, np.int32)
        self.scores = np.array([m.get_score(i) for i in plain])
        self.lengths = np.array([len(texts[i]) for i in plain])
        self.longest = int(self.lengths.max())
        # Code points of each piece, 0 behind its end.
        self.codes = np.zeros((len(plain), self.longest), np.uint32)
        for k, i in enumerate(plain):
            self.codes[k, : self.lengths[k]] = [ord(c) for c in texts[i]]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_ends = np.cumsum([len(r) for r in raw])
        # No piece goes on from another character to the word mark, so words end before it; some characters
        # are part of no longer piece and stand alone.
        if any(a != "▁" and b == "▁" for i in plain for a, b in zip(texts[i], texts[i][1:])):
            raise ValueError("pieces cross words")
        alone = "".join(c for c in "\0\n\t" if not any(c in texts[i] and len(texts[i]) > 1 for i in plain))
        self.words = re.compile(f"[{alone}]|▁*[^▁{alone}]+|▁+" if alone else "▁*[^▁]+|▁+")

    # -- the index of a batch --------------------------------------------------

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, piece) of all occurrences of pieces in `codes`, sorted by position, then length.

        The suffixes are sorted as far as the longest piece; each piece's
        occurrences are a range of them, found by two binary searches that run
        for all pieces at once.
        """
        order = suffix_array(codes, self.longest)
        padded = np.append(codes, np.zeros(self.longest, codes.dtype))
        low, high = self._bound(order, padded, False), self._bound(order, padded, True)
        sizes = high - low
        piece = np.repeat(np.arange(len(sizes)), sizes)
        at = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        keys = (order[at] << LENGTH_BITS) + self.lengths[piece]
        by_place = np.argsort(keys, kind="stable")
        return keys[by_place], piece[by_place]

    def _bound(self, order: np.ndarray, padded: np.ndarray, above: bool) -> np.ndarray:
        """For each piece the first suffix that is not below it, or that is above all that begin with it."""
        n = len(self.codes)
        low, high = np.zeros(n, np.int64), np.full(n, len(order), np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) // 2
            start = order[middle]
            less = np.zeros(len(open_), bool)
            live = np.arange(len(open_))
            for k in range(self.longest):
                # Where the piece ends, the suffix begins with it.
                ended = self.lengths[open_[live]] <= k
                less[live[ended]] = above
                live = live[~ended]
                if not len(live):
                    break
                a, b = padded[start[live] + k], self.codes[open_[live], k]
                less[live[a < b]] = True
                live = live[a == b]
            less[live] = above
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]

    # -- relaxation ------------------------------------------------------------

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has.

        A word is its characters, of which the neighbours that form the piece of
        best score (the first of equals) are joined until none do.
        """
        # Code 0 ends a word; as a word it is a byte.
        nul = [k for k, w in enumerate(words) if w == "\0"]
        text = "\0".join(["" if w == "\0" else w for w in words] if nul else words) + "\0"
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        keys, piece = self.edges(codes)
        ends = np.flatnonzero(codes == 0)
        starts = np.append(0, ends[:-1] + 1)
        sizes = ends - starts
        bounds = np.zeros(len(codes) + 1, bool)
        bounds[:-1] = codes != 0
        bounds[ends] = True
        for w in np.flatnonzero(sizes > LONG):
            self._relax_one(int(starts[w]), int(ends[w]), keys, piece, bounds)
        self._relax_all(starts, ends, sizes, keys, piece, bounds)
        at = np.flatnonzero(bounds[:-1] & (codes != 0))
        follow = np.flatnonzero(bounds)
        stop = follow[np.searchsorted(follow, at, side="right")]
        found = self._look_up(at, stop - at, keys, piece)
        known = found >= 0
        width = np.ones(len(at), np.int64)
        spelled = {int(i): chr(codes[at[i]]).encode("utf-8", "surrogatepass") for i in np.flatnonzero(~known)}
        for i, raw in spelled.items():
            width[i] = len(raw)
        place = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.int32)
        out[place[known]] = self.ids[found[known]]
        for i, raw in spelled.items():
            out[place[i]:place[i] + len(raw)] = self.byte_ids[list(raw)]
        cuts = np.append(place, len(out))[np.searchsorted(at, np.append(starts, len(codes)))]
        count = np.diff(cuts)
        out = np.insert(out, cuts[nul], self.byte_ids[0])
        count[nul] = 1
        return out.astype(np.uint32), count

    @staticmethod
    def _look_up(at: np.ndarray, length: np.ndarray, keys: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """The piece of each (position, length), -1 where there is none."""
        if not len(keys):
            return np.full(len(at), -1)
        wanted = (at << LENGTH_BITS) + np.minimum(length, (1 << LENGTH_BITS) - 1)
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[place] == wanted, piece[place], -1)

    def _relax_all(self, starts, ends, sizes, keys, piece, bounds) -> None:
        """A round joins the best pair of every word that has one."""
        live = np.flatnonzero((sizes > 1) & (sizes <= LONG))
        while len(live):
            spans = sizes[live]
            at = np.repeat(starts[live] - (np.cumsum(spans) - spans), spans) + np.arange(int(spans.sum()))
            word = np.repeat(np.arange(len(live)), spans)
            held = bounds[at]
            at, word = at[held], word[held]
            # Pairs of symbols at i and i + 1; the end of the second is that of the word or the next symbol.
            right = np.append(at[1:], 0)
            last = np.append(word[1:] != word[:-1], True)
            after = np.append(right[1:], 0)
            after = np.where(np.append(last[1:], True), ends[live][word], after)
            pairs = np.flatnonzero(~last)
            left, word = at[pairs], word[pairs]
            found = self._look_up(left, after[pairs] - left, keys, piece)
            some = found >= 0
            pairs, word, score = pairs[some], word[some], self.scores[found[some]]
            best = np.lexsort((pairs, -score, word))
            first = np.append(True, word[best][1:] != word[best][:-1]) if len(best) else np.empty(0, bool)
            chosen = best[first]
            bounds[right[pairs[chosen]]] = False
            live = live[word[chosen]]

    def _relax_one(self, start: int, end: int, keys, piece, bounds) -> None:
        """The same for one long word, by a queue of pairs."""
        lo, hi = np.searchsorted(keys, [start << LENGTH_BITS, end << LENGTH_BITS])
        found = dict(zip(keys[lo:hi].tolist(), piece[lo:hi].tolist()))
        after = {i: i + 1 for i in range(start, end)}
        before = {i: i - 1 for i in range(start + 1, end)}
        queue: list[tuple[float, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            stop = after[right]
            k = found.get((left << LENGTH_BITS) + stop - left, -1) if stop - left <= self.longest else -1
            if k >= 0:
                heapq.heappush(queue, (-self.scores[k], left, right, stop))

        for i in range(start, end - 1):
            offer(i, i + 1)
        while queue:
            _, left, right, stop = heapq.heappop(queue)
            # Either side may have grown since, or be part of another symbol.
            if after.get(left) != right or after.get(right) != stop:
                continue
            after[left] = stop
            del after[right]
            bounds[right] = False
            if stop < end:
                before[stop] = left
                offer(left, stop)
            if left > start:
                offer(before[left], left)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: their bytes in a row, without the mark before the first word."""
        ends = self.raw_ends[ids]
        starts = np.where(ids > 0, self.raw_ends[np.maximum(ids, 1) - 1], 0)
        sizes = ends - starts
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return self.raw[at].tobytes().decode("utf-8", "replace").removeprefix(" ")


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in order of their first `depth` codes, by doubling the compared length."""
    _, rank = np.unique(codes, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    order, length = np.argsort(rank, kind="stable"), 1
    while length < depth:
        behind = np.append(rank[length:], np.zeros(min(length, len(rank)), np.int64))
        key = rank * (len(rank) + 2) + behind
        order = np.argsort(key, kind="stable")
        new = np.append(True, key[order][1:] != key[order][:-1])
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(new)
        length *= 2
        if rank[order[-1]] == len(rank):
            break
    return order


class PieceIds(WordIds):
    """Ids of texts from those of their words, each of which is relaxed once."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        super().__init__(self.pieces.encode_words, REMEMBERED)

    def cut(self, text: str) -> list[str]:
        return self.pieces.words.findall(self.pieces.model.normalize(text))


@lru_cache(maxsize=2)
def piece_ids(path: str) -> PieceIds:
    return PieceIds(path)


def _encoder(path: str, keep: list[str], undo: bool):
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = piece_ids(path)
        for part in arrays.slices(batches, "_text", BLOCK):
            texts = [t or "" for t in part.column("_text").to_pylist()]
            found = words.all(texts)
            ends = np.cumsum([0] + [len(x) for x in found]).astype(np.int32)
            flat = np.concatenate(found).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            columns, names = [*(part.column(c) for c in keep), ids], [*keep, "ids"]
            if undo:
                same = [words.pieces.decode(x.astype(np.int64)) == t for x, t in zip(found, texts)]
                columns, names = [*columns, pa.array(same, pa.bool_())], [*names, "round_trip"]
            yield pa.record_batch(columns, names=names)
    return encode


def encode(docs: DataFrame, model: str, undo: bool = False) -> DataFrame:
    """`docs` with `ids`, the model's ids of each whole text.

    With `undo` also round_trip: whether the ids decode to the text, found out in
    the same pass, so a task needs one worker with one model.

    `model` is the path of a BPE model on every machine. Ids equal those of the
    model's own library. A null or empty text has no ids. Columns with the new
    names are replaced, others stay. Repeated rows are encoded alike, an empty
    table gives no rows. Any length of text is encoded whole.
    """
    new = [StructField("ids", ArrayType(IntegerType()))] + [StructField("round_trip", BooleanType())] * undo
    taken = docs.drop(*[f.name for f in new])
    keep = taken.columns
    return taken.withColumn("_text", F.col("text").cast("string")).mapInArrow(
        _encoder(model, keep, undo), StructType([*taken.schema, *new])
    )


def decode(coded: DataFrame, model: str, to: str = "decoded") -> DataFrame:
    """`coded` with the text of its `ids` in the column `to`; null ids give an empty text."""
    taken = coded.drop(to)

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_ids(model).pieces
        for batch in batches:
            ids = batch.column("ids")
            found = [pieces.decode(np.asarray(x.values if x.is_valid else [], np.int64)) for x in ids]
            yield pa.record_batch([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, to])

    return taken.mapInArrow(texts, StructType([*taken.schema, StructField(to, StringType())]))


def encoded_documents(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_ids, ids, round_trip): ids of every document, and whether they decode to its text."""
    taken = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = encode(taken, model, undo=True)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids", "round_trip")
