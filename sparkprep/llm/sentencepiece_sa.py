"""SentencePiece encoding and decoding by suffix-array matching.

Each Arrow batch is cut into units (a run of word marks and the text up to the next mark). The distinct units are
concatenated and indexed by a sorted suffix array; every piece is looked up there by binary search, which gives all of
its occurrences at once. The occurrences are edges, sorted by position, and relaxing them gives the segmentation: for a
BPE model the best-scored edge over two neighbouring segments is contracted until there is none.
"""

from __future__ import annotations

import heapq
import itertools
import pickle
import re
import sys
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARK = "▁"
#: Characters that are indexed at once.
CHUNK = 1 << 18
#: Bytes of text that a task works on at once.
SLICE = 3 << 20
#: Units longer than this are relaxed one by one with a heap.
LONG = 200
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class Pieces:
    """A BPE vocabulary with byte fallback, read from the bytes of a SentencePiece model."""

    def __init__(self, proto: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.vocab_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.text = {i: sp.id_to_piece(i) for i in plain}
        self.id = {t: i for i, t in self.text.items()}
        score = np.full(n, -np.inf)
        for i in plain:
            score[i] = sp.get_score(i)
        # Ranks of scores: equal scores share a rank, lower is better.
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int64)
        self.byte_id = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.longest = max(map(len, self.text.values()), default=1)
        if any(MARK in t.lstrip(MARK) for t in self.text.values()):
            raise ValueError("a piece holds a word mark after other text; units can't be cut at marks")
        self.alphabet = sorted(set("".join(self.text.values())))
        self.raw = [b""] * n
        for i, t in self.text.items():
            self.raw[i] = t.encode()
        for b, i in self.byte_id.items():
            self.raw[i] = bytes([b])
        # Pieces as code points, grouped by length, for the binary search.
        code = {c: k + 1 for k, c in enumerate(self.alphabet)}
        self.points = np.array([ord(c) for c in self.alphabet], np.int64)
        if len(self.alphabet) > 65_535:
            raise ValueError("more than 65,535 characters in the vocabulary")
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted({len(t) for t in self.text.values()}):
            ids = [i for i in plain if len(self.text[i]) == size]
            self.by_length[size] = np.array([[code[c] for c in self.text[i]] for i in ids], np.uint64), np.array(ids, np.int64)


def pack_columns(codes: np.ndarray, width: int) -> np.ndarray:
    """The next `width` (up to 4) 16-bit codes at each row as one big-endian number."""
    out = np.zeros(len(codes), np.uint64)
    for k in range(4):
        out = (out << np.uint64(16)) | (codes[:, k] if k < min(width, codes.shape[1]) else np.uint64(0))
    return out


def edges_of(codes: np.ndarray, unit_end: np.ndarray, pieces: Pieces) -> np.ndarray:
    """A table (position, length) -> id + 1 of the pieces that occur in the text, 0 elsewhere.

    `codes` has a 16-bit code for each character (0: in no piece) and `unit_end` the end of its unit; pieces don't cross it.
    """
    n, depth = len(codes), pieces.longest
    padded = np.concatenate([codes, np.zeros(depth + 4, np.uint64)])
    position = np.arange(n)
    words = []  # suffixes as numbers of four characters each, cut at the unit's end
    for k in range(0, depth, 4):
        word = np.zeros(n, np.uint64)
        for j in range(k, k + 4):
            word = (word << np.uint64(16)) | np.where(position + j < unit_end, padded[j:j + n], np.uint64(0))
        words.append(word)
    array = np.argsort(words[0], kind="stable")  # the suffix array, to the depth that pieces need
    rank_word = words[0][array]
    tied = np.nonzero(rank_word[1:] == rank_word[:-1])[0]
    if len(tied) and len(words) > 1:
        busy = np.zeros(n, bool)
        busy[tied] = busy[tied + 1] = True
        busy &= words[1][array] != 0
        rows = np.nonzero(busy | np.isin(rank_word, np.unique(rank_word[busy])))[0]
        part = array[rows]
        order = np.lexsort([w[part] for w in reversed(words)])
        array[rows] = part[order]
    keys = [w[array] for w in words]
    table = np.zeros((n, depth + 1), np.int32)
    for size, (piece, ids) in pieces.by_length.items():
        lo, hi = np.zeros(len(ids), np.int64), np.full(len(ids), n, np.int64)
        for k in range(0, size, 4):
            width = min(4, size - k)
            low = pack_columns(piece[:, k:k + 4], width)
            high = low + (np.uint64(1) << np.uint64(16 * (4 - width))) - np.uint64(1) if width < 4 else low
            if k == 0:
                lo, hi = np.searchsorted(keys[0], low, "left"), np.searchsorted(keys[0], high, "right")
            else:
                lo, hi = bounded_search(keys[k // 4], low, lo, hi, False), bounded_search(keys[k // 4], high, lo, hi, True)
        count = np.maximum(hi - lo, 0)
        total = int(count.sum())
        if total:
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(total)
            table[array[at], size] = np.repeat(ids + 1, count)
    return table


def bounded_search(keys: np.ndarray, wanted: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of each wanted number in its own sorted range [lo, hi) of keys."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        value = keys[np.minimum(mid, len(keys) - 1)]
        down = open_ & ((value <= wanted) if right else (value < wanted))
        lo = np.where(down, mid + 1, lo)
        hi = np.where(open_ & ~down, mid, hi)
    return lo


def relax(table: np.ndarray, start: np.ndarray, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments (start, length) of all units, in order, after contracting edges by rank and then from the left."""
    offset, length, unit = np.arange(len(table)), np.ones(len(table), np.int64), np.repeat(np.arange(len(size)), size)
    done_at, done_len = [], []
    worst = np.int64(1) << 40
    while len(offset):
        pair = np.minimum(length[:-1] + length[1:], table.shape[1] - 1)
        token = table[offset[:-1], pair].astype(np.int64)
        ok = (unit[:-1] == unit[1:]) & (length[:-1] + length[1:] < table.shape[1]) & (token > 0)
        cost = np.append(np.where(ok, rank[token - 1], worst), worst)
        first = np.concatenate(([0], np.nonzero(unit[1:] != unit[:-1])[0] + 1))
        per_unit = np.diff(np.append(first, len(unit)))
        best = np.minimum.reduceat(cost, first)
        ended = np.repeat(best == worst, per_unit)
        done_at.append(offset[ended])
        done_len.append(length[ended])
        hit = np.nonzero((cost == np.repeat(best, per_unit)) & ~ended)[0]
        hit = hit[np.concatenate(([True], unit[hit][1:] != unit[hit][:-1]))] if len(hit) else hit  # the leftmost of equals
        length[hit] += length[hit + 1]
        keep = ~ended
        keep[hit + 1] = False
        offset, length, unit = offset[keep], length[keep], unit[keep]
    at, ln = np.concatenate(done_at), np.concatenate(done_len)
    order = np.argsort(at)
    return at[order], ln[order]


def relax_long(table: np.ndarray, start: int, size: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one long unit, with a heap."""
    width = table.shape[1]
    length = [1] * size
    before, after = list(range(-1, size - 1)), list(range(1, size + 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < size and length[i] + length[j] < width and (token := int(table[start + i, length[i] + length[j]])):
            heapq.heappush(heap, (int(rank[token - 1]), i, length[i], length[j]))

    for i in range(size):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if length[i] == a else size
        if j >= size or length[j] != b:
            continue
        length[i], length[j] = a + b, 0
        after[i] = after[j]
        if after[i] < size:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    kept = np.nonzero(length)[0]
    return kept + start, np.array(length, np.int64)[kept]


def encode_units(units: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct units one after the other, and the number of ids of each."""
    ids, counts = [], []
    i = 0
    while i < len(units):
        j, room = i, CHUNK
        while j < len(units) and (j == i or room >= len(units[j])):
            room -= len(units[j])
            j += 1
        a, b = _encode_chunk(units[i:j], pieces)
        ids.append(a)
        counts.append(b)
        i = j
    return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def _encode_chunk(units: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
    at = np.minimum(np.searchsorted(pieces.points, points), len(pieces.points) - 1)
    codes = np.where(pieces.points[at] == points, at + 1, 0).astype(np.uint64)
    size = np.fromiter(map(len, units), np.int64, len(units))
    end = np.cumsum(size)
    table = edges_of(codes, np.repeat(end, size), pieces)
    long = size > LONG
    if long.any():
        here = np.repeat(~long, size)
        at_, ln_ = relax(table[here], end[~long] - size[~long], size[~long], pieces.rank) if (~long).any() else (np.zeros(0, np.int64),) * 2
        parts = [(np.nonzero(here)[0][at_], ln_)] + [relax_long(table, int(end[u] - size[u]), int(size[u]), pieces.rank) for u in np.nonzero(long)[0]]
        seg, ln = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(seg)
        seg, ln = seg[order], ln[order]
    else:
        seg, ln = relax(table, end - size, size, pieces.rank)
    token = table[seg, ln].astype(np.int64) - 1
    unit = np.searchsorted(end, seg, "right")
    lost = np.nonzero(token < 0)[0]
    if len(lost):  # single characters outside the vocabulary become their bytes
        spelled = [[pieces.byte_id.get(b, pieces.unknown) for b in chr(points[seg[k]]).encode()] for k in lost]
        times = np.ones(len(token), np.int64)
        times[lost] = [len(s) for s in spelled]
        place = np.cumsum(times) - times
        unit, token = np.repeat(unit, times), np.repeat(token, times)
        for k, s in zip(lost, spelled):
            token[place[k]:place[k] + len(s)] = s
    return token.astype(np.int32), np.bincount(unit, minlength=len(units))


UNIT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+")


def encode_texts(texts: list[str], pieces: Pieces) -> list[np.ndarray]:
    number: dict[str, int] = defaultdict(itertools.count().__next__)
    look = number.__getitem__
    rows = []
    for text in texts:
        if not text:
            rows.append(np.zeros(0, np.int64))
            continue
        units = UNIT.findall(MARK + text.replace(" ", MARK))
        rows.append(np.fromiter(map(look, units), np.int64, len(units)))
    ids, counts = encode_units(list(number), pieces)
    start = np.cumsum(counts) - counts
    out = []
    for row in rows:
        n = counts[row]
        total = int(n.sum())
        out.append(ids[np.repeat(start[row] - (np.cumsum(n) - n), n) + np.arange(total)] if total else np.zeros(0, np.int32))
    return out


def decode_ids(ids: np.ndarray, pieces: Pieces) -> str:
    """The text of ids: bytes are joined (broken UTF-8 becomes U+FFFD), marks are spaces, the first one is dropped."""
    raw = b"".join([pieces.raw[i] for i in ids.tolist()])
    text = raw.decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def load_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, text: str = "text", into: str = "ids", model: str = MODEL, round_trip: str | None = None) -> DataFrame:
    """`df` with the array<int> column `into`; with `round_trip`, also a boolean column of that name: do the ids decode to the text?

    The driver reads the model file and sends it with the tasks. NULL gives NULL in both, an empty text an empty array.
    Characters outside the vocabulary become byte pieces; U+2581 counts as a space, so texts that hold it don't come back.
    Existing columns of these names are replaced.
    """
    new = [T.StructField(into, T.ArrayType(T.IntegerType(), False))] + ([T.StructField(round_trip, T.BooleanType())] if round_trip else [])

    def work(column: pa.Array, pieces: Pieces) -> list[pa.Array]:
        texts = column.to_pylist()
        rows = encode_texts([t or "" for t in texts], pieces)
        lists = [pa.ListArray.from_arrays(
            pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rows]))), pa.int32(), mask=np.array([t is None for t in texts] + [False])),
            pa.array(np.concatenate(rows).astype(np.int32)),
        )]
        return lists + ([pa.array([None if t is None else decode_ids(r, pieces) == t for t, r in zip(texts, rows)], pa.bool_())] if round_trip else [])

    return _mapped(df, text, new, model, work, text_column=True)


def decode(df: DataFrame, ids: str = "ids", into: str = "decoded", model: str = MODEL) -> DataFrame:
    """`df` with the text of an array<int> column; NULL gives NULL. An existing column `into` is replaced."""

    def work(column: pa.Array, pieces: Pieces) -> list[pa.Array]:
        return [pa.array([None if v is None else decode_ids(np.asarray(v, np.int64), pieces) for v in column.to_pylist()], pa.string())]

    return _mapped(df, ids, [T.StructField(into, T.StringType())], model, work, text_column=False)


def _mapped(df: DataFrame, source: str, new: list[T.StructField], model: str, work, text_column: bool) -> DataFrame:
    # Pickled by value, as executors may have no copy of the package; its size is that of a vocabulary.
    sent = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(Pieces(load_model(model))))
    names = [f.name for f in new]
    keep = [c for c in df.columns if c not in names]
    value = F.col(f"`{source}`").cast("string" if text_column else "array<int>")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pickle.loads(sent.value)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            sizes = np.asarray(pc.fill_null(pc.binary_length(column) if text_column else pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
            # Slices of a bounded size, whatever the batch holds; a longer text has a slice of its own.
            group = (np.cumsum(sizes) - sizes) // SLICE
            cuts = np.concatenate(([0], np.nonzero(np.diff(group))[0] + 1, [len(group)]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if a < b:
                    part = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays(part.columns[:-1] + work(part.column(part.num_columns - 1), pieces), names=keep + names)
            pa.default_memory_pool().release_unused()  # idle workers keep what they hold

    schema = T.StructType([df.schema[c] for c in keep] + new)
    return df.select(*[F.col(f"`{c}`") for c in keep], value.alias("__source")).mapInArrow(apply, schema)
