"""Benchmark decontamination: near copies of benchmark items in documents.

The CGK embedding walks over a word sequence: at each step it emits the word under the pointer, and a random bit of the
word and the step says whether the pointer moves on. Sequences a few edits apart then agree at most steps, so edit
distance becomes Hamming distance. Each repetition samples a few steps of the walk from one place of every item, and
of the walk from every word of every document; agreeing samples are candidates. An exact edit distance over an
item-sized window decides.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Edits (insert, delete or replace a word) allowed per word of an item.
TOLERANCE = 0.2
REPEATS = 20
#: Text of items that goes to the tasks at once; more items take further passes.
ITEM_BYTES = 16 << 20
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Sampled steps by the words that an item has at least, for successive repetitions.
STEPS = {
    14: [(0, 4, 9, 15), (0, 5, 11, 18), (0, 3, 8, 13), (0, 6, 10, 16)],
    6: [(0, 3, 6), (0, 2, 5), (0, 4, 7), (0, 3, 5)],
    1: [(0,)],
}


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation and white space separate them."""
    return text.lower().encode().translate(_PLAIN).split() if text else []


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.uint32, len(words))


def step_bits(symbols: np.ndarray, repeat: int) -> np.ndarray:
    """64 random bits of each word for one repetition: bit j moves the pointer at step j."""
    x = symbols.astype(np.uint64) + np.uint64((repeat + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix(key: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    x = (key ^ symbol.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


@dataclass
class Sketch:
    """One repetition for the items of one length class: sampled steps, and for each length of a partial sample the sorted keys."""

    repeat: int
    steps: tuple[int, ...]
    keys: list[np.ndarray]
    #: By the order of the full keys: item and the place in it where the walk starts.
    item: np.ndarray
    start: np.ndarray
    first: np.ndarray


def walk_keys(symbols: np.ndarray, starts: np.ndarray, sketch_steps: tuple[int, ...], repeat: int) -> Iterator[np.ndarray]:
    """Keys of the samples so far, one array for each sampled step; -1 where the walk has left the sequence is not a key."""
    position, key, step = starts.copy(), np.zeros(len(starts), np.uint64), 0
    for wanted in sketch_steps:
        while step < wanted:
            bits = step_bits(symbols[np.minimum(position, len(symbols) - 1)], repeat)
            position = position + ((bits >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
            step += 1
        key = mix(key, symbols[np.minimum(position, len(symbols) - 1)])
        yield key


def anchors(words: list[bytes], span: int, repeat: int, repeats: int) -> int:
    """Where a repetition's walk starts in an item: the longest word near an evenly spread place, with `span` words to go."""
    room = max(len(words) - span, 0)
    goal = round(room * (repeat % max(repeats, 1)) / max(repeats - 1, 1))
    near = range(max(0, goal - 2), min(room, goal + 2) + 1)
    return max(near, key=lambda k: (len(words[k]), -abs(k - goal), -k))


def build(items: list[list[bytes]], repeats: int = REPEATS) -> list[Sketch]:
    """Sketches of all items; items without words are in none."""
    symbols = [hashes(w) for w in items]
    out = []
    bounds = sorted(STEPS, reverse=True)
    for k, least in enumerate(bounds):
        most = bounds[k - 1] if k else None
        chosen = [i for i, w in enumerate(items) if len(w) >= least and (most is None or len(w) < most)]
        if not chosen:
            continue
        for r in range(repeats if least > 1 else 2):
            steps = STEPS[least][r % len(STEPS[least])]
            span = max(steps) // 2 + 3 if len(steps) > 1 else 1
            if least > 1:
                start = np.array([anchors(items[i], min(span, len(items[i])), r, repeats) for i in chosen])
            else:  # single words as keys: the two longest, so that an edit of one leaves the other
                start = np.array([sorted(range(len(w)), key=lambda k: (-len(w[k]), k))[min(r, len(w) - 1)] for w in (items[i] for i in chosen)])
            partial = [np.concatenate(x) for x in zip(*(list(walk_keys(symbols[i], start[j:j + 1], steps, r)) for j, i in enumerate(chosen)))]
            order = np.argsort(partial[-1], kind="stable")
            out.append(Sketch(
                r, steps, [np.unique(p) for p in partial[:-1]] + [partial[-1][order]], np.array(chosen)[order], start[order],
                np.unique(np.concatenate([symbols[i][start[j]:start[j] + 1] for j, i in enumerate(chosen)])),
            ))
    return out


def among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    return wanted[at] == values


def candidates(symbols: np.ndarray, sketches: list[Sketch], bits: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(item, start): where in a word sequence an item may begin; pairs repeat."""
    found_item, found_start = [], []
    low = (symbols & np.uint32((1 << bits) - 1)).astype(np.int64)
    for s in sketches:
        # Step 0 is the word itself: a table of the items' first words leaves few places to walk from.
        table = np.zeros(1 << bits, bool)
        table[(s.first & np.uint32((1 << bits) - 1)).astype(np.int64)] = True
        at = np.nonzero(table[low])[0]
        at = at[among(symbols[at], s.first)]
        alive, key, position, step = at, np.zeros(len(at), np.uint64), at.copy(), 0
        for k, wanted in enumerate(s.steps):
            while step < wanted:
                moved = step_bits(symbols[np.minimum(position, len(symbols) - 1)], s.repeat)
                position = position + ((moved >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
                step += 1
            key = mix(key, symbols[np.minimum(position, len(symbols) - 1)])
            if k + 1 < len(s.steps):
                ok = among(key, s.keys[k])
                alive, key, position = alive[ok], key[ok], position[ok]
        lo, hi = np.searchsorted(s.keys[-1], key, "left"), np.searchsorted(s.keys[-1], key, "right")
        n = hi - lo
        row = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        found_item.append(s.item[row])
        found_start.append(np.repeat(alive, n) - s.start[row])
    none = np.zeros(0, np.int64)
    return np.concatenate(found_item or [none]), np.concatenate(found_start or [none])


def best_match(item: list[int], window: list[int]) -> tuple[int, int]:
    """(edits, end): the least word edits that turn the item into a part of the window, and where that part ends."""
    m = len(item)
    peq: dict[int, int] = {}
    for i, s in enumerate(item):
        peq[s] = peq.get(s, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = (m, 0)
    for j, s in enumerate(window, 1):
        eq = peq.get(s, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | (full & ~(xh | plus)), plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        plus, minus = mh | (full & ~(xv | ph)), ph & xv
        if score < best[0]:
            best = (score, j)
    return best


def allowed(words: int, tolerance: float) -> int:
    return int(words * tolerance + 1e-9)


def search(texts: list[str | None], items: list[list[bytes]], sketches: list[Sketch], tolerance: float) -> list[list[tuple[int, int, int]]]:
    """For each text the items found in it: (item, edits, last word of the best place), one entry for each item."""
    parts = [hashes(words_of(t)) for t in texts]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(parts) or not size.sum() or not sketches:
        return out
    symbols = np.concatenate(parts)
    item, start = candidates(symbols, sketches)
    anchor = np.clip(start, 0, len(symbols) - 1)
    doc = np.searchsorted(end, anchor, "right")
    best: dict[tuple[int, int], tuple[int, int]] = {}
    codes = {}
    last: tuple[int, int, int] | None = None
    for d, i, s in sorted(set(zip(doc.tolist(), item.tolist(), start.tolist()))):
        m = len(items[i])
        slack = allowed(m, tolerance)
        if last is not None and last[:2] == (d, i) and s - last[2] <= slack // 2 and s != last[2]:
            continue  # the window around the place before covers this one
        last = (d, i, s)
        begin = int(end[d] - size[d])
        reach = slack + slack // 2
        a, b = max(begin, s - reach), min(int(end[d]), s + m + reach)
        if a >= b:
            continue
        if i not in codes:
            codes[i] = hashes(items[i]).tolist()
        edits, stop = best_match(codes[i], symbols[a:b].tolist())
        if edits <= slack:
            hit = (edits, a - begin + stop - 1)
            best[d, i] = min(best.get((d, i), hit), hit)
    for (d, i), (edits, at) in sorted(best.items()):
        out[d].append((i, edits, at))
    return out


def _finder(sent, shape: str, tolerance: float):
    @F.pandas_udf(shape)
    def leaks(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids, items, sketches = pickle.loads(sent.value)
        for texts in column:
            yield pd.Series([
                [{"item": ids[i], "edits": e, "item_words": len(items[i]), "last_word": at} for i, e, at in hits]
                for hits in search(texts.tolist(), items, sketches, tolerance)
            ], dtype=object)

    return leaks


def with_leaks(
    df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    tolerance: float = TOLERANCE, repeats: int = REPEATS, into: str = "leaks",
) -> DataFrame:
    """`df` with the array column `into` of (item, edits, item_words, last_word), one entry per item found in the text.

    An item is found where some part of the text is at most `tolerance` edits per item word away, over lower-case words
    without ASCII punctuation. Items go to the tasks in parts of a bounded size, each in a narrow pass over `df`. Items
    that are NULL or have no words are never found; equal items are all reported. NULL and empty texts have no leaks. Rows
    are neither dropped nor merged; an existing column of that name is replaced.
    """
    spark = df.sparkSession
    kind = benchmark.schema[item_id].dataType.simpleString()
    shape = f"array<struct<item:{kind},edits:int,item_words:int,last_word:int>>"
    body = F.col(f"`{item_text}`").cast("string")
    usable = benchmark.select(F.col(f"`{item_id}`").alias("i"), body.alias("t")).where(F.col("t").isNotNull())
    total = usable.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = -(-total // ITEM_BYTES)
    columns = []
    for c in range(passes):
        rows = sorted(((r["t"], r["i"]) for r in usable.where(F.pmod(F.xxhash64("t", "i"), F.lit(passes)) == c).collect()), key=lambda x: (x[0], str(x[1])))
        items = [words_of(t) for t, _ in rows]
        sent = spark.sparkContext.broadcast(cloudpickle.dumps(([i for _, i in rows], items, build(items, repeats))))

        columns.append(_finder(sent, shape, tolerance)(F.col(f"`{text}`").cast("string")))
    none = F.array().cast(shape)
    return df.withColumn(into, F.concat(*columns) if columns else none)
