"""String similarity on a 0-100 scale: normalised indel ratio, its best window, and on sorted tokens.

Texts of a batch are scored together: a longest common subsequence is one machine word of state, and a batch's pairs and
windows are the elements of an array of such words. Pairs whose shorter text is over 64 characters take integers of any
length, one pair at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a machine word, and words of state that are worked on at once.
WORD, STATE = 64, 1 << 18


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence; one step a character on an integer of len(a) bits."""
    masks: dict[str, int] = {}
    for k, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << k
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & masks.get(ch, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def _long(short: str, long: str, windows: bool) -> float:
    n = len(short)
    spans = [long[max(0, k) : k + n] for k in range(1 - n, len(long))] if windows else [long]
    return max(200.0 * _lcs(short, x) / (n + len(x)) for x in spans)


def _scored(short: list[str], long: list[str], windows: bool) -> np.ndarray:
    """Scores of pairs with 1 to WORD characters on the short side: of the whole texts, or of the best window of long
    that is as long as short (cut ends included)."""
    out = np.zeros(len(short))
    sizes = np.array([len(x) for x in short])
    for n in np.unique(sizes):
        of = np.flatnonzero(sizes == n)
        widths = np.array([len(long[i]) for i in of])
        of = of[np.argsort(widths, kind="stable")]
        at = 0
        while at < len(of):  # as many pairs as their windows fit STATE
            widest = len(long[of[min(len(of), at + 4096) - 1]])
            part = of[at : at + max(1, min(4096, STATE // max(1, widest + int(n))))]
            at += len(part)
            widths = np.array([len(long[i]) for i in part])
            top = int(widths.max())
            codes = {ch: k + 1 for k, ch in enumerate(sorted(set().union(*(long[i] for i in part))))}
            names = {x: k for k, x in enumerate(dict.fromkeys(short[i] for i in part))}
            table = np.zeros((len(names), len(codes) + 1), np.uint64)  # column 0: a character of no text
            for x, k in names.items():
                for p, ch in enumerate(x):
                    if ch in codes:
                        table[k, codes[ch]] |= np.uint64(1 << p)
            pad = int(n) - 1 if windows else 0
            own = np.zeros((len(part), top + 2 * pad), np.int64)
            for r, i in enumerate(part):
                own[r, pad : pad + widths[r]] = [codes[ch] for ch in long[i]]
            masks = table[np.array([names[short[i]] for i in part])[:, None], own]
            count, steps = (top + pad, int(n)) if windows else (1, top)
            s = np.full((len(part), count), np.uint64((1 << int(n)) - 1))
            for k in range(steps):
                u = s & masks[:, k : k + count]
                s = (s + u) | (s - u)
            common = n - np.bitwise_count(s & np.uint64((1 << int(n)) - 1)).astype(np.int64)
            if windows:
                start = np.arange(count) - pad
                wide = np.minimum(start + n, widths[:, None]) - np.maximum(start, 0)
            else:
                wide = widths[:, None]
            out[part] = np.where(wide > 0, 200.0 * common / np.maximum(n + wide, 1), 0.0).max(axis=1)
    return out


def _all(a: Sequence[str], b: Sequence[str], windows: bool) -> np.ndarray:
    """Scores of pairs (a, b); of equal lengths, a window may be of either."""
    out = np.zeros(len(a))
    jobs: list[tuple[int, str, str]] = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x == y:
            out[i] = 100.0
        elif x and y:
            jobs.append((i, *((x, y) if len(x) <= len(y) else (y, x))))
            if windows and len(x) == len(y):
                jobs.append((i, y, x))
    fits = [j for j in jobs if len(j[1]) <= WORD]
    if fits:
        np.maximum.at(out, [j[0] for j in fits], _scored([j[1] for j in fits], [j[2] for j in fits], windows))
    for i, x, y in jobs:
        if len(x) > WORD:
            out[i] = max(out[i], _long(x, y, windows))
    return out


def _of_pairs(a: Sequence[str | None], b: Sequence[str | None], windows: bool, key: Callable[[str], str] = str) -> np.ndarray:
    """Scores of pairs, each distinct one once; a null counts as an empty text."""
    pairs = list(zip((key(x or "") for x in a), (key(y or "") for y in b), strict=True))
    at = {p: k for k, p in enumerate(dict.fromkeys(pairs))}
    scores = _all([p[0] for p in at], [p[1] for p in at], windows)
    return scores[[at[p] for p in pairs]] if pairs else scores


def _in_order(text: str) -> str:
    return " ".join(sorted(text.split()))


#: By name: the indel ratio, that of the best window, and that of the texts' sorted words.
KINDS: dict[str, Callable[[Sequence[str | None], Sequence[str | None]], np.ndarray]] = {
    "ratio": lambda a, b: _of_pairs(a, b, False),
    "partial_ratio": lambda a, b: _of_pairs(a, b, True),
    "token_sort_ratio": lambda a, b: _of_pairs(a, b, False, _in_order),
}


def ratio(a: str | None, b: str | None) -> float:
    return float(KINDS["ratio"]([a], [b])[0])


def partial_ratio(a: str | None, b: str | None) -> float:
    return float(KINDS["partial_ratio"]([a], [b])[0])


def token_sort_ratio(a: str | None, b: str | None) -> float:
    return float(KINDS["token_sort_ratio"]([a], [b])[0])


def similarity(kind: str, a: Column, b: Column) -> Column:
    of = KINDS[kind]

    @F.pandas_udf("double")
    def scored(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(of(x.tolist(), y.tolist()), dtype="float64")

    return scored(a, b)


def may_reach(kind: str, a: Sequence[str], b: Sequence[str], least: float) -> np.ndarray:
    """Whether pairs can score ``least``: a common subsequence is no longer than the characters in common, in any order
    (counted in 64 classes of them, which adds to that at most)."""
    at = {x: k for k, x in enumerate(dict.fromkeys([*a, *b]))}
    sizes = np.array([len(x) for x in at], np.int64)
    codes = np.frombuffer("".join(at).encode("utf-32-le", "surrogatepass"), np.uint32) & 63
    counts = np.bincount(np.repeat(np.arange(len(at)), sizes) * 64 + codes, minlength=64 * len(at)).reshape(-1, 64).astype(np.int32)
    i, j = np.array([at[x] for x in a], np.int64), np.array([at[x] for x in b], np.int64)
    common = np.minimum(counts[i], counts[j]).sum(axis=1)
    # the best window is as long as what it has in common at least
    whole = np.minimum(sizes[i], sizes[j]) + common if kind == "partial_ratio" else sizes[i] + sizes[j]
    return (200.0 * common >= least * whole - 1e-6) | (i == j)


def similarity_from(kind: str, a: Column, b: Column, least: float) -> Column:
    """``similarity``, -1 for pairs that can't reach ``least``, which are told before they are scored."""
    of, key = KINDS[kind], _in_order if kind == "token_sort_ratio" else str

    @F.pandas_udf("double")
    def scored(x: pd.Series, y: pd.Series) -> pd.Series:
        left, right, out = [key(v) for v in x], [key(v) for v in y], np.full(len(x), -1.0)
        if len(x):
            may = np.flatnonzero(may_reach(kind, left, right, least))
            out[may] = of([left[k] for k in may], [right[k] for k in may])
        return pd.Series(out)

    return scored(a, b)


def with_similarity(pairs: DataFrame, kind: str, a: str, b: str, out: str = "score") -> DataFrame:
    """Adds ``out``; each distinct pair of texts is scored once and joined back."""
    distinct = pairs.select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct()
    scored = distinct.withColumn(out, similarity(kind, F.col("_a"), F.col("_b")))
    return pairs.join(scored, pairs[a].eqNullSafe(scored["_a"]) & pairs[b].eqNullSafe(scored["_b"])).drop("_a", "_b")


#: Rows of a tile that are compared at once with all of its columns, and levels of counts that are told apart by bits.
ROWS, LEVELS = 64, 4


def _tile_side(texts: list[str], codes: dict[str, int], dtype: type) -> tuple[np.ndarray, ...]:
    """Lengths of texts; their characters by place, 0 after the end; by character, the bits of its places; and for the
    bound: bits of characters that occur more than 0, 1, .. times, and how many occurrences are beyond these."""
    sizes = np.array([len(x) for x in texts], np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat = np.fromiter((codes[ch] for x in texts for ch in x), np.int64, len(row))
    own = np.zeros((int(sizes.max(initial=1)), len(texts)), np.int32)
    own[place, row] = flat
    masks = np.zeros((len(texts), len(codes) + 1), dtype)
    np.bitwise_or.at(masks, (row, flat), dtype(1) << place.astype(dtype))
    counts = np.bincount(row * WORD + flat % WORD, minlength=len(texts) * WORD).reshape(-1, WORD)
    bit = np.uint64(1) << np.arange(WORD, dtype=np.uint64)
    levels = [np.where(counts > k, bit, np.uint64(0)).sum(axis=1, dtype=np.uint64) for k in range(LEVELS)]
    return sizes, own, masks, levels, np.maximum(counts - LEVELS, 0).sum(axis=1)


def tile_scores(a: list[str], b: list[str], least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in a, places in b, ratios) of all pairs of two lists of texts of up to WORD characters whose ratio is
    ``least`` (above 0) or more, some rows of the tile at a time. Pairs with too few characters in common are told by bits,
    without being scored."""
    often = Counter(ch for x in (*a, *b) for ch in x)
    codes = {ch: k + 1 for k, (ch, _) in enumerate(often.most_common())}
    dtype = np.uint32 if max(map(len, a), default=0) <= 32 else np.uint64
    n, _, masks, x_levels, x_rest = _tile_side(a, codes, dtype)
    w, own, _, y_levels, y_rest = _tile_side(b, codes, np.uint64)
    share = least / 200
    rest = bool(x_rest.any() and y_rest.any())
    need_x, need_y = (share * n).astype(np.float32), (share * w).astype(np.float32)
    flat, width = masks.ravel(), masks.shape[1]
    for at in range(0, len(a), ROWS):
        part = slice(at, at + ROWS)
        common = sum(np.bitwise_count(x[part, None] & y[None, :]) for x, y in zip(x_levels, y_levels, strict=True))
        if rest:
            common = common + np.minimum(x_rest[part, None], y_rest[None, :])
        i, j = np.nonzero(common - need_y >= need_x[part, None] - np.float32(1e-3))
        i += at
        s = (dtype(1) << n[i].astype(dtype)) - dtype(1) if dtype is np.uint32 else np.uint64((1 << WORD) - 1) >> (WORD - n[i]).clip(0, WORD - 1).astype(np.uint64)
        full, base, chars = s.copy(), i * width, own[:, j]
        for k in range(int(w[j].max(initial=0))):
            u = s & flat[base + chars[k]]
            s = (s + u) | (s - u)
        same = n[i] - np.bitwise_count(s & full)
        score = np.where(n[i] + w[j] > 0, 200.0 * same / np.maximum(n[i] + w[j], 1), 100.0)
        keep = score >= least
        yield i[keep], j[keep], score[keep]
