"""Local alignment of pairs of sequences in Arrow batches, on both strands, seen from either side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MATCH, MISMATCH, GAP = 2, -3, -4
SEED = 8
LEAST = 30  # identical bases
SHARE = 0.9  # of the columns, and of what the two could overlap
SCORE = 46  # no alignment with LEAST identical bases in SHARE of its columns scores less
CODES = np.full(256, 8, np.uint8)
CODES[np.frombuffer(b"ACGT", np.uint8)] = range(4)
OTHER = bytes.maketrans(b"ACGT", b"TGCA")


def _reverse(s: str) -> str:
    return s.encode().translate(OTHER)[::-1].decode()


def _table(texts: list[str], pad: int) -> np.ndarray:
    """A row per base, a column per text; other characters and what lies beyond the end equal nothing."""
    out = np.full((max(map(len, texts)), len(texts)), pad, np.uint8)
    for i, t in enumerate(texts):
        c = CODES[np.frombuffer(t.encode(), np.uint8)]
        out[: len(t), i] = np.where(c < 4, c, pad)
    return out


def _seeded(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Which pairs share SEED consecutive bases. With at most a tenth of the columns differing and LEAST identical bases, an alignment holds such a run."""

    def words(x: np.ndarray, side: int) -> np.ndarray:
        n = len(x) - SEED + 1
        if n < 1:
            return np.zeros((x.shape[1], 0), np.int32)
        code, bad = np.zeros((n, x.shape[1]), np.int32), np.zeros((n, x.shape[1]), bool)
        for i in range(SEED):
            code = code * 4 + (x[i : i + n] & 3)
            bad |= x[i : i + n] > 3
        return np.where(bad, -4, code * 2 + side).T

    both = np.sort(np.concatenate([words(q, 0), words(s, 1)], axis=1), axis=1)
    return ((both[:, 1:] - both[:, :-1] == 1) & (both[:, :-1] >= 0) & (both[:, :-1] % 2 == 0)).any(axis=1)


def _scores(q: np.ndarray, s: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(best score, its antidiagonal, all scores by antidiagonal and query position if kept) of each pair, over the whole matrix."""
    n, m, b = len(q), len(s), q.shape[1]
    h = np.zeros((n + m + 1 if keep else 3, n + 1, b), np.int16)
    back = s[::-1]
    best, at = np.zeros(b, np.int16), np.zeros(b, np.int64)
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1)
        cur, one, two = (h[d], h[d - 1], h[d - 2]) if keep else (h[d % 3], h[(d - 1) % 3], h[(d - 2) % 3])
        x = (q[lo - 1 : hi] == back[m - d + lo : m - d + hi + 1]).astype(np.int16)
        x *= MATCH - MISMATCH
        x += MISMATCH
        x += two[lo - 1 : hi]
        y = np.maximum(one[lo : hi + 1], one[lo - 1 : hi])
        y += GAP
        np.maximum(x, y, out=x)
        np.maximum(x, 0, out=x)
        cur[lo : hi + 1] = x
        top = x.max(axis=0)
        better = top > best
        best[better] = top[better]
        at[better] = d
    return best, at, h if keep else None


def _traced(qs: list[str], ss: list[str], q: np.ndarray, s: np.ndarray) -> list[tuple[int, int, int, int, int, str, str]]:
    """(score, start, stop, start and stop on the other, aligned texts) of the best local alignment of each pair."""
    best, d, h = _scores(q, s, True)
    b = np.arange(len(qs))
    i = h[d, :, b].argmax(axis=1)
    j = d - i
    stops, steps = (i.copy(), j.copy()), []
    live = best > 0
    while live.any():
        now, up = h[d, i, b], h[np.maximum(d - 1, 0), np.maximum(i - 1, 0), b]
        a, c = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        cross = live & (h[np.maximum(d - 2, 0), a, b] + np.where(q[a, b] == s[c, b], MATCH, MISMATCH) == now)
        gap_s = live & ~cross & (up + GAP == now)
        gap_q = live & ~cross & ~gap_s
        steps.append(np.where(cross, 0, np.where(gap_s, 1, np.where(gap_q, 2, 3))))
        i, j = i - (cross | gap_s), j - (cross | gap_q)
        d = i + j
        live &= h[d, i, b] > 0
    moves = np.array(steps[::-1], np.uint8).reshape(len(steps), len(qs)).T
    out = []
    for k, (x, y) in enumerate(zip(qs, ss, strict=True)):
        p, r, left, right = int(i[k]), int(j[k]), [], []
        for move in moves[k][moves[k] < 3].tolist():
            left.append("-" if move == 2 else x[p])
            right.append("-" if move == 1 else y[r])
            p, r = p + (move != 2), r + (move != 1)
        out.append((int(best[k]), int(i[k]), int(stops[0][k]), int(j[k]), int(stops[1][k]), "".join(left), "".join(right)))
    return out


def align(pairs: list[tuple[str, str]]) -> list[tuple | None]:
    """The alignment (as in _traced) of each pair of upper-case sequences, None where none can have LEAST identical bases in SHARE of its columns."""
    out: list[tuple | None] = [None] * len(pairs)

    def pieces(at: list[int], cells: int) -> Iterator[tuple[list[int], list[str], list[str], np.ndarray, np.ndarray]]:
        at = sorted(at, key=lambda k: (len(pairs[k][0]) + len(pairs[k][1]), len(pairs[k][0])))
        while at:
            n = max(1, min(1024, cells // max(1, (len(pairs[at[-1]][0]) + len(pairs[at[-1]][1])) ** 2 // 2)))
            part, at = at[-n:], at[:-n]
            qs, ss = [pairs[k][0] for k in part], [pairs[k][1] for k in part]
            yield part, qs, ss, _table(qs, 8), _table(ss, 9)

    seeded: list[int] = []
    for part, _, _, q, s in pieces([k for k, (x, y) in enumerate(pairs) if min(len(x), len(y)) >= LEAST], 40_000_000):
        seeded += [part[i] for i in np.flatnonzero(_seeded(q, s))]
    good: list[int] = []
    for part, _, _, q, s in pieces(seeded, 20_000_000):
        good += [part[i] for i in np.flatnonzero(_scores(q, s, False)[0] >= SCORE)]
    for part, qs, ss, q, s in pieces(good, 20_000_000):
        for k, found in zip(part, _traced(qs, ss, q, s), strict=True):
            out[k] = found
    return out


def _rows(a: str, b: str, x: str, y: str, found: tuple, back: bool) -> Iterator[tuple]:
    """The alignment as a match of a with b, and of b with a; back: y is the reverse complement of b."""
    _, i, i2, j, j2, qs, ss = found
    same = sum(c == e and c in "ACGT" for c, e in zip(qs, ss, strict=True))
    n, m = len(x), len(y)
    if same < LEAST or same < SHARE * len(qs):
        return
    for side, (start, stop, c, d, own, other) in enumerate(((i, i2, j, m - j2, n, m), (j, j2, i, n - i2, m, n))):
        could = other - max(0, c - start) - max(0, d - (own - stop))
        if same < SHARE * could:
            continue
        if not side:
            yield a, start, stop, could, qs, ss
        elif back:
            yield b, m - stop, m - start, could, _reverse(ss), _reverse(qs)
        else:
            yield b, start, stop, could, ss, qs


def aligned_pairs(pairs: DataFrame) -> DataFrame:
    """(query_id, start, stop, length, qs, ss) of pairs (a, a_seq, b, b_seq), each seen from both sides.

    A pair counts if its best local alignment on either strand has at least LEAST identical bases, SHARE of its columns and of the bases that the two could overlap (what goes off an end is
    no part of it); length is that overlap.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 5000):
                p = batch.iloc[k : k + 5000]
                x, y = [t.upper() for t in p["a_seq"]], [t.upper() for t in p["b_seq"]]
                z = [_reverse(t) for t in y]
                ahead, back = align(list(zip(x, y, strict=True))), align(list(zip(x, z, strict=True)))
                out = []
                for a, b, s, t, u, f, g in zip(p["a"], p["b"], x, y, z, ahead, back, strict=True):
                    turned = f is None or (g is not None and g[0] > f[0])
                    found = g if turned else f
                    if found is not None:
                        out += _rows(a, b, s, u if turned else t, found, turned)
                yield pd.DataFrame(out, columns=["query_id", "start", "stop", "length", "qs", "ss"])

    return pairs.select("a", "a_seq", "b", "b_seq").mapInPandas(run, "query_id string, start int, stop int, length int, qs string, ss string")
