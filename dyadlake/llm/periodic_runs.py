r"""Periodic runs of words: maximal stretches that repeat themselves, found and collapsed.

A run is a stretch of consecutive words `[^\x20\x09-\x0D]+` with smallest period q (words q apart are the same), as long as ``least``
words and twice its period at least, that no neighbouring word extends keeping the period.

The method is Main and Lorentz's. Words are interned as numbers and every text is halved again and again, down to parts shorter than a run may be.
A repetition of period p that crosses a part's middle is seen from the place p words before or after it: the Z-functions of the right
half (forwards) and of the left half (backwards) tell for how many words the two places agree on both sides, and p of them make a repetition. One that goes on past its part has been found whole further up and is
dropped, equal intervals keep the smallest period, and multiples of a period thereby vanish (a stretch of twice p words with
periods p and q < p has their greatest common divisor as a period).

All parts of a level, of all texts of a chunk, are worked on at once in numpy. As a repetition needs six words of agreement at least, and so three on one side,
only places with three equal words are looked at; a part with many such places gets its Z-functions in full, so the time stays within n log n whatever the text. Nothing is shuffled, and memory follows the
longest single text.

Defined results: a null or empty text, or one of white space, has no words, no runs and the empty collapsed text; a text shorter than ``least`` words has no runs; texts are never cut; overlapping runs are all listed, by start and then
period; repeated rows are rows of their own; an empty table gives an empty one; columns of the input with an added name are replaced.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

LEAST = 12
#: Words of agreement that are compared together before single words; a run needs twice as many.
SEEN = 3
#: A part with more places to look at than this, and than a sixteenth of its words or ``MANY``, gets its Z-functions in full.
FEW, MANY = 32, 256
ADDED = {"n_words": "bigint", "run_starts": "array<bigint>", "run_lengths": "array<bigint>", "run_periods": "array<bigint>", "collapsed": "string"}


def z_function(s: list[int]) -> list[int]:
    """For every place, how many words from there on agree with the beginning."""
    z = [0] * len(s)
    left = right = 0
    for i in range(1, len(s)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < len(s) and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _agreement(s: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """For how many words, at most ``most``, the words from places a and b on (``step`` 1) or before them (-1) agree."""
    out = np.zeros(len(a), np.int64)
    shift = 0 if step > 0 else -1
    live = np.flatnonzero(most > 0)
    for k in range(8):  # most agreements are short: a word of each at a time
        live = live[s[a[live] + step * k + shift] == s[b[live] + step * k + shift]]
        out[live] = k + 1
        live = live[most[live] > k + 1]
        if not len(live):
            return out
    for c in live:  # long ones in growing blocks
        n, width = int(out[c]), 64
        while n < most[c]:
            width = min(width, int(most[c]) - n)
            at = (a[c] + n, b[c] + n) if step > 0 else (a[c] - n - width, b[c] - n - width)
            odd = np.flatnonzero(s[at[0] : at[0] + width] != s[at[1] : at[1] + width])
            if len(odd):
                n += int(odd[0]) if step > 0 else width - 1 - int(odd[-1])
                break
            n, width = n + width, width * 2
        out[c] = n
    return out


def _whole_part(s: np.ndarray, lo: int, mid: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All places of a part but its middle, and for how many words each agrees with the middle, before and after: by Z-functions."""
    u, v = s[lo:mid].tolist(), s[mid:hi].tolist()
    after = np.array(z_function([*v, -1, *u, *v])[len(v) + 1 :], np.int64)
    before = np.array(z_function([*u[::-1], -1, *v[::-1], *u[::-1]])[len(u) + 1 :], np.int64)[::-1]
    at = np.arange(lo, hi)
    before = np.concatenate([[0], before[:-1]])  # ending at a place: up to the word before it
    keep = at != mid
    return at[keep], before[keep], after[keep]


def find_runs(s: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and smallest periods of all runs, by start and then period. ``s``: the numbers of all texts' words; those of text i are ``first[i]:first[i+1]``."""
    if least < 2 * SEEN:
        raise ValueError(f"runs of less than {2 * SEEN} words are not looked for")
    found = [np.zeros((0, 3), np.int64)]
    if len(s) >= least:
        mixed = s.astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            seen = (mixed[:-2] * np.uint64(0x9E3779B97F4A7C15) + mixed[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + mixed[2:]
        seen = np.concatenate([np.zeros(SEEN, np.uint64), seen, np.zeros(SEEN, np.uint64)])  # seen[i + 3]: the three words from i on, as a hash that only rules out
        lo, hi = first[:-1].copy(), first[1:].copy()
        text_lo, text_hi = lo, hi
        while True:
            big = hi - lo >= least
            lo, hi, text_lo, text_hi = lo[big], hi[big], text_lo[big], text_hi[big]
            if not len(lo):
                break
            mid, size = (lo + hi) // 2, hi - lo
            base = np.cumsum(size) - size
            at = np.arange(int(size.sum())) + np.repeat(lo - base, size)
            like = (seen[at + SEEN] == np.repeat(seen[mid + SEEN], size)) | (seen[at] == np.repeat(seen[mid], size))
            like[base + mid - lo] = False
            place = np.flatnonzero(like)
            part = np.searchsorted(base, place, side="right") - 1
            count = np.bincount(part, minlength=len(lo))
            full = (count > FEW) & ((count > MANY) | (count > size // 16))
            few = ~full[part]
            part, at = part[few], at[place[few]]
            i, k = np.minimum(at, mid[part]), np.maximum(at, mid[part])
            looked = [(part, i, k, _agreement(s, i, k, i - lo[part], -1), _agreement(s, i, k, hi[part] - k, 1))]
            for n in np.flatnonzero(full):
                at, before, after = _whole_part(s, int(lo[n]), int(mid[n]), int(hi[n]))
                looked.append((np.full(len(at), n), np.minimum(at, mid[n]), np.maximum(at, mid[n]), before, after))
            for part, i, k, before, after in looked:
                p = k - i
                ok = before + after >= np.maximum(p, least - p)
                part, p, start, end = part[ok], p[ok], (i - before)[ok], (k + after)[ok]
                more = np.zeros(len(p), bool)  # goes on past the part: found whole further up
                left = np.flatnonzero((start == lo[part]) & (start > text_lo[part]))
                more[left] = s[start[left] - 1] == s[start[left] - 1 + p[left]]
                right = np.flatnonzero((end == hi[part]) & (end < text_hi[part]))
                more[right] |= s[end[right]] == s[end[right] - p[right]]
                found.append(np.stack([start, end, p], 1)[~more])
            lo, hi, text_lo, text_hi = np.concatenate([lo, mid]), np.concatenate([mid, hi]), np.tile(text_lo, 2), np.tile(text_hi, 2)
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, 0] != runs[:-1, 0]) | (runs[1:, 1] != runs[:-1, 1])
    runs = runs[new]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2]


def _of_texts(texts: list[str | None], least: int) -> list[list]:
    """The added columns of some texts."""
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]  # splits at just the bytes 20 and 09 to 0D
    first = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=first[1:])
    flat = list(itertools.chain.from_iterable(words))
    number = dict(zip(flat, range(len(flat)), strict=True))  # interned: a word's number is its last place
    s = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    start, end, period = find_runs(s, first, least)
    cut = np.searchsorted(start, first)
    out: list[list] = [[], [], [], [], []]
    for i, w in enumerate(words):
        a, b = cut[i], cut[i + 1]
        begins, ends, periods = start[a:b] - first[i], end[a:b] - first[i], period[a:b]
        if b > a:
            edge = np.zeros(len(w) + 1, np.int64)
            np.add.at(edge, begins + periods, 1)
            np.add.at(edge, ends, -1)
            w = [w[j] for j in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
        for column, value in zip(out, (int(first[i + 1] - first[i]), begins.tolist(), (ends - begins).tolist(), periods.tolist(), b" ".join(w).decode("utf-8", "surrogatepass")), strict=True):
            column.append(value)
    return out


def find(df: DataFrame, text: str = "text", least: int = LEAST, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns), ``n_words``, ``runs`` (array of start, length and period, in words, by start and then period) and ``collapsed``: the text's words joined by one space, without those
    that a run holds after its first period."""

    def work():
        def texts_of(texts: list[str | None]) -> list[list]:
            out: list[list] = [[], [], [], [], []]
            for a, b in S.chunks([t or "" for t in texts]):
                for column, more in zip(out, _of_texts(texts[a:b], least), strict=True):
                    column.extend(more)
            return out

        return texts_of

    df = df.drop(*[c for c in df.columns if c.lower() == "runs" and c != text])
    found = S.add_columns(df, text, ADDED, work, keep)
    own = [F.col(f"`{c}`") for c in found.columns[: -len(ADDED)]]
    zipped = F.arrays_zip(F.col("run_starts").alias("start"), F.col("run_lengths").alias("length"), F.col("run_periods").alias("period"))
    return found.select(*own, "n_words", zipped.cast("array<struct<start:bigint,length:bigint,period:bigint>>").alias("runs"), "collapsed")


def digests(found: DataFrame, keep: list[str]) -> DataFrame:
    """Of ``find``'s rows: the number of runs, the longest one (ties: least start, then period; nulls where there is none) and digests of all runs and of the collapsed text."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    return found.withColumn("longest", longest).select(
        *keep, F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"), (-F.col("longest.less")).alias("length"), F.col("longest.period").alias("period"),
        F.expr("(-1000 * longest.less) div longest.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    r"""Texts with known runs: with h the unsigned crc32 of the key in decimal and g = floor(h/10), where 10 divides h every word i from a = g mod n on becomes word a + (i-a) mod p, p = 1 + floor((n-a)/(3 + g mod 8)). A null key plants nothing."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def planted(w):
        g, n = F.floor(h / 10), F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    changed = F.get(F.transform(F.array(words), planted), F.lit(0))  # one element: the words are named once
    return df.withColumn(text, F.when((h % 10 == 0) & F.col(text).rlike(r"[^\x20\x09-\x0D]"), changed).otherwise(F.col(text)))
