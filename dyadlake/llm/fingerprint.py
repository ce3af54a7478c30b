"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a piece wherever its low bits are zero; the number of zero bits needed is
the block size (its logarithm, the level). A text's level follows from its length in bytes, so that about ``PIECES``/2
to ``PIECES`` pieces are to be expected; every byte of every text counts and no signature is cut. Each piece gives one character; the fingerprint is the level and the signatures at that level and the next:
``level:signature:signature``. Two fingerprints are compared at equal block sizes, those of the same or the
neighbouring level, by edit distance (insertions and deletions), 1 for equal signatures; signatures without a common
run of ``RUN`` characters (half of a shorter signature) count as unlike.

Fingerprints are made in a map. The comparison with the next document takes one range shuffle by id, of compressed
texts, whose boundaries are ids of documents: the first document of a range also goes to the end of the range before it, so each
range finds its successors itself, a row at a time, and no window runs over the whole table.

Defined results: null counts as empty; the empty text's fingerprint has empty signatures; two empty ones are alike (1); rows
with equal ids follow one another by text, a null id comes first; the last document is followed by the first, a single one by itself; repeated rows
get the same fingerprint; an empty table gives an empty one; a column of the input named fingerprint is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

PIECES = 48
LEAST = 2
WINDOW = 7
RUN = 4
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def boundaries(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece ends at level ``LEAST`` or above: place, level, and the hash of all bytes before; in blocks, so that memory stays small."""
    place, level, before = [], [], []
    total, power = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    step = S.CHUNK - WINDOW
    p, inverse = S._powers("p"), S._powers("i")
    for a in range(0, len(data), step):
        lead = min(a, WINDOW - 1)
        block = np.frombuffer(data, np.uint8, min(step, len(data) - a) + lead, a - lead)
        sums = S.prefix_sums(block)
        i = np.arange(lead, len(block))
        j = np.maximum(i - (WINDOW - 1), 0)
        rolled = S.mix((sums[i + 1] - sums[j]) * inverse[j])
        low = rolled & (~rolled + np.uint64(1))
        hit = np.flatnonzero((rolled & np.uint64((1 << LEAST) - 1)) == 0)
        place.append(i[hit] + (a - lead + 1))
        bits = np.log2(np.maximum(low[hit], 1).astype(np.float64)).astype(np.int64)
        level.append(np.where(low[hit] == 0, 63, bits))
        own = sums - sums[lead]
        scaled = own * inverse[lead] * power
        before.append(total + scaled[i[hit] + 1])
        total = total + scaled[-1:]
        power = power * p[len(block) - lead]
    if not place:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([*place, [len(data)]]), np.concatenate([*level, [64]]), np.concatenate([*before, total])


def unscale(at: np.ndarray) -> np.ndarray:
    """p^-place, for places of any size."""
    inverse = S._powers("i")
    out = inverse[at % S.CHUNK]
    if len(at) and at[-1] >= S.CHUNK:
        steps = np.full(int(at[-1]) // S.CHUNK + 1, inverse[S.CHUNK])
        steps[0] = 1
        far = np.multiply.accumulate(steps)
        out = out * far[at // S.CHUNK]
    return out


def signature(place: np.ndarray, level: np.ndarray, before: np.ndarray, least: int) -> str:
    i = np.flatnonzero(level >= least)
    if len(i) > 1 and place[i[-1]] == place[i[-2]]:
        i = i[:-1]  # the text ended with a piece's end
    ends, sums = place[i], before[i]
    starts = np.concatenate([[0], ends[:-1]])
    pieces = S.mix((sums - np.concatenate([np.zeros(1, np.uint64), sums[:-1]])) * unscale(starts))
    return ALPHABET[(pieces >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(data: bytes) -> str:
    place, level, before = boundaries(data)
    best = max(LEAST, (len(data) // PIECES).bit_length())
    if not len(place):
        return f"{best}::"
    return f"{best}:{signature(place, level, before, best)}:{signature(place, level, before, best + 1)}"


def alike(a: str, b: str) -> float:
    """1 - edit distance over the summed lengths, by the bit-parallel longest common subsequence."""
    if a == b:
        return 1.0
    run = min(RUN, (min(len(a), len(b)) + 1) // 2)
    if not run or not any(a[i : i + run] in b for i in range(len(a) - run + 1)):
        return 0.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = (v + u | v - u) & full
    common = len(a) - v.bit_count()
    return 2 * common / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """Of two fingerprints, from 0 to 1."""
    if x == y:
        return 1.0
    m, a, b = x.split(":")
    n, c, d = y.split(":")
    if m == n:
        return max(alike(a, c), alike(b, d))
    if int(m) == int(n) + 1:
        return alike(a, d)
    return alike(b, c) if int(n) == int(m) + 1 else 0.0


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) and fingerprint. No shuffle."""
    return S.add_columns(docs, text, {"fingerprint": "string"}, lambda: lambda texts: [[fingerprint((t or "").encode("utf-8", "surrogatepass")) for t in texts]], keep)


def edit(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as much of the following text's beginning."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compared_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    spark = docs.sparkSession
    S.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(n)], 20 * n), F.min("doc_id")).first()
    bounds = np.unique(np.array([*(cuts[0] or []), *([cuts[1]] if cuts[1] is not None else [])], np.int64))
    nulls = rows.where("doc_id is null").limit(1).count() > 0

    @S.tidy
    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), S.text_of(b, "text")
            for i, j in S.chunks(texts):
                out: list[tuple] = []
                for d, t in zip(ids[i:j], texts[i:j], strict=True):
                    data = t.encode("utf-8", "surrogatepass")
                    row = (d, len(t), fingerprint(data), pack.compress(data), hashlib.md5(data).digest())
                    at = 0 if d is None else max(0, int(np.searchsorted(bounds, d, "right")) - 1)
                    out.append((at, False, *row))
                    last = max(len(bounds), 1) - 1
                    if d is None or (not nulls and len(bounds) and d == bounds[0]):
                        out.append((last, True, *row))
                    if d is not None and at and d == bounds[at]:
                        out.append((at - 1, True, *row))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["at", "tail", "doc_id", "n_chars", "fingerprint", "packed", "tie"])

    kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]

    @S.tidy
    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        waiting = None  # the row that still lacks its successor
        for b in batches:
            out: list[tuple] = []
            size = 0
            for at, tail, d, n_chars, print_, packed, _ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                row = (at, tail, d, n_chars, print_, unpack.decompress(packed).decode("utf-8", "surrogatepass") if n_chars else "")
                if waiting is not None and waiting[0] == at and not waiting[1]:
                    _, _, own, count, mine, t = waiting
                    edited = edit(t, row[5]).encode("utf-8", "surrogatepass")
                    other = fingerprint(edited)
                    out.append((own, count, hashlib.sha256(edited).hexdigest(), mine, other, likeness(mine, other), likeness(mine, print_)))
                waiting = row
                size += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), done, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    done = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    sent = rows.mapInArrow(first_pass, "at int, tail boolean, doc_id long, n_chars long, fingerprint string, packed binary, tie binary")
    dealt = sent.repartitionById(max(len(bounds), 1), "at").sortWithinPartitions("at", "tail", F.col("doc_id").asc_nulls_first(), "tie")
    return dealt.mapInArrow(second_pass, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
