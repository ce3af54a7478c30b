"""Sequence packing by Karmarkar-Karp multiway differencing.

Every document becomes its token ids and the end id; whole windows of ``WINDOW`` ids are sequences of their own, and
what is left is cut into near-equal pieces of at most ``PIECE`` ids. Each task packs its own pieces, some
``BLOCK`` tokens at a time: the two partial partitions with the largest imbalance are merged, largest bins with smallest,
until one partition into k near-equal windows is left; k starts at the least possible number and rises while a window
exceeds the capacity. Nothing is shuffled; a task holds one block of pieces (not their ids) and one chunk of texts.

Only different units of a chunk (runs of letters, or of other signs; words with apostrophes or rarer letters whole) go
through the tokenizer, a bounded cache of them staying from chunk to chunk.

Defined results: a null or empty text is the end id alone; rows of one id are packed each; an empty table has no
pieces. sequence_id is partition * 2^33 + a running number, offset runs gapless from 0 in every sequence.
"""

from __future__ import annotations

import heapq
import os
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

WINDOW = 2048
SHARE = 0.9
LEAST = 8
BLOCK = 1 << 21
CACHE = 600_000
END = 1
FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


#: Bytes of a unit: 0 white space, 1 letters A-Z, a-z and those of two bytes after C3, 2 other ASCII; 3 the apostrophe and all other bytes.
_CLASS = bytes(0 if b == 0x20 or 9 <= b <= 13 else 1 if chr(b).isascii() and chr(b).isalpha() or b == 0xC3 or 0x80 <= b <= 0xBF else 3 if b == 0x27 or b > 0x7F else 2 for b in range(256))


class Encoder:
    """Token ids of many texts at once, by the tokenizer file at ``path``, for tokenizers that lower-case, drop white space, and keep letters, digits and the rest apart."""

    def __init__(self, path: str, end: int = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        vocabulary = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # hashes of known units, ascending
        self.begin = self.size = np.zeros(0, np.int64)  # where their ids are in flat
        self.flat = np.zeros(0, np.uint32)

    def learn(self, hashes: np.ndarray, units: list[str], plain: np.ndarray) -> None:
        """Adds the ids of new units. Plain ones, of letters only, are one word each to the tokenizer, so many go through it together."""
        sizes = np.zeros(len(units), np.int64)
        found: list[np.ndarray] = []
        for kind in (True, False):
            which = np.flatnonzero(plain == kind)
            if kind:
                lines = [" ".join([units[k] for k in which[i : i + 500].tolist()]) for i in range(0, len(which), 500)]
                ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
                flat = np.concatenate([np.zeros(0, np.uint32), *ids])
                stops = np.flatnonzero(self.word_end[flat]) + 1
                if len(stops) != len(which):  # not such a tokenizer: one by one
                    plain = np.zeros(len(units), bool)
                    continue
                sizes[which] = np.diff(stops, prepend=0)
            else:
                ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([units[k] for k in which.tolist()], add_special_tokens=False)]
                flat = np.concatenate([np.zeros(0, np.uint32), *ids])
                sizes[which] = [len(x) for x in ids]
            found.append((which, flat))
        begins = np.zeros(len(units), np.int64)
        at = len(self.flat)
        for which, flat in found:
            own = sizes[which]
            begins[which] = at + np.cumsum(own) - own
            at += len(flat)
        self.flat = np.concatenate([self.flat, *(f for _, f in found)])
        keys = np.concatenate([self.keys, hashes])
        order = np.argsort(keys)
        self.keys, self.begin, self.size = keys[order], np.concatenate([self.begin, begins])[order], np.concatenate([self.size, sizes])[order]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, the end id after each text, and where each text begins in them."""
        lower = not any("<|" in t for t in texts)  # special tokens stand in a text as they are, and only so
        words = S.Words(texts, S.NOT_SPACE, lower=lower)
        kind = np.frombuffer(words.data.translate(_CLASS), np.uint8)
        view = np.frombuffer(words.data, np.uint8)
        odd = kind == 3
        after = np.flatnonzero(view == 0xC3) + 1
        odd[after] = (view[after] == 0x97) | (view[after] == 0xB7)  # the two signs among the letters
        stray = (view >= 0x80) & (view <= 0xBF)
        stray[after] = False
        odd |= stray
        bad = np.zeros(len(view) + 1, np.int32)
        np.cumsum(odd, out=bad[1:])
        safe = bad[words.ends] == bad[words.starts]
        cut = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
        if not lower:
            cut = cut[:0]
        cut = cut[safe[np.searchsorted(words.starts, cut, "right") - 1]]
        words.cut_at(cut)
        plain = (kind[words.starts] == 1) & (bad[words.ends] == bad[words.starts]) & lower
        unique, at, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE:
            self.forget()
        place = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[place] != unique) if len(self.keys) else np.arange(len(unique))
        if len(new):
            self.learn(unique[new], [words.word(k) for k in at[new].tolist()], plain[at[new]])
        place = np.searchsorted(self.keys, unique)
        begins, sizes = self.begin[place], self.size[place]
        flat = np.concatenate([self.flat, np.array([self.end], np.uint32)])
        begins, sizes = np.append(begins, len(self.flat)), np.append(sizes, 1)
        order = np.insert(inverse, words.first[1:], len(unique))  # the end after each text's units
        counts = sizes[order]
        ends = np.cumsum(counts)
        stream = flat[np.repeat(begins[order] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
        last = words.first[1:] + np.arange(len(texts))
        return stream, np.concatenate([[0], ends[last]])


def pieces(ids: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of a document's pieces: whole windows, then falling shares of the rest."""
    n = len(ids)
    cuts = list(range(0, n - n % window, window))
    at = n - n % window
    while at < n:
        cuts.append(at)
        at = n if n - at <= LEAST else at + int((n - at) * SHARE)
    cuts.append(n)
    raw = ids.astype("<u4").tobytes()
    return [(a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """k near-equal bins of the items by multiway differencing: which items each has."""
    # A partial partition is its non-empty bins, (load, node) ascending; a node is an item or a merged pair of nodes.
    pair: list[tuple[int, int]] = []
    n = len(sizes)
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        over = len(a) + len(b) - k
        if over <= 0:
            if len(b) == 1:
                insort(a, b[0])
            else:
                a = sorted(a + b)
        else:  # the smallest of a take the largest of b; where either has an empty bin, the other's stays alone
            low = a[:over]
            merged = []
            for (x, u), (y, v) in zip(low, reversed(b[len(b) - over :]), strict=True):
                pair.append((u, v))
                merged.append((x + y, n + len(pair) - 1))
            if len(b) == 1:
                a = a[1:]
                insort(a, merged[0])
            else:
                a = sorted(a[over:] + merged + b[: len(b) - over])
        serial += 1
        heapq.heappush(heap, ((a[0][0] if len(a) == k else 0) - a[-1][0], serial, a))
    out = []
    for _, node in heap[0][2] if heap else []:
        items, stack = [], [node]
        while stack:
            u = stack.pop()
            if u < n:
                items.append(u)
            else:
                stack.extend(pair[u - n])
        out.append(items)
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal bins within the capacity: the number rises while one exceeds it."""
    k = -(-sum(sizes) // capacity)
    while True:
        bins = difference(sizes, k)
        worst = max((sum(sizes[i] for i in b) for b in bins), default=0)
        if worst <= capacity:
            return bins
        k += max(1, k * (worst - capacity) // (2 * capacity))


def pack(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, window: int = WINDOW, block: int = BLOCK, with_ids: bool = False) -> DataFrame:
    """One row for each piece: ``keep`` (default: doc_id), start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ``ids`` if asked for.

    ``path`` is the tokenizer's file. Columns of ``keep`` with the name of an added one are replaced.
    """
    S.bound_batches(docs.sparkSession)
    fields = [*FIELDS, ("ids", pa.list_(pa.int64()))] if with_ids else FIELDS
    own = docs.select(*[F.col(f"`{c}`") for c in (["doc_id"] if keep is None else keep)])
    keep, whole_text = S.without(own, [n for n, _ in fields]), S.fresh(own, "whole_text")
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(whole_text))
    held = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.drop(whole_text).schema]
    schema = ", ".join([*held, *(f"{n} {'array<bigint>' if n == 'ids' else 'bigint'}" for n, _ in fields)])

    @S.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        base = TaskContext.get().partitionId() << 33
        serial = 0
        open_: list[tuple] = []  # pieces that wait for windows: (row of the kept columns, piece, doc_tokens, ids)
        tokens = 0
        rows: pa.Table | None = None

        def emit(done: list[tuple], kept: pa.Table) -> pa.RecordBatch:
            cols = list(zip(*done, strict=True))
            taken = kept.take(pa.array(cols[0], pa.int64())).combine_chunks()
            arrays = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in taken.columns]
            return pa.RecordBatch.from_arrays([*arrays, *(pa.array(c, t) for c, (_, t) in zip(cols[1:], fields, strict=True))], names=[*keep, *(n for n, _ in fields)])

        def close() -> pa.RecordBatch:
            nonlocal open_, tokens, serial, rows
            done = []
            for b in windows([p[1][1] for p in open_], window):
                at = 0
                for i in sorted(b):
                    row, (start, length, crc), n, ids = open_[i]
                    done.append((row, start, length, crc, n, base + serial, at, *([ids] if with_ids else [])))
                    at += length
                serial += 1
            kept = rows
            open_, tokens, rows = [], 0, None
            return emit(done, kept)

        for b in batches:
            texts = S.text_of(b, whole_text)
            kept = pa.Table.from_batches([b]).drop_columns([whole_text])
            for i, j in S.chunks(texts, 4 * S.CHUNK):
                stream, begins = encoder.encode(texts[i:j])
                first = 0 if rows is None else rows.num_rows
                rows = kept.slice(i, j - i) if rows is None else pa.concat_tables([rows, kept.slice(i, j - i)])
                whole = []
                for d in range(j - i):
                    ids = stream[begins[d] : begins[d + 1]]
                    for p in pieces(ids, window):
                        own = ids[p[0] : p[0] + p[1]].tolist() if with_ids else None
                        if p[1] == window:
                            whole.append((first + d, *p, len(ids), base + serial, 0, *([own] if with_ids else [])))
                            serial += 1
                        else:
                            open_.append((first + d, p, len(ids), own))
                            tokens += p[1]
                if whole:
                    yield emit(whole, rows)
                if tokens >= block:
                    yield close()
        if open_:
            yield close()

    return source.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The padded-to-be sequences of ``pack(..., with_ids=True)``: sequence_id and its ids in order. At most a window's rows meet in a group."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


def default_tokenizer() -> str:
    """The path of the tokenizer that the registered query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


