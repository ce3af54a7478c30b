"""Benchmark decontamination with training suffix arrays.

Every chunk of documents is a shard: its words become ids in the benchmark's vocabulary, and its suffix array sorts the
suffixes whose first words could fill a window at all (a run of benchmark words as long as the shortest window; any
other suffix can match none). Every distinct test suffix is then binary-searched in it, which gives all places of
its window. Each place is extended along its item, which gives the longest verbatim matches of single items, with their places in the text and
in the item. The documents are read once and never shuffled. The benchmark is dealt into blocks of about ``BLOCK_CHARS`` characters, longer
items being cut into pieces that overlap by all but one word of a window; one block at a time is collected and broadcast, so a large
benchmark costs more passes and no more memory. Results of several blocks are joined by document.

Windows are ``WINDOW`` words; an item of fewer words, but not none, is one window. Defined results: null and wordless
texts have no words, hits or items; repeated rows get the same result each; an empty benchmark hits nothing, an empty table of documents gives an
empty one; an item without words has no window; items of one id count once, and those
without an id as one item, which items_sha256 leaves out; columns of the input named like an added one are replaced. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

WINDOW = 10
BLOCK_CHARS = 2_000_000
SHARD = 1 << 17
#: Pairs of places, in a text and in items, that are extended at a time.
PAIRS = 1 << 21
#: An id takes 21 bits, so that three fit into a 64-bit key; the largest id stands for nothing.
_BITS, _TOP = 21, (1 << 21) - 1


class TestSuffixes:
    """The distinct windows of some benchmark items as suffix keys: vocabulary, keys by length, and the items and places of each.

    ``items``: (id, text), or (id, text, place of its first word) for a piece of a longer item.
    """

    def __init__(self, items: list[tuple], window: int):
        self.window = window
        w = S.Words([x[1] or "" for x in items], S.ALNUM)
        self.vocabulary = np.unique(w.hashes)
        self.ids = np.searchsorted(self.vocabulary, w.hashes) + 1
        self.first = w.first  # of each item's words
        self.items = [x[0] for x in items]
        self.offsets = np.array([x[2] if len(x) > 2 else 0 for x in items], np.int64)
        where: dict[tuple, list[int]] = {}
        for k in range(len(items)):
            own = self.ids[w.first[k] : w.first[k + 1]].tolist()
            n = min(window, len(own))
            for j in range(len(own) - n + 1 if n else 0):
                where.setdefault(tuple(own[j : j + n]), []).append(int(w.first[k]) + j)
        self.windows = list(where)
        self.places = np.array([p for v in where.values() for p in v], np.int64)  # of each window in the words of all items
        self.bounds = np.concatenate([[0], np.cumsum([len(v) for v in where.values()])]).astype(np.int64)
        self.of = np.searchsorted(w.first, self.places, "right") - 1  # the item of each place
        self.names = [{self.items[k] for k in self.of[a:b].tolist()} for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True)]
        self.lengths = np.array([len(x) for x in self.windows], np.int64)
        self.shortest = int(self.lengths.min()) if len(self.windows) else 0
        grid = np.zeros((len(self.windows), window), np.int64)
        for k, x in enumerate(self.windows):
            grid[k, : len(x)] = x
        self.low = keys(grid)
        filled = np.where(np.arange(window)[None, :] < self.lengths[:, None], grid, _TOP)
        self.high = keys(filled)


def keys(grid: np.ndarray) -> np.ndarray:
    """Rows of ids as byte strings in the same order."""
    n, width = grid.shape
    cols = -(-width // 3)
    packed = np.zeros((n, cols), np.uint64)
    for j in range(width):
        packed[:, j // 3] |= grid[:, j].astype(np.uint64) << np.uint64(_BITS * (2 - j % 3))
    return np.ascontiguousarray(packed.astype(">u8")).view(f"S{8 * cols}").reshape(-1)


def places(words: S.Words, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """Word positions where a window occurs whole within one text, and the window's number."""
    none = np.zeros(0, np.int64)
    if not len(test.windows) or not len(words.hashes):
        return none, none
    at = np.minimum(np.searchsorted(test.vocabulary, words.hashes), len(test.vocabulary) - 1)
    ids = np.where(test.vocabulary[at] == words.hashes, at + 1, 0)
    seen = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(ids > 0, out=seen[1:])
    n = test.shortest
    end = np.repeat(words.first[1:], np.diff(words.first))  # where the text of each word ends
    start = np.arange(max(0, len(ids) - n + 1))
    start = start[(seen[start + n] - seen[start] == n) & (end[start] >= start + n)]
    if not len(start):
        return none, none
    found = [_search(ids, end, start[k : k + SHARD], test) for k in range(0, len(start), SHARD)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _search(ids: np.ndarray, end: np.ndarray, start: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows begin in one shard of suffixes, and their numbers: its suffix array, binary-searched for every test suffix."""
    offsets = start[:, None] + np.arange(test.window)[None, :]
    grid = np.where(offsets < end[start][:, None], ids[np.minimum(offsets, len(ids) - 1)], 0)
    suffix = keys(grid)
    order = np.argsort(suffix, kind="stable")  # the shard's suffix array
    suffix, start = suffix[order], start[order]
    low = np.searchsorted(suffix, test.low, "left")
    high = np.searchsorted(suffix, test.high, "right")
    hits = np.flatnonzero(high > low)
    counts = high[hits] - low[hits]
    rows = np.repeat(low[hits] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    return start[rows], np.repeat(hits, counts)


def longest(start: np.ndarray, window: np.ndarray, test: TestSuffixes) -> list[tuple]:
    """The longest verbatim matches of single items in one text: (first word, end, first word in the item, item), of each two that overlap whole only the longer.

    ``start``, ``window``: places in the text and the windows there. Places that are the same distance apart in text and item extend one another.
    """
    runs: list[np.ndarray] = []
    of = test.of
    if np.diff(test.bounds)[window].sum() <= PAIRS:
        parts = [(0, len(test.items), False)]
    else:  # some items at a time, so that so many pairs are held at once; an item with more by itself
        times = np.bincount(window, minlength=len(test.windows))
        pairs = np.bincount(of, np.repeat(times, np.diff(test.bounds)), len(test.items)).tolist()
        parts, a, size = [], 0, 0
        for k, n in enumerate(pairs):
            if size + n > PAIRS and k > a:
                parts.append((a, k, size > PAIRS))
                a, size = k, 0
            size += n
        parts.append((a, len(pairs), size > PAIRS))
    for a, b, repeats in parts:
        if repeats:
            runs.append(_by_automaton(start, window, test, a))
            continue
        chosen = np.flatnonzero((of >= a) & (of < b)) if len(parts) > 1 else None
        before = np.searchsorted(chosen, test.bounds) if chosen is not None else test.bounds  # how many of the chosen come before each window's
        own = before[window + 1] - before[window]
        if not own.sum():
            continue
        place = np.repeat(before[window] - np.concatenate([[0], np.cumsum(own)[:-1]]), own) + np.arange(own.sum())
        place = place if chosen is None else chosen[place]
        p, long = np.repeat(start, own), np.repeat(test.lengths[window], own)
        q, item = test.places[place], of[place]
        order = np.lexsort((p, p - q, item))
        p, q, long, item = p[order], q[order], long[order], item[order]
        new = np.concatenate([[True], (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1] + 1) | (item[1:] != item[:-1])])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(p)) - 1
        runs.append(np.stack([p[first], p[last] + long[last], q[first] - test.first[item[first]] + test.offsets[item[first]], item[first]], 1))
    found = np.concatenate(runs).tolist() if runs else []
    return whole([(a, b, q, test.items[k]) for a, b, q, k in found])


def _by_automaton(start: np.ndarray, window: np.ndarray, test: TestSuffixes, item: int) -> np.ndarray:
    """The same runs for an item that repeats itself much, by its suffix automaton: time grows with its length and the text's, not with their product."""
    words = test.ids[test.first[item] : test.first[item + 1]].tolist()
    step: list[dict[int, int]] = [{}]
    link, length, end = [-1], [0], [0]
    last = 0
    for i, w in enumerate(words):
        now = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        end.append(i + 1)
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = now
            p = link[p]
        if p >= 0:
            q = step[p][w]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                end.append(end[q])
                while p >= 0 and step[p].get(w) == q:
                    step[p][w] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    out: list[tuple[int, int, int, int]] = []
    n = min(test.window, len(words))
    text: dict[int, int] = {}
    for s, k in zip(start.tolist(), window.tolist(), strict=True):
        text.update(zip(range(s, s + len(test.windows[k])), test.windows[k], strict=True))
    state = size = 0
    before = -2
    for i in [*sorted(text), None]:
        follows = i is not None and i == before + 1
        w = text.get(i) if i is not None else None
        if size >= n and not (follows and w in step[state]):
            out.append((before + 1 - size, before + 1, end[state] - size, item))
        if i is None:
            break
        if not follows:
            state = size = 0
        while state and w not in step[state]:
            state = link[state]
            size = length[state]
        if w in step[state]:
            state, size = step[state][w], size + 1
        before = i
    found = [(a, b, q + int(test.offsets[item]), k) for a, b, q, k in out]
    return np.array(found, np.int64).reshape(-1, 4)


def whole(found: list[tuple]) -> list[tuple]:
    """The matches that lie in no other; of equal ones the first by item and place."""
    out: list[tuple] = []
    most = -1
    for m in sorted(set(found), key=lambda m: (m[0], -m[1], m[3] or "", m[2])):
        if m[1] > most:
            out.append(m)
            most = m[1]
    return out


def judge(texts: list, test: TestSuffixes, locate: bool = True) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]], list[list[tuple]]]:
    """For each text its number of words, the hit ranges of words, the items hit, and (if asked for) the longest verbatim matches."""
    n_words: list[int] = []
    ranges: list[list[tuple[int, int]]] = []
    items: list[list[str]] = []
    matches: list[list[tuple]] = []
    texts = [t or "" for t in texts]
    for i, j in S.chunks(texts):
        words = S.Words(texts[i:j], S.ALNUM)
        n_words += np.diff(words.first).tolist()
        found: list[list[tuple[int, int]]] = [[] for _ in range(i, j)]
        names: list[set[str]] = [set() for _ in range(i, j)]
        verbatim: list[list[tuple]] = [[] for _ in range(i, j)]
        start, window = places(words, test)
        if len(start):
            whose = np.searchsorted(words.first, start, "right") - 1
            cover = np.zeros(len(words.hashes) + 1, np.int64)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + test.lengths[window], -1)
            hit = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
            hit_words = hit[1:-1]
            edge = hit_words[1:] != hit_words[:-1]
            edge |= np.isin(np.arange(1, len(hit_words)), words.first)  # a range ends with its text
            cuts = np.concatenate([[0], np.flatnonzero(edge) + 1, [len(hit_words)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if hit_words[a]:
                    d = int(np.searchsorted(words.first, a, "right")) - 1
                    found[d].append((a - int(words.first[d]), b - int(words.first[d])))
            for d, k in np.unique(np.stack([whose, window], 1), axis=0).tolist():
                names[d].update(test.names[k])
            if locate:
                order = np.argsort(whose, kind="stable")
                cut = np.searchsorted(whose[order], np.arange(j - i + 1)).tolist()
                for d in np.unique(whose).tolist():
                    own = order[cut[d] : cut[d + 1]]
                    verbatim[d] = longest(start[own] - words.first[d], window[own], test)
        ranges += found
        items += [sorted(x, key=lambda i: (i is not None, i or "")) for x in names]
        matches += verbatim
    return n_words, ranges, items, matches


def pieces(benchmark: DataFrame, item: str, text: str, window: int, most: int) -> DataFrame:
    """(item, text, at) of every distinct item: its text, or one longer than ``most`` bytes in pieces that share all windows; at is the place of a piece's first word."""

    @S.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if len(t) <= most:
                    out.append((name, t, 0))
                    continue
                w = S.Words([t], S.ALNUM)
                i, n = 0, len(w.starts)
                while i < n:
                    j = min(n, max(i + window, int(np.searchsorted(w.ends, w.starts[i] + most, "right"))))
                    out.append((name, w.data[w.starts[i] : w.ends[j - 1]].decode("utf-8", "surrogatepass"), i))
                    i = n if j == n else j - window + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["item", "text", "at"])

    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("text is not null").distinct()
    return rows.mapInArrow(run, "item string, text string, at long")


def blocks(benchmark: DataFrame, item: str, text: str, window: int, block_chars: int) -> Iterator[TestSuffixes]:
    """The benchmark's test suffixes, a block of items at a time."""
    S.bound_batches(benchmark.sparkSession)
    rows = S.materialize(pieces(benchmark, item, text, window, block_chars))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars) or 1
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("item", "text", "at"), F.lit(n)))
    for b in range(n):
        own: list[tuple] = []
        size = 0
        for r in dealt.where(F.col("b") == b).select("item", "text", "at").toLocalIterator():
            if own and size + len(r.text) > max(2 * block_chars, 1000):
                yield TestSuffixes(own, window)
                own, size = [], 0
            own.append((r.item, r.text, r.at))
            size += len(r.text)
        if own or n == 1:
            yield TestSuffixes(own, window)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(i for i in items if i is not None).encode()).hexdigest()


def _finish(n: list[int], ranges: list, items: list, matches: list) -> list[list]:
    n_hit = [sum(b - a for a, b in r) for r in ranges]
    return [n, n_hit, [len(x) for x in items], [digest(x) for x in items], [h > 0 for h in n_hit], [_written(m) for m in matches]]


def _written(matches: list[tuple]) -> list[str]:
    return [f"{a}:{b}:{q}:{'' if name is None else name}" for a, b, q, name in matches]


def _joined(matches: list[str]) -> list[str]:
    """Matches found in several blocks: those of one item that continue one another become one."""
    read = sorted((name, int(a) - int(q), int(a), int(b)) for a, b, q, name in (m.split(":", 3) for m in matches))
    out: list[list] = []
    for name, apart, a, b in read:
        if out and out[-1][:2] == [name, apart] and a < out[-1][3]:
            out[-1][3] = max(out[-1][3], b)
        else:
            out.append([name, apart, a, b])
    return _written(whole([(a, b, a - apart, name) for name, apart, a, b in out]))


ADDED = {"n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean", "matches": "array<string>"}


def report(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", keep: list[str] | None = None, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``keep`` (default: all columns) and what was found: n_words, n_hit, n_items, items_sha256, contaminated, matches (the longest verbatim ones: first word, end, first word in the item, item, joined by colons)."""
    sc = docs.sparkSession.sparkContext
    found = blocks(benchmark, item, item_text, window, block_chars)
    first, second = next(found), next(found, None)
    if second is None:
        only = sc.broadcast(first)
        return S.add_columns(docs, text, ADDED, lambda: lambda texts: _finish(*judge(texts, only.value)), keep)
    # A key for the text, then one pass for each block, of which only documents with hits are kept.
    name, key, had, hit, held = (S.fresh(docs, x) for x in ("whole", "text_key", "hit_ranges", "hit_items", "hit_matches"))
    own = docs.select(*(keep if keep is not None else docs.columns), F.col(f"`{text}`").alias(name)).withColumn(key, F.sha2(F.coalesce(name, F.lit("")), 256))
    hits: list[DataFrame] = []
    for test in chain((first, second), found):
        one = sc.broadcast(test)

        def work(one=one):
            def f(texts: list) -> list[list]:
                n, ranges, items, matches = judge(texts, one.value)
                return [[",".join(f"{a}:{b}" for a, b in r) for r in ranges], items, [_written(m) for m in matches]]

            return f

        raw = {had: "string", hit: "array<string>", held: "array<string>"}
        hits.append(S.materialize(S.add_columns(own.select(key, name), name, raw, work, [key]).where(F.col(had) != "").dropDuplicates([key])))
        one.destroy()
        if len(hits) == 16:  # so that the plan stays small, however many blocks there are
            hits = [S.materialize(reduce(DataFrame.unionByName, hits))]
    lists = reduce(DataFrame.unionByName, hits).groupBy(key)
    merged = lists.agg(F.array_join(F.collect_list(had), ",").alias(had), F.array_distinct(F.flatten(F.collect_list(hit))).alias(hit), F.flatten(F.collect_list(held)).alias(held))
    empty = TestSuffixes([], window)

    @S.tidy
    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ranges, items, matches = (b.column(b.num_columns - k).to_pylist() for k in (4, 3, 2, 1))
            n = judge(texts, empty)[0]
            cover = [union([tuple(map(int, x.split(":"))) for x in r.split(",")]) if r else [] for r in ranges]
            named = [sorted(x or [], key=lambda i: (i is not None, i or "")) for x in items]
            values = _finish(n, cover, named, [[] for _ in n])[:-1] + [[_joined(m or []) for m in matches]]
            cols = [pa.array(x, S.ARROW[t]) for x, t in zip(values, ADDED.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 4)), *cols], names=[*names, *ADDED])

    names = S.without(docs.select(*keep) if keep is not None else docs, ADDED)
    joined = own.join(merged, key, "left").select(*[F.col(f"`{c}`") for c in names], name, had, hit, held)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema[:-4])
    return joined.mapInArrow(last, (kept + ", " if kept else "") + ", ".join(f"{k} {v}" for k, v in ADDED.items()))


def union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with the same columns. One map for each block of the benchmark."""
    sc = docs.sparkSession.sparkContext
    keep, one = S.fresh(docs, "stays"), None
    for test in blocks(benchmark, item, item_text, window, block_chars):
        if one is not None:  # the block before has done its work
            docs = S.materialize(docs)
            one.destroy()
        one = sc.broadcast(test)

        def work(one=one):
            return lambda texts: [[not r for r in judge(texts, one.value, locate=False)[1]]]

        docs = S.add_columns(docs, text, {keep: "boolean"}, work, where=keep)
    return docs
