"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(ending | class, history) * P(word | ending, class). The ``SINGLES`` most frequent tokens are
classes of their own. Any other word's class follows from its spelling (last character, length, whether it's plain ASCII), and within
the class its ending from a hash of its last three bytes, so unknown words have both. Either softmax sums one
weight row for each active feature of the history: the last word, the last two, the classes of the last two, and the last two frequent words, however far
back (a skip of any length); the second the last word, the word before it (skip) and the last two frequent words, each together with the class.
Features are hashed into fixed rows. Among the words of one class and ending, each has its add-one relative frequency, an unknown word the share of one.

1. Counts of all training tokens: each task counts its own words, then one aggregation by word.
2. Training in ``ROUNDS`` rounds over disjoint folds of the training texts. A fold is dealt by the texts' hash into as many shards as it has
   ``SHARD`` tokens, at every size; for each shard one replica takes AdaGrad steps from the broadcast weights on every position of its texts, in the order of their hash.
   The replicas' changes (rounded to 16 bits), weighted by how often each row was active, are summed by block of rows, ``FAN`` shards at a time,
   then ``FAN`` such sums, until one is left. Neither the partitioning of the input nor the cluster's size changes the model.
3. Scoring is a map in numpy. Words are looked up in a broadcast table of at most ``FREQUENT`` words, the most frequent; the other tokens are
   joined with the full counts by word, summed for each text first, so that no word is hot.

Weights (fixed size) and the frequent words are all that's broadcast. Words are told apart by 64-bit hashes.

Defined results: a null text is empty: one end token. Without any training token N and V are 0 and every token is
unknown. Repeated rows are scored (and learned from) each; an empty table gives an empty one; other columns of the input are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

SINGLES, SHAPES, ENDINGS = 32, 16, 32
CLASSES = SINGLES + SHAPES
FREQUENT = 1 << 20
ROUNDS, STEP = 3, 2048
#: How many tokens a shard has, and how many shards' changes one task adds up for a block of rows.
SHARD, FAN = 1 << 21, 256
RATE = 0.2
END = np.uint64(0x5851F42D4C957F2D)
_N = CLASSES + 1  # class values of a history: one more for before the text
_S = SINGLES + 1
_WORD, _PAIR, _SKIP, _OWN = 13, 13, 12, 14  # bits of hashed rows
#: Where the rows of each feature begin: of the first softmax, then of the second.
_AT = np.cumsum([0, _N * _N, 1 << _WORD, 1 << _PAIR, _S * _S])
_OF = np.cumsum([0, SHAPES * _S * _S, 1 << _OWN, 1 << _SKIP])
WIDTHS = (CLASSES, ENDINGS)
ROWS_ = (int(_AT[-1]), int(_OF[-1]))
BLOCK = 256
#: The kind of a word's last byte: vowel, other letter, digit or beyond ASCII, other.
_LAST = np.array([0 if chr(b) in "aeiou" else 1 if chr(b).isalpha() and b < 128 else 2 if b >= 128 or chr(b).isdigit() else 3 for b in range(256)])


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text; their spelling (class - SINGLES, times ENDINGS, plus ending); and where each text begins."""
    w = S.Words(texts, S.NOT_SPACE)
    view = np.frombuffer(w.data, np.uint8)
    wide = np.zeros(len(view) + 1, np.int32)
    np.cumsum(view >= 128, out=wide[1:])
    n = w.ends - w.starts
    shape = _LAST[view[w.ends - 1]] * 4 + (n > 6) * 2 + (wide[w.ends] > wide[w.starts])
    last = view[w.ends - 1].astype(np.uint64)
    for k in (2, 3):
        last = last * np.uint64(257) + np.where(n >= k, view[np.maximum(w.ends - k, 0)], 0).astype(np.uint64)
    ending = (S.mix(last) >> np.uint64(32)).astype(np.int64) % ENDINGS
    h = np.insert(w.hashes, w.first[1:], END)
    spelling = np.insert(shape * ENDINGS + ending, w.first[1:], SHAPES * ENDINGS - 1)
    return h, spelling, w.first + np.arange(len(w.first))


def count(docs: DataFrame, text: str) -> DataFrame:
    """(h, shape, c) of every distinct token."""

    @S.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def fold() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, kind, c = (np.concatenate(x) for x in zip(*have, strict=True))
            u, at, inverse = np.unique(h, return_index=True, return_inverse=True)
            return u, kind[at], np.bincount(inverse, c, len(u)).astype(np.int64)

        def out(h: np.ndarray, kind: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(h), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + (1 << 17)].view(np.int64)), pa.array(kind[i : i + (1 << 17)].astype(np.int32)), pa.array(c[i : i + (1 << 17)])], names=["h", "shape", "c"])

        for b in batches:
            texts = S.text_of(b, "text")
            for i, j in S.chunks(texts):
                h, kind, _ = tokens(texts[i:j])
                order = np.argsort(h)  # equal tokens are spelt alike, so their order doesn't matter
                own = h[order]
                starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                have.append((own[starts], kind[order[starts]], np.diff(np.append(starts, len(own)))))
                size += len(starts)
                if size > 1 << 21:
                    have = [fold()]
                    size = len(have[0][0])
                    if size > 1 << 20:
                        yield from out(*have[0])
                        have, size = [], 0
        if have:
            yield from out(*fold())

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "h long, shape int, c long")
    return S.materialize(found.groupBy("h").agg(F.min("shape").alias("shape"), F.sum("c").alias("c")))


class Vocabulary:
    """What scoring needs of the counts: totals, the single-word classes, class sizes, and the frequent words."""

    def __init__(self, counts: DataFrame, frequent: int):
        size = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")
        bins = counts.groupBy(size.alias("bin")).agg(F.count("*").alias("words"), F.sum("c").alias("c")).collect()
        self.total, self.distinct = sum(r.c for r in bins), sum(r.words for r in bins)
        room, self.least = frequent, 1 << 30
        for r in sorted(bins, key=lambda r: -r.bin):
            room -= r.words
            if room < 0:
                break
            self.least = r.bin
        table = counts.where(size >= self.least).select("h", "c").toArrow()  # at most `frequent` rows
        h, c = table["h"].to_numpy().view(np.uint64), table["c"].to_numpy()
        order = np.argsort(h)
        self.h, self.c = h[order], c[order]
        tops = counts.orderBy(F.desc("c"), "h").limit(SINGLES).collect()
        top = sorted(((r.h & 0xFFFFFFFFFFFFFFFF, r.c) for r in tops))
        self.tops = np.array([x for x, _ in top], np.uint64)
        self.single = np.array([n for _, n in top], float)
        self.sizes = np.zeros(SHAPES * ENDINGS)  # tokens of each class and ending, and distinct words
        self.words = np.zeros(SHAPES * ENDINGS)
        rest = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(r.h,) for r in tops], "h long")), "h", "left_anti")
        for r in rest.groupBy("shape").agg(F.sum("c").alias("c"), F.count("*").alias("words")).collect():
            self.sizes[r["shape"]], self.words[r["shape"]] = r.c, r.words

    def classes(self, h: np.ndarray, spelling: np.ndarray) -> np.ndarray:
        by_spelling = SINGLES + spelling // ENDINGS
        if not len(self.tops):
            return by_spelling
        at = np.minimum(np.searchsorted(self.tops, h), len(self.tops) - 1)
        return np.where(self.tops[at] == h, at, by_spelling)

    def priors(self) -> tuple[np.ndarray, np.ndarray]:
        """Log shares of the classes, and of the endings within each class by spelling."""
        by_shape = self.sizes.reshape(SHAPES, ENDINGS)
        n = np.concatenate([self.single, np.zeros(SINGLES - len(self.single)), by_shape.sum(1)]) + 1
        return np.log(n / n.sum()).astype(np.float32), np.log((by_shape + 1) / (by_shape + 1).sum(1, keepdims=True)).astype(np.float32)


class Histories:
    """The active rows of both softmaxes for the tokens of some texts, computed for a range of places at a time."""

    def __init__(self, h: np.ndarray, spelling: np.ndarray, kind: np.ndarray, begins: np.ndarray):
        self.h, self.spelling, self.kind, self.begins = h, spelling, kind, begins
        n = len(h)
        self.single = np.maximum.accumulate(np.where(kind < SINGLES, np.arange(n), -1)) if n else np.zeros(0, np.int64)  # the last frequent word up to a place

    def frequent(self, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of the last frequent word before the places ``at``, and where it is."""
        i = np.where(at > first, self.single[np.maximum(at - 1, 0)], -1)
        there = i >= first
        return np.where(there, self.kind[np.maximum(i, 0)], SINGLES), np.where(there, i, first)

    def __call__(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the places a to b: rows of the first softmax (4, n), the classes, rows of the second (3, m) and the spellings, these two of the words that are no class of their own."""
        at = np.arange(a, b)
        first = self.begins[np.searchsorted(self.begins, at, "right") - 1]
        prev = []
        for k in (1, 2):
            there = at - k >= first
            i = np.maximum(at - k, 0)
            prev.append((np.where(there, self.kind[i], CLASSES), np.where(there, self.h[i], np.uint64(k))))
        (c1, w1), (c2, w2) = prev
        s1, i = self.frequent(at, first)
        s2, _ = self.frequent(i, first)
        top = lambda h, bits: (h >> np.uint64(64 - bits)).astype(np.int64)
        both = s1 * _S + s2
        rows = np.stack([c1 * _N + c2, _AT[1] + top(w1, _WORD), _AT[2] + top(S.mix(w1 * np.uint64(3) + w2), _PAIR), _AT[3] + both]).astype(np.uint16)
        kind = self.kind[a:b]
        rest = np.flatnonzero(kind >= SINGLES)
        spelling = self.spelling[a:b][rest]
        shape = spelling // ENDINGS
        own = lambda w, k: w[rest] * np.uint64(5) + (shape * 4 + k).astype(np.uint64)
        more = np.stack([shape * _S * _S + both[rest], _OF[1] + top(S.mix(own(w1, 1)), _OWN), _OF[2] + top(S.mix(own(w2, 2)), _SKIP)]).astype(np.uint16)
        return rows, kind, more, spelling


def logits(weights: np.ndarray, prior: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Summed weight rows, with the log prior: one row for each column of ``rows``."""
    z = weights.take(rows[0], 0)
    for k in range(1, len(rows)):
        z += weights.take(rows[k], 0)
    z += prior
    return z


def in_range(z: np.ndarray) -> None:
    """Takes each row's maximum off where exponentials could leave the range of single precision, which is hardly ever."""
    if z.size and (z.max() > 80 or z.min() < -80):
        z -= z.max(1, keepdims=True)


def log_softmax(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The natural log-probability of one column of each row."""
    in_range(z)
    own = z[np.arange(len(at)), at]
    np.exp(z, out=z)
    return own - np.log(np.einsum("ij->i", z))


def group_sums(z: np.ndarray, order: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the rows ``order`` of z by runs, which begin at ``starts`` and have n rows. Many short runs are added a row of each at a time."""
    if len(starts) * 3 < len(order):
        return np.add.reduceat(z.take(order, 0), starts, axis=0)
    g = z.take(order.take(starts), 0)
    long = np.flatnonzero(n > 8)
    if len(long):
        ends = np.cumsum(n[long])
        first = ends - n[long]
        at = np.repeat(starts[long] - first, n[long]) + np.arange(ends[-1])
        g[long] = np.add.reduceat(z.take(order.take(at), 0), first, axis=0)
    more, k = np.flatnonzero((n > 1) & (n <= 8)), 1
    while len(more):
        g[more] += z.take(order.take(starts[more] + k), 0)
        k += 1
        more = more[n[more] > k]
    return g


class Learner:
    """One softmax in training: weights and AdaGrad's sums of squares by row, and how often each row was active."""

    def __init__(self, weights: np.ndarray):
        self.start, self.w = weights, weights.copy()
        self.squares = np.full(len(weights), 1e-6, np.float32)
        self.seen = np.zeros(len(weights), np.int64)

    def step(self, rows: np.ndarray, prior: np.ndarray, target: np.ndarray) -> None:
        z = logits(self.w, prior, rows)
        in_range(z)
        np.exp(z, out=z)
        z /= np.einsum("ij->i", z)[:, None]
        z[np.arange(len(target)), target] -= 1
        flat = rows.reshape(-1)  # the features' rows are disjoint
        order = np.argsort(flat, kind="stable")
        own = flat[order]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        n = np.diff(np.append(starts, len(own)))
        row = own[starts]
        g = group_sums(z, np.tile(np.arange(len(target)), len(rows))[order], starts, n)
        squares = self.squares[row] + np.einsum("ij,ij->i", g, g) / z.shape[1] + np.float32(1e-3)
        self.squares[row] = squares
        g *= (np.float32(RATE / len(rows) ** 0.5) / np.sqrt(squares))[:, None]
        self.w[row] = np.subtract(self.w.take(row, 0), g, out=g)
        self.seen[row] += n

    def changes(self, table: int, shard: int) -> Iterator[tuple]:
        """(table, block, shard, places, changes, counts) of the active rows."""
        for k in range(0, len(self.w), BLOCK):
            at = np.flatnonzero(self.seen[k : k + BLOCK]).astype(np.int32)
            if len(at):
                yield table, k // BLOCK, shard, at.tobytes(), (self.w[k : k + BLOCK][at] - self.start[k : k + BLOCK][at]).astype(np.float16).tobytes(), self.seen[k : k + BLOCK][at].tobytes()


_CHANGES = "tab int, block int, shard int, at binary, val binary, seen binary"


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _add(changes: DataFrame, kind: type) -> DataFrame:
    """The changes of ``FAN`` shards by block of rows, each row's weighted by how often it was active, as one shard's; ``kind`` is the numbers' type that comes in, float32 goes out."""
    fan = FAN

    @S.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, seen = None, np.zeros(0), np.zeros(0, np.int64)

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None:
                i = np.flatnonzero(seen).astype(np.int32)
                yield _batch([(*now, i.tobytes(), (total[i] / seen[i][:, None]).astype(np.float32).tobytes(), seen[i].tobytes())], _CHANGES)

        for b in batches:
            for table, block, shard, at, val, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (table, block, shard // fan) != now:
                    yield from done()
                    now, total, seen = (table, block, shard // fan), np.zeros((BLOCK, WIDTHS[table])), np.zeros(BLOCK, np.int64)
                i, n = np.frombuffer(at, np.int32), np.frombuffer(n, np.int64)
                total[i] += np.frombuffer(val, kind).reshape(len(i), -1).astype(float) * n[:, None]
                seen[i] += n
        yield from done()

    group = F.expr(f"shard div {fan}")
    return changes.repartition("tab", "block", group).sortWithinPartitions("tab", "block", "shard").mapInArrow(run, _CHANGES)


def train_round(docs: DataFrame, vocabulary, weights, fold: int, shards: int) -> list[np.ndarray]:
    """Both softmaxes' weights after one more round, on the texts of one fold. ``docs``: text, fold, shard, place (the text's hash). ``vocabulary`` and ``weights`` are broadcasts."""

    @S.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        prior, priors = v.priors()
        shard, learners = -1, []
        waiting: list[tuple] = []
        places = 0

        def steps(least: int) -> None:
            nonlocal waiting, places
            if places < max(least, 1):
                return
            rows, kind, more, spelling = (np.concatenate([x[i] for x in waiting], axis=-1) for i in range(4))
            after = np.concatenate([[0], np.cumsum(kind >= SINGLES)])  # how many of the second softmax's come before a place
            full = places - places % STEP if least > 1 else places
            for k in range(0, full, STEP):
                j = min(k + STEP, full)
                learners[0].step(rows[:, k:j], prior, kind[k:j])
                a, b = after[k], after[j]
                if b > a:
                    learners[1].step(more[:, a:b], priors[spelling[a:b] // ENDINGS], spelling[a:b] % ENDINGS)
            a = after[full]
            waiting, places = [(rows[:, full:], kind[full:], more[:, a:], spelling[a:])], places - full

        def close() -> Iterator[pa.RecordBatch]:
            steps(1)
            for table, learner in enumerate(learners):
                for r in learner.changes(table, shard):
                    yield _batch([r], _CHANGES)

        for b in batches:
            texts, own = S.text_of(b, "text"), b.column(1).to_pylist()
            cuts = [k for k in range(1, len(own)) if own[k] != own[k - 1]]
            for x, y in zip([0, *cuts], [*cuts, len(own)], strict=True):
                if x < y and own[x] != shard:
                    yield from close()
                    shard, learners, waiting, places = own[x], [Learner(w) for w in weights.value], [], 0
                for i, j in S.chunks(texts[x:y]):
                    h, spelling, begins = tokens(texts[x + i : x + j])
                    history = Histories(h, spelling, v.classes(h, spelling), begins)
                    for first in range(0, len(h), 16 * STEP):  # a long text's histories a part at a time
                        last = min(first + 16 * STEP, len(h))
                        waiting.append(history(first, last))
                        places += last - first
                        steps(STEP)
        yield from close()

    own = docs.where(F.col("fold") == fold).select("text", "shard", "place").repartitionById(shards, "shard").sortWithinPartitions("shard", "place").select("text", "shard")
    summed, left, kind = own.mapInArrow(run, _CHANGES), shards, np.float16
    while left > 1 or kind == np.float16:
        summed, left, kind = _add(summed, kind), -(-left // FAN), np.float32
    out = [w.copy() for w in weights.value]
    for r in summed.collect():  # a fixed number of blocks
        i = np.frombuffer(r.at, np.int32)
        out[r.tab][r.block * BLOCK + i] += np.frombuffer(r.val, np.float32).reshape(len(i), -1)
    return out


def shards_for(tokens: int, size: int) -> int:
    """How many shards of ``size`` tokens each round's part of all tokens makes."""
    return max(1, tokens // (ROUNDS * size))


def fit(learn: DataFrame, frequent: int = FREQUENT) -> tuple[DataFrame, object, object]:
    """The counts of all tokens of the texts (column text), and as broadcasts the vocabulary and the two softmaxes' weights."""
    counts = count(learn, "text")
    sc = learn.sparkSession.sparkContext
    v = Vocabulary(counts, frequent)
    sent = sc.broadcast(v)
    shards = shards_for(v.total, SHARD)
    place = F.xxhash64(F.coalesce("text", F.lit("")))
    dealt = learn.select("text", place.alias("place"), F.pmod(place, F.lit(ROUNDS)).alias("fold"), F.pmod(F.xxhash64(place), F.lit(shards)).cast("int").alias("shard"))
    weights = sc.broadcast([np.zeros((n, k), np.float32) for n, k in zip(ROWS_, WIDTHS, strict=True)])
    for fold in range(ROUNDS):
        new = train_round(dealt, sent, weights, fold, shards)
        weights.unpersist()
        weights = sc.broadcast(new)
    return counts, sent, weights


def score(docs: DataFrame, training, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row. ``training``: a condition for the rows to learn from; null counts as no."""
    S.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (~F.coalesce(training, F.lit(False))).alias("held_out"))
    counts, sent, model = fit(rows.where("not held_out").select("text"), frequent)
    v = sent.value

    @S.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = sent.value, model.value
        prior, priors = v.priors()
        floor = -np.log10(v.total + v.distinct + 1)
        within = -np.log10(v.sizes + v.words + 1)
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            texts = S.text_of(b, "text")
            keep = [b.column(0), b.column(2)]
            n, known, base, total, rest = [], [], [], [], []
            for i, j in S.chunks(texts):
                h, spelling, begins = tokens(texts[i:j])
                kind = v.classes(h, spelling)
                history = Histories(h, spelling, kind, begins)
                logp = np.empty(len(h))
                for first in range(0, len(h), 16 * STEP):
                    rows_, kinds, more, own = history(first, min(first + 16 * STEP, len(h)))
                    after = np.concatenate([[0], np.cumsum(kinds >= SINGLES)])
                    for k in range(0, len(kinds), STEP):
                        last = min(k + STEP, len(kinds))
                        part = log_softmax(logits(w[0], prior, rows_[:, k:last]), kinds[k:last]).astype(float)
                        x, y = after[k], after[last]
                        if y > x:
                            part[kinds[k:last] >= SINGLES] += log_softmax(logits(w[1], priors[own[x:y] // ENDINGS], more[:, x:y]), own[x:y] % ENDINGS)
                        logp[first + k : first + last] = part * 0.4342944819032518
                if len(v.h):
                    each, whose = np.unique(h, return_inverse=True)  # in order, so that the large table is read in order
                    at = np.minimum(np.searchsorted(v.h, each), len(v.h) - 1)
                    known_ = v.h[at] == each
                    there = known_[whose]
                    log_c = np.where(known_, np.log10(v.c[at] + 1.0), 0.0)[whose]
                else:
                    there, log_c = np.zeros(len(h), bool), np.zeros(len(h))
                logp += np.where(kind < SINGLES, 0.0, within[spelling] + log_c)
                n += np.diff(begins).tolist()
                known += np.add.reduceat(there.astype(np.int64), begins[:-1]).tolist()
                base += (np.add.reduceat(log_c, begins[:-1]) + floor * np.diff(begins)).tolist()
                total += np.add.reduceat(logp, begins[:-1]).tolist()
                for x, y in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                    rest.append(h[x:y][~there[x:y]].view(np.int64))
            ids = np.arange(row, row + len(texts))
            row += len(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids), *keep, pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(total, pa.float64()), pa.array(rest, pa.list_(pa.int64()))], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rest"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    first = S.materialize(rows.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rest array<bigint>"))
    rare = counts.where(F.floor(F.log2(F.col("c").cast("double")) * 8) < v.least).select("h", "c")
    tail = first.select("row", F.explode("rest").alias("h")).groupBy("row", "h").agg(F.count("*").alias("tf")).join(rare, "h")
    own = F.col("tf") * F.log10(F.col("c") + 1.0)
    alone = F.col("h").isin(v.tops.view(np.int64).tolist())  # a class of its own: nothing to add within it
    more = tail.groupBy("row").agg(F.sum("tf").alias("tf"), F.sum(own).alias("more"), F.sum(F.when(~alone, own)).alias("within"))
    add, within = F.coalesce("more", F.lit(0.0)), F.coalesce("within", F.lit(0.0))
    return first.drop("rest").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tf", F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"), (F.col("base_score") + add).alias("base_score"), (F.col("score") + within).alias("score")
    )
