"""Gradient boosting that MLlib lacks: several classes by softmax, pairs within groups, early stopping, and many models (folds) fitted in the same passes.

Features are binned (nulls have a bin of their own), a row keeps its bins and every model's scores. A pass over the rows gives, for each model, class, node, feature and bin, the sums of gradients and second derivatives; these are
summed and searched for the best splits in Spark, and one row a node comes to the driver. A round grows one tree for each model and class, a level a pass. Rows are staged with their scores every ``KEPT`` rounds, so neither a lost executor nor the number of rounds makes work pile up.

Objectives:

* ``softmax``: ``classes`` classes, a regression tree for each on the residuals of the softmax; ``binary``: the same for one logit.
* ``pairwise``: every positive of a group should score above every negative: the exponential loss of all such pairs, which is a product of two sums over the group, so its gradients take no pair list and a group may hold any number of rows. Groups count by their
  rows, and fall into one fold whole.

Gradients and losses are summed as whole numbers (``SCALE`` to 1), bins come from rows with the smallest hashes of their ids: the models are the same however the rows are partitioned. A model that watches other folds takes the number of rounds after which its loss on them
was least, and its fit ends ``patience`` rounds later.

Memory: a task holds models x classes x nodes x features x bins sums, none of which grows with the rows; the edges come from at most ``SAMPLE`` rows. A null label is taken as 0, a null weight as 1, a null group as a group of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dyadlake.sources import files

BINS = 32
SAMPLE = 20_000
SCALE = float(1 << 20)
KEPT = 5
#: Ridge on a leaf's second derivatives, and the least of them on either side of a split.
RIDGE, LEAST = 1.0, 1.0
#: Groups up to this number are broadcast with their sums, further ones are joined.
SMALL = 100_000


@dataclass
class Fit:
    """One model: the folds whose rows it learns from and, if it stops early, those it watches. ``rounds`` is how many of its rounds count."""

    learns: frozenset[int]
    watches: frozenset[int] = frozenset()
    rounds: int | None = None
    losses: list[float] = field(default_factory=list)
    trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = field(default_factory=list)


@dataclass
class Boosted:
    """Fitted models over the same features."""

    features: list[str]
    edges: list[np.ndarray]
    objective: str
    classes: int
    fits: list[Fit]


def bin_edges(df: DataFrame, features: Sequence[str], key: str, bins: int = BINS) -> list[np.ndarray]:
    """Where each feature's bins end: distinct quantiles of the ``SAMPLE`` rows with the smallest hashes of ``key``."""
    rows = df.select(F.xxhash64(key).alias("h"), *[F.col(f).cast("double").alias(f"v{i}") for i, f in enumerate(features)]).orderBy("h", *[f"v{i}" for i in range(len(features))]).limit(SAMPLE).drop("h")
    sample = rows.toPandas()
    out = []
    for i in range(len(features)):
        v = sample[f"v{i}"].to_numpy(float)
        v = v[np.isfinite(v)]
        out.append(np.unique(np.quantile(v, np.arange(1, bins - 1) / (bins - 1), method="lower")) if len(v) else np.zeros(0))
    return out


def _codes(columns: list[pa.ChunkedArray], edges: list[np.ndarray]) -> np.ndarray:
    """Rows x features: 0 for null or not a number, else one more than the edges below."""
    out = np.zeros((len(columns[0]) if columns else 0, len(edges)), np.uint8)
    for i, (c, e) in enumerate(zip(columns, edges, strict=True)):
        v = np.asarray(c.to_numpy(zero_copy_only=False), float)
        out[:, i] = np.where(np.isnan(v), 0, 1 + np.searchsorted(e, v, side="left"))
    return out


def _leaves(tree: tuple[np.ndarray, np.ndarray, np.ndarray], codes: np.ndarray) -> np.ndarray:
    """The node of the tree that each row ends in, so far as it is grown."""
    feature, cut, _ = tree
    node = np.zeros(len(codes), np.int64)
    while True:
        f = feature[node]
        inner = np.flatnonzero(f >= 0)
        if not len(inner):
            return node
        node[inner] = 2 * node[inner] + 1 + (codes[inner, f[inner]] > cut[node[inner]])


def _added(scores: np.ndarray, codes: np.ndarray, rounds: list[list[list]]) -> np.ndarray:
    """``scores`` (rows x models x classes) and the values of some rounds' trees (round, model, class)."""
    for each in rounds:
        for m, classes in enumerate(each):
            for k, tree in enumerate(classes):
                scores[:, m, k] += tree[2][_leaves(tree, codes)]
    return scores


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _logistic(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _slopes(objective: str, s: np.ndarray, y: np.ndarray, sums: np.ndarray | None, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients, second derivatives (rows x models x classes) and losses (rows x models). ``sums``: rows x models x 2, ``n``: the positives and negatives of the row's group."""
    if objective == "softmax":
        p = _softmax(s)
        hit = (np.arange(s.shape[2]) == y[:, None])[:, None, :]
        return p - hit, p * (1 - p), -np.log(np.maximum((p * hit).sum(2), 1e-12))
    if objective == "binary":
        p = _logistic(s)
        t = y[:, None, None]
        return p - t, p * (1 - p), -np.log(np.maximum(np.where(t > 0, p, 1 - p)[:, :, 0], 1e-12))
    positive = y > 0
    own = np.exp(np.clip(np.where(positive[:, None], -s[:, :, 0], s[:, :, 0]), -15, 15))
    other = np.where(positive[:, None], sums[:, :, 1], sums[:, :, 0])
    pairs = np.maximum(n[:, 0] * n[:, 1], 1)
    each = own * other / pairs[:, None] * (n.sum(1) / 2)[:, None] * (n.min(1) > 0)[:, None]
    return np.where(positive[:, None], -each, each)[:, :, None], each[:, :, None], each


def _arrays(b: pa.RecordBatch, models: int, classes: int, features: int) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(b.column(b.schema.get_field_index("codes")).to_pylist()), np.uint8).reshape(-1, features)
    scores = np.frombuffer(b"".join(b.column(b.schema.get_field_index("scores")).to_pylist()), np.float64).reshape(-1, models, classes).copy()
    return codes, scores


def _numbers(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


class _Fitting:
    """The rows of some fits while they go on."""

    def __init__(self, model: Boosted, depth: int, rate: float):
        self.model, self.depth, self.rate = model, depth, rate
        self.m, self.k, self.f = len(model.fits), model.classes, len(model.features)
        self.since: list[list[list]] = []  # rounds grown since the rows were staged

    def prepare(self, df: DataFrame, fold: str, label: str, weight: str | None, group: str | None) -> None:
        edges, cells = self.model.edges, self.m * self.k
        keys = [F.coalesce(F.col(fold).cast("int"), F.lit(-1)).alias("fold"), F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("label"), (F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)).alias("weight")]
        keys += [F.xxhash64(F.col(group), F.lit(1)).alias("g1"), F.xxhash64(F.col(group), F.lit(2)).alias("g2")] if group else []
        n = len(keys)

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes = _codes([b.column(i) for i in range(n, b.num_columns)], edges)
                bytes_ = pa.array([r.tobytes() for r in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), bytes_, pa.array([bytes(8 * cells)] * len(codes), pa.binary())], names=[*b.schema.names[:n], "codes", "scores"])

        schema = "fold int, label double, weight double," + ("g1 bigint, g2 bigint," if group else "") + "codes binary, scores binary"
        rows = df.select(*keys, *[F.col(c).cast("double") for c in self.model.features]).mapInArrow(code, schema)
        if group:
            sizes = rows.groupBy("g1", "g2").agg(F.sum((F.col("label") > 0).cast("double")).alias("pos"), F.sum((F.col("label") <= 0).cast("double")).alias("neg"))
            self.small = sizes.count() <= SMALL
            rows = rows.join(F.broadcast(sizes) if self.small else sizes, ["g1", "g2"])
        self.rows = files.stage(rows)

    def sums(self) -> DataFrame | None:
        """Of every group and model: the positives' exp(-score) and the negatives' exp(score), as whole numbers."""
        if self.model.objective != "pairwise":
            return None
        since, m, k, f = self.since, self.m, self.k, self.f

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes, scores = _arrays(b, m, k, f)
                s = _added(scores, codes, since)[:, :, 0]
                y = _numbers(b, "label") > 0
                e = np.rint(np.exp(np.clip(np.where(y[:, None], -s, s), -15, 15)) * SCALE)
                both = np.stack([np.where(y[:, None], e, 0), np.where(y[:, None], 0, e)], 2).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in ("g1", "g2")] + [pa.array(both[:, i, j]) for i in range(m) for j in (0, 1)], names=["g1", "g2", *(f"s{i}_{j}" for i in range(m) for j in (0, 1))])

        names = [f"s{i}_{j}" for i in range(m) for j in (0, 1)]
        each = self.rows.select("g1", "g2", "label", "codes", "scores").mapInArrow(add, "g1 bigint, g2 bigint," + ",".join(f"{c} bigint" for c in names))
        return files.stage(each.groupBy("g1", "g2").agg(*[F.sum(c).alias(c) for c in names]))

    def level(self, trees: list[list], nodes: list[int], sums: DataFrame | None, losses: bool) -> DataFrame:
        """(model, node, feature, bin, g, h): the sums of a level, ``model`` numbering models and classes. Node -1 holds the losses on watched folds and their rows."""
        model, m, k, f, since = self.model, self.m, self.k, self.f, self.since
        first, width = min(nodes), max(nodes) - min(nodes) + 1
        bins, objective, paired = max((len(e) for e in model.edges), default=0) + 2, model.objective, sums is not None
        learns = [sorted(x.learns) for x in model.fits]
        watches = [sorted(x.watches) for x in model.fits]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            have = np.zeros((m * k, width, f, bins, 2), np.int64)
            lost = np.zeros((m, 2), np.int64)
            for b in batches:
                codes, scores = _arrays(b, m, k, f)
                scores = _added(scores, codes, since)
                fold, y, w = _numbers(b, "fold"), _numbers(b, "label"), _numbers(b, "weight")
                own = of = None
                if paired:
                    own = np.stack([_numbers(b, f"s{i}_{j}") for i in range(m) for j in (0, 1)], 1).reshape(-1, m, 2) / SCALE
                    of = np.stack([_numbers(b, "pos"), _numbers(b, "neg")], 1)
                g, h, loss = _slopes(objective, scores, y, own, of)
                g, h = np.rint(g * w[:, None, None] * SCALE), np.rint(h * w[:, None, None] * SCALE)
                for i in range(m):
                    if losses and watches[i]:
                        seen = np.isin(fold, watches[i])
                        lost[i] += [int(np.rint(loss[seen, i] * SCALE).sum()), int(seen.sum())]
                    rows = np.flatnonzero(np.isin(fold, learns[i]))
                    for c in range(k):
                        node = _leaves(trees[i][c], codes[rows]) - first
                        here = rows[(node >= 0) & (node < width)]
                        node = node[(node >= 0) & (node < width)]
                        for x in range(f):
                            at = node * bins + codes[here, x]
                            for z, v in enumerate((g, h)):
                                have[i * k + c, :, x, :, z] += np.bincount(at, v[here, i, c], width * bins).astype(np.int64).reshape(width, bins)
            at = np.argwhere(have[..., 1] > 0)
            out = [pa.array(at[:, 0].astype(np.int32)), pa.array((at[:, 1] + first).astype(np.int32)), pa.array(at[:, 2].astype(np.int32)), pa.array(at[:, 3].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*out, *(pa.array(have[(*at.T, z)]) for z in (0, 1))], names=["model", "node", "feature", "bin", "g", "h"])
            i = np.flatnonzero(lost[:, 1])
            none = pa.array(np.full(len(i), -1, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), none, none, none, pa.array(lost[i, 0]), pa.array(lost[i, 1])], names=["model", "node", "feature", "bin", "g", "h"])

        rows = self.rows if sums is None else self.rows.join(F.broadcast(sums) if self.small else sums, ["g1", "g2"])
        each = rows.mapInArrow(add, "model int, node int, feature int, bin int, g bigint, h bigint")
        return each.groupBy("model", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))

    def splits(self, found: DataFrame) -> tuple[dict, dict]:
        """The best split of every (model, node), by gain, then feature and bin; and the losses of the models that watch."""
        own = Window.partitionBy("model", "node", "feature")
        run = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        x = found.withColumns({"gl": F.sum("g").over(run) / SCALE, "hl": F.sum("h").over(run) / SCALE, "gt": F.sum("g").over(own) / SCALE, "ht": F.sum("h").over(own) / SCALE})
        part = lambda g, h: g * g / (h + RIDGE)
        gr, hr = F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")
        gain = F.when((F.col("hl") >= LEAST) & (hr >= LEAST), part(F.col("gl"), F.col("hl")) + part(gr, hr) - part(F.col("gt"), F.col("ht"))).otherwise(0.0)
        best = F.max(F.struct(F.round(gain, 9).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "gl", "hl", "gt", "ht"))
        rows = x.groupBy("model", "node").agg(best.alias("s")).select("model", "node", "s.*").collect()  # one row a model and node
        return {(r.model, r.node): r for r in rows if r.node >= 0}, {r.model: r.gt * SCALE / max(r.ht * SCALE, 1) / SCALE for r in rows if r.node < 0}

    def round(self) -> dict[int, float]:
        """Grows one tree for each model and class; the losses before it."""
        size = 2 ** (self.depth + 1) - 1
        trees = [[(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)) for _ in range(self.k)] for _ in range(self.m)]
        value = lambda g, h: -self.rate * g / (h + RIDGE)
        sums, losses = self.sums(), {}
        for d in range(self.depth):
            nodes = list(range(2**d - 1, 2 ** (d + 1) - 1))
            best, lost = self.splits(self.level(trees, nodes, sums, d == 0))
            losses = losses or lost
            for (mk, node), s in best.items():
                feature, cut, values = trees[mk // self.k][mk % self.k]
                if node == 0:
                    values[0] = value(s.gt, s.ht)
                if s.gain > 1e-6:
                    feature[node], cut[node] = -s.f, -s.b
                    values[2 * node + 1], values[2 * node + 2] = value(s.gl, s.hl), value(s.gt - s.gl, s.ht - s.hl)
        self.since.append(trees)
        for i, one in enumerate(self.model.fits):
            one.trees.append(trees[i])
        return losses

    def keep(self) -> None:
        """Stages the rows with their scores so far."""
        since, m, k, f = self.since, self.m, self.k, self.f

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes, scores = _arrays(b, m, k, f)
                scores = _added(scores, codes, since)
                yield b.set_column(b.schema.get_field_index("scores"), "scores", pa.array([r.tobytes() for r in scores], pa.binary()))

        self.rows, self.since = files.stage(self.rows.mapInArrow(add, self.rows.schema)), []


def fit(df: DataFrame, features: Sequence[str], fits: Sequence[Fit], key: str, fold: str = "fold", label: str = "label", objective: str = "binary", classes: int = 1, group: str | None = None, weight: str | None = None, rounds: int = 20, depth: int = 3, rate: float = 0.3, patience: int = 3) -> Boosted:
    """Models of ``label`` (0 and 1, or the class's number), one for each of ``fits``, grown together. Those that watch folds stop by their loss there; the others take ``rounds``, or their own. ``key`` identifies rows, for the sample that bins come from."""
    if objective not in ("softmax", "binary", "pairwise") or (objective == "pairwise") != (group is not None):
        raise ValueError("objective: softmax, binary, or pairwise with a group")
    model = Boosted(list(features), bin_edges(df, features, key), objective, classes if objective == "softmax" else 1, list(fits))
    work = _Fitting(model, depth, rate)
    work.prepare(df, fold, label, weight, group)
    most = max((f.rounds or rounds) for f in model.fits)
    for r in range(most):
        for i, loss in work.round().items():
            model.fits[i].losses.append(loss)
        watching = [f for f in model.fits if f.watches]
        if len(watching) == len(model.fits) and all(r - int(np.argmin(f.losses)) >= patience for f in watching if f.losses):
            break
        if (r + 1) % KEPT == 0:
            work.keep()
    for f in model.fits:
        f.rounds = int(np.argmin(f.losses)) if f.watches and f.losses else min(f.rounds or rounds, len(f.trees))
    return model


def score(df: DataFrame, model: Boosted, by: dict[int, int], fold: str = "fold", name: str = "p") -> DataFrame:
    """``df`` with ``name``: the score of the model (its number in ``fits``) that ``by`` names for the row's fold; null for other folds. An array of class probabilities for softmax, a probability for binary, a score to rank by for pairwise."""
    kept = [c for c in df.columns if c.lower() != name.lower()]
    n, edges, objective, k = len(kept), model.edges, model.objective, model.classes
    trees = {i: [[t] for t in model.fits[i].trees[: model.fits[i].rounds]] for i in set(by.values())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, folds = _codes([b.column(i) for i in range(n + 1, b.num_columns)], edges), b.column(n).to_pylist()
            found: list = [None] * len(folds)
            for i, own in trees.items():
                at = [j for j, f in enumerate(folds) if by.get(f) == i]
                s = _added(np.zeros((len(at), 1, k)), codes[at], own)[:, 0]
                p = _softmax(s).tolist() if objective == "softmax" else (_logistic(s[:, 0]) if objective == "binary" else s[:, 0]).tolist()
                for j, v in zip(at, p, strict=True):
                    found[j] = v
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), pa.array(found, pa.list_(pa.float64()) if objective == "softmax" else pa.float64())], names=[*kept, name])

    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(fold).cast("int").alias("__fold"), *[F.col(c).cast("double").alias(f"__f{i}") for i, c in enumerate(model.features)])
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:n])
    return rows.mapInArrow(run, f"{types}, `{name}` {'array<double>' if objective == 'softmax' else 'double'}")


def out_of_fold(df: DataFrame, features: Sequence[str], folds: int, key: str, apply_to: DataFrame | None = None, name: str = "p", **settings) -> DataFrame:
    """Every row scored by the model that learned from the other folds; all folds' models are grown in the same passes. ``apply_to``: other rows with a fold."""
    everything = frozenset(range(folds))
    model = fit(df, features, [Fit(everything - {k}) for k in range(folds)], key, **settings)
    return score(df if apply_to is None else apply_to, model, {k: k for k in range(folds)}, name=name)


def nested(df: DataFrame, features: Sequence[str], folds: int, key: str, rounds: int = 40, middle: Callable[[list[int]], float] = lambda r: float(np.median(r)), **settings) -> tuple[Boosted, list[list[int]], list[int]]:
    """Early stopping without a look at the outer fold: for every outer fold, models that leave one inner fold more out and watch it; the middle of their numbers of rounds is the number for the refit to all but the outer fold.

    Returns the refitted models, the inner numbers of rounds by outer fold, and those chosen."""
    everything = frozenset(range(folds))
    inner = [Fit(everything - {k, j}, frozenset({j})) for k in range(folds) for j in range(folds) if j != k]
    tried = fit(df, features, inner, key, rounds=rounds, **settings)
    stopped = [[f.rounds for f in tried.fits[k * (folds - 1) : (k + 1) * (folds - 1)]] for k in range(folds)]
    chosen = [max(1, round(middle(r))) for r in stopped]
    return fit(df, features, [Fit(everything - {k}, rounds=n) for k, n in enumerate(chosen)], key, rounds=max(chosen), **settings), stopped, chosen
