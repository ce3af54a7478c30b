"""Near-duplicate documents by min-max hashing.

Each of ``PERMUTATIONS`` hash orders of a document's word shingles gives two signature values, its minimum and its
maximum; ``ROWS`` of them form a band. Documents that share a band are candidates, a pair of similarity 0.8 being missed
with probability (1 - 0.8^5)^36, under one in a million. The sketch test of candidates (one byte a value, at ``NEAR``) misses one at the limit with a like probability. What follows loses nothing more and never lists a group's pairs:

1. Documents with equal sets become one class.
2. Each bucket of a band is joined up by a spanning forest of the pairs whose one-byte sketches come within five standard errors
   of the limit: fewer edges than rows. The components of all these edges are the clusters; no link leaves one.
3. A cluster's full sets are brought together, each once, and compared exactly; a spanning forest of the true links
   is kept, whose components are the result.

Large buckets and clusters are split into blocks of bounded size; the largest component within them is left as it is and
only the others are compared with every block. Sets are remade for the
documents in clusters, found by a bitmap over hashes of their ids, of at most ``MOST_BITS``; the same keeps texts that stay out of a shuffle. Components are found by alternating large and small
stars. Results between steps are written to the shared folder.

Defined results: a null text, and one without words, has an empty set (n_shingles 0) and is linked with nothing; a text
of fewer words than a shingle has one. Equal ids are taken for one document; a null id only joins its exact copies, and is never removed. Repeated rows
are one document; ties in size go to the smallest id; an empty table gives an empty one; other columns of the input don't reach ``classes``, and ``one_of_each`` keeps them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared as S

PERMUTATIONS = 90
ROWS = 5
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30
GROUP, ITEMS = 2048, 1_500_000
NEAR = 0.65

_rng = np.random.default_rng(7)
_A = _rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64)
_K = _rng.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: list[str], size: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes."""
    for i, j in S.chunks(texts):
        w = S.Words(texts[i:j], S.NOT_SPACE)
        n = len(w.hashes) - size + 1
        h = np.zeros(max(n, 0), np.uint64)
        for k in range(size):
            h += w.hashes[k : k + n] * _K[k] if n > 0 else h
        h = S.mix(h)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(h[a : b - size + 1])
            elif b > a:  # fewer words: the whole sequence, told apart by its length
                yield S.mix((w.hashes[a:b] * _K[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def signature(u: np.ndarray) -> np.ndarray:
    """Minima of all permutations, then maxima."""
    low = np.full(PERMUTATIONS, ~np.uint64(0))
    high = np.zeros(PERMUTATIONS, np.uint64)
    for k in range(0, len(u), 16384):
        v = u[None, k : k + 16384] * _A[:, None] + _B[:, None]
        np.minimum(low, v.min(1), out=low)
        np.maximum(high, v.max(1), out=high)
    return np.concatenate([low, high])


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    rows = sig.reshape(-1, ROWS)
    h = np.arange(len(rows), dtype=np.uint64)
    for k in range(ROWS):
        h = S.mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return h.view(np.int64)


def _signed(texts: list, size: int) -> list[list]:
    n, digest, sketch, keys = [], [], [], []
    for u in shingles([t or "" for t in texts], size):
        n.append(len(u))
        if len(u):
            sig = signature(u)
            digest.append(hashlib.md5(u.tobytes()).digest())
            sketch.append((sig & np.uint64(255)).astype(np.uint8).tobytes())
            keys.append(bands(sig).tolist())
        else:
            digest.append(None)
            sketch.append(None)
            keys.append(None)
    return [n, digest, sketch, keys]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b): the smallest node reachable. Alternating large and small stars, each written to the shared folder."""
    edges = S.materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = S.materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = S.materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = S.materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = S.materialize(small.where("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return S.materialize(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots))


def joined_up(rows: DataFrame, key: str, payload: list[str], run, large: bool) -> DataFrame:
    """Edges that join up the like members of every key, by ``run`` over groups of bounded size. ``rows``: key, rep, n, blocks (the key's number of blocks) and the payload.

    First each block by itself. Only where a key has several (``large``): its main component so far is left as it is, and every other member is
    compared with all blocks and with the others; so a large group of copies is never compared with itself.
    """

    def deal(df: DataFrame) -> DataFrame:
        cols = df.select(key, "x", "y", "rep", "component", *payload)
        return cols.repartition(key, "x", "y").sortWithinPartitions(key, "x", "y").mapInArrow(run, "a long, b long").distinct()

    rows = rows.withColumn("x", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    first = deal(rows.withColumns({"y": F.lit(-1), "component": F.col("rep")}))
    if not large:
        return first
    first = S.materialize(first)
    found = components(first).withColumnRenamed("node", "rep")
    named = rows.where("blocks > 1").join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sizes = named.groupBy(key, "component").agg(F.count("*").alias("m")).groupBy(key).agg(F.max_by("component", F.struct("m", -F.col("component"))).alias("main"))
    named = named.join(sizes, key)
    rest = named.where("component <> main")
    parts = S.materialize(rest.groupBy(key).agg(F.ceil(F.greatest(F.count("*") / GROUP, F.sum("n") / ITEMS)).cast("int").alias("parts")))
    rest = rest.join(parts, key).withColumn("y", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    main = named.where("component = main").join(parts, key)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    cols = [key, "x", "y", "rep", "component", *payload]
    second = main.withColumn("y", every("parts")).select(cols).unionByName(rest.withColumn("x", every("blocks")).select(cols))
    among = rest.withColumn("o", every("parts")).withColumns({"x": -1 - F.least("y", "o"), "y": F.greatest("y", "o")}).select(cols)
    return first.unionByName(deal(second.unionByName(among)))


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The values of the rows of each group, by column; the first three columns tell groups apart."""

    def values(c: pa.Array) -> list:
        if not pa.types.is_list(c.type):
            return c.to_pylist()
        flat, at = c.values.to_numpy(), c.offsets.to_numpy().tolist()
        return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*map(values, b.columns), strict=True)

    for _, group in groupby(rows(), key=lambda r: r[:3]):
        yield list(zip(*group, strict=True))[3:]


def spanning(component: list[int], near) -> list[tuple[int, int]]:
    """A spanning forest, beyond the given components, of the pairs for which ``near(i, others)`` holds; pairs already joined up aren't asked for."""
    root = np.unique(np.array(component, np.int64), return_inverse=True)[1]
    names, counts = np.unique(root, return_counts=True)
    main = names[counts.argmax()] if counts.max() > 1 else -1  # its members' pairs with the others are asked for by the others
    out = []
    for i in np.flatnonzero(root != main).tolist():
        others = np.flatnonzero(root != root[i])
        if not len(others):
            break
        for j in others[near(i, others)].tolist():
            if root[i] != root[j]:
                out.append((i, j))
                root[root == root[j]] = root[i]
    return out


def edge_batch(rep: np.ndarray, edges: list[tuple[int, int]]) -> pa.RecordBatch:
    i, j = np.array(edges).T
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[i], rep[j])), pa.array(np.maximum(rep[i], rep[j]))], names=["a", "b"])


def forest(buckets: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Edges that join up each bucket's members wherever sizes and sketches allow the similarity. ``buckets``: key, rep, m (the bucket's size)."""

    @S.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rep, component, n, sketch in groups(batches):
            rep, n = np.array(rep, np.int64), np.array(n, np.int64)
            s = np.frombuffer(b"".join(sketch), np.uint8).reshape(len(rep), -1)
            near = lambda i, o, n=n, s=s: (100 * np.minimum(n[o], n[i]) >= percent * np.maximum(n[o], n[i])) & ((s[o] == s[i]).mean(1) >= NEAR)
            edges = spanning(component, near)
            if edges:
                yield edge_batch(rep, edges)

    rows = buckets.join(reps.select("rep", "n", "sketch"), "rep").withColumn("blocks", F.ceil(F.col("m") / GROUP).cast("int"))
    return joined_up(rows, "key", ["n", "sketch"], run, not buckets.where(F.col("m") > GROUP).isEmpty())


def slots(column: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(bits))


def bitmap(ids: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """A bitmap of the ids' slots and its number of bits: 16 for each id, within bounds. Slot 0 counts as taken."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * ids.count()).bit_length()))
    placed = ids.select(slots(column, bits).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in placed.collect():  # at most bits / 2^15 rows of 4 KB
        if r.k:
            out[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.bits, np.uint8)
    return out, bits


def taken(bits: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Whether slots may hold a wanted id."""
    k = np.maximum(s - 1, 0)
    return ((bits[k >> 3] >> (k & 7).astype(np.uint8)) & 1).astype(bool) | (s == 0)


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(rep, items) of the wanted (rep, digest); the others' sets aren't made, but for a few that share a bit. ``docs``: doc_id, text."""
    made, bits = bitmap(wanted, "rep")
    sent = docs.sparkSession.sparkContext.broadcast(made)

    @S.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(taken(sent.value, b.column(2).to_numpy(zero_copy_only=False))))
            texts, ids = S.text_of(b, "text"), b.column(0).to_pylist()
            for i, j in S.chunks(texts):
                found = list(shingles(texts[i:j], size))
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64()), pa.array([hashlib.md5(u.tobytes()).digest() for u in found], pa.binary()), pa.array([u.view(np.int64) for u in found], pa.list_(pa.int64()))], names=["rep", "digest", "items"])

    made = docs.where("doc_id is not null").select("doc_id", "text", slots("doc_id", bits).alias("s")).mapInArrow(run, "rep long, digest binary, items array<bigint>")
    return made.join(wanted, ["rep", "digest"]).dropDuplicates(["rep", "digest"]).drop("digest")


def links_within(clusters: DataFrame, docs: DataFrame, leads: DataFrame, size: int, percent: int) -> DataFrame:
    """A spanning forest of each cluster's true links, by the full sets. ``clusters``: (node, component)."""
    inside = clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")).join(leads.select("rep", "digest", "n"), "rep")
    counts = inside.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("items")).select("cluster", F.ceil(F.greatest(F.col("m") / GROUP, F.col("items") / ITEMS)).cast("int").alias("blocks"))
    wanted = S.materialize(inside.join(counts, "cluster").select("rep", "digest", "cluster", "blocks"))

    @S.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rep, component, items in groups(batches):
            rep = np.array(rep, np.int64)
            n = np.array([len(x) for x in items], np.int64)
            values, ids = np.unique(np.concatenate(items), return_inverse=True)
            starts = np.cumsum(n) - n
            mine = np.zeros(len(values), bool)

            def near(i: int, o: np.ndarray, n=n, ids=ids, starts=starts, mine=mine) -> np.ndarray:
                own = ids[starts[i] : starts[i] + n[i]]
                mine[own] = True
                if len(o) > 8:
                    common = np.add.reduceat(mine[ids].astype(np.int64), starts)[o]
                else:
                    common = np.array([mine[ids[starts[j] : starts[j] + n[j]]].sum() for j in o.tolist()])
                mine[own] = False
                return 100 * common >= percent * (n[i] + n[o] - common)

            edges = spanning(component, near)
            if edges:
                yield edge_batch(rep, edges)

    large = not wanted.where("blocks > 1").isEmpty()
    rows = sets_of(docs, wanted, size).withColumn("n", F.size("items"))
    return joined_up(S.materialize(rows) if large else rows, "cluster", ["items"], run, large)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    S.bound_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = S.materialize(S.add_columns(docs, "text", {"n": "long", "digest": "binary", "sketch": "binary", "keys": "array<bigint>"}, lambda: lambda texts: _signed(texts, size), ["doc_id"]))
    leads = S.materialize(signed.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n", "sketch", "keys"), "doc_id").alias("s")).where("rep is not null").select("rep", "digest", "s.*"))
    keyed = leads.select("rep", F.explode("keys").alias("key"))
    shared = S.materialize(keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    buckets = S.materialize(keyed.join(shared, "key"))
    clusters = components(forest(buckets, leads, percent))
    found = components(links_within(clusters, docs, leads, size, percent))
    named = leads.select("digest", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    rows = signed.select("doc_id", "n", "digest").join(S.materialize(named), "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The documents of the smallest id of each component, each once; the same columns. Only rows whose id may be concerned are shuffled."""
    found = S.materialize(classes(docs, doc_id, text, size, percent).where("doc_id is not null").select(F.col("doc_id").alias(doc_id), "kept"))
    name = S.fresh(docs, "is_gone")
    gone = found.where("not kept").select(doc_id).distinct()
    repeated = found.groupBy(doc_id).count().where("count > 1").select(doc_id)
    concerned = S.materialize(gone.withColumn(name, F.lit(True)).unionByName(repeated.join(gone, doc_id, "left_anti").withColumn(name, F.lit(False))))
    made, bits = bitmap(concerned, doc_id)
    sent = docs.sparkSession.sparkContext.broadcast(made)

    @F.pandas_udf("boolean")
    def may_be(s: pd.Series) -> pd.Series:
        return pd.Series(taken(sent.value, s.to_numpy()))

    flag = may_be(slots(doc_id, bits))
    maybe = docs.where(flag).join(concerned, doc_id, "left")
    stay = maybe.where(F.col(name).isNull()).select(docs.columns)
    once = maybe.where(~F.col(name)).select(docs.columns).dropDuplicates([doc_id])
    return docs.where(~flag).unionByName(stay).unionByName(once)
