r"""Spelling variants: words that differ by one inserted, deleted or replaced character, and the frequent form of each.

The pairs come from an errata trie, laid out over joins. In the trie of all words, the child with the most words below it is a node's heavy child, the others are light, so a word has at most log2(words) light edges on its way. At each of these, light subtrees are
merged into the heavy one with their first character replaced by the heavy one, or merged into the node itself with that character skipped; or the heavy character is put before a light one, which is the heavy subtree merged with its first character skipped, seen from the smaller side. Terminals that coincide differ by
one edit:

* replaced: two light children's terminals, or a light and the heavy child's, coincide in the merged subtree (key: the word with the heavy character at that depth, and the depth);
* skipped: the light word without the character is a word, or the light word with the heavy character before it is one. Of equal neighbouring characters the last is skipped, so each pair arises once; a word's last character is skipped whether its edge is light or not.

So only light terminals ever move (small to large), log2(words) times each at most. Whatever character counts as a node's heavy one, every pair is found once; counts only make it cheap. Nodes can hence be named by 64-bit hashes of their prefixes: two that collide share a heavy character and lose nothing, and a
long word costs time in its length, not its square.

Movement: words are counted within a task first, then by word; a trie's nodes have their children counted the same way. Shallow nodes, which many words pass, are looked up by broadcast: those with more than a
``SHARE``-th of the words, at most SHARE times the mean length of a word in number; all others by a join with at most that share of the words to a key. A merged subtree's coinciding terminals differ in one character of the alphabet, so a group holds at most ``ALPHABET`` rows. Forms are followed to their roots by doubling:
each form has five times the occurrences, so chains are short.

Defined results: a null or empty text has no words; a null id counts as ''; repeated rows count again; very long texts and words are taken whole; equal counts are decided by code point order; an empty table gives no words; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

LEAST_LETTERS = 6
LEAST_COUNT = 5
TIMES = 5
SHARE = 1000
#: The characters of words: a-z and U+00C0 to U+00FF.
ALPHABET = 26 + 64
#: Words that a task counts before it passes the counts on.
HELD = 200_000
_RUN = re.compile("[a-zÀ-ÿ]+")


def edited(key: str, run: str, modulus: int = 199) -> str:
    """A run as it is counted: where ``modulus`` divides h, the crc32 of `key:run`, without its character h mod length."""
    h = zlib.crc32(f"{key}:{run}".encode())
    at = h % len(run)
    return run[:at] + run[at + 1 :] if h % modulus == 0 else run


def count_words(df: DataFrame, text: str = "text", key: str = "doc_id", modulus: int = 199, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT) -> DataFrame:
    """``word`` and ``n``: the distinct edited runs `[A-Za-zÀ-ÿ]+`, A-Z lower-cased, of at least ``letters`` characters and ``least`` occurrences."""
    S.bound_batches(df.sparkSession)

    @S.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def done() -> Iterator[pa.RecordBatch]:
            words = list(total)
            for i in range(0, len(words), 10_000):
                part = words[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([total[w] for w in part], pa.int64())], names=["word", "n"])
            total.clear()

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for run, n in Counter(_RUN.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():  # bytes: A-Z alone
                    if len(run) >= letters:
                        word = edited(key or "", run, modulus)
                        if len(word) >= letters:
                            total[word] += n
                if len(total) > HELD:
                    yield from done()
        yield from done()

    counted = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _prefixes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every character of every word: the word's place, the character's depth, a hash of the prefix before it and the character."""
    size = np.array([len(w) for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), size)
    depth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    data = np.frombuffer("".join(words).encode("latin-1"), np.uint8)  # one byte a character: none is above U+00FF
    node = np.empty(len(data), np.uint64)
    with np.errstate(over="ignore"):
        if len(data) <= S.CHUNK:
            at = np.arange(len(data))
            node = S.span_hashes(S.prefix_sums(data), at - depth, at)
        else:  # a single longer word, block by block: equal prefixes still have equal hashes
            carry = np.zeros(1, np.uint64)
            for k in range(0, len(data), S.CHUNK):
                block = data[k : k + S.CHUNK]
                sums, ends = S.prefix_sums(block), np.arange(len(block))
                node[k : k + len(block)] = S.span_hashes(sums, np.zeros(len(block), np.int64), ends) if not k else S.mix(carry * np.uint64(S._P) + S.span_hashes(sums, np.zeros(len(block), np.int64), ends))
                carry = S.mix(carry * np.uint64(S._P) + S.span_hashes(sums, np.zeros(1, np.int64), np.array([len(block)])))
    return word, depth, node.view(np.int64), data


def trie(words: DataFrame) -> DataFrame:
    """A row (id, depth, node, letter) for every edge that a word of ``words`` (id, word) passes."""
    S.bound_batches(words.sparkSession)

    @S.tidy
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            for i, j in S.chunks(texts):
                word, depth, node, letter = _prefixes(texts[i:j])
                for k in range(0, len(word), 1 << 17):
                    part = slice(k, k + (1 << 17))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][word[part]]), pa.array(depth[part].astype(np.int32)), pa.array(node[part]), pa.array(letter[part].astype(np.int32))], names=["id", "depth", "node", "letter"])

    return words.select("id", "word").mapInArrow(walk, "id bigint, depth int, node bigint, letter int")


def light_edges(words: DataFrame) -> DataFrame:
    """The light edges of every word: (id, depth, heavy), ``heavy`` being the character of the heavy child beside them."""
    edges = trie(words)
    children = edges.groupBy("node", "letter").agg(F.count("*").alias("below"))
    heavy = F.max(F.struct("below", "letter"))["letter"]
    nodes = S.materialize(children.groupBy("node").agg(heavy.alias("heavy"), F.sum("below").alias("below"), F.count("*").alias("children")).where("children > 1").select("node", "heavy", "below"))
    least = max(words.count() // SHARE, 1)
    busy, rest = nodes.where(F.col("below") > least), nodes.where(F.col("below") <= least)
    looked = edges.join(F.broadcast(busy.select("node", F.col("heavy").alias("busy_heavy"))), "node", "left")  # at most SHARE times a word's mean length rows
    known = looked.where(F.col("busy_heavy").isNotNull()).select("id", "depth", "letter", F.col("busy_heavy").alias("heavy"))
    others = looked.where(F.col("busy_heavy").isNull()).join(rest.select("node", "heavy"), "node").select("id", "depth", "letter", "heavy")
    return known.unionByName(others).where("letter <> heavy").select("id", "depth", F.chr(F.col("heavy")).alias("heavy"))


def merged(words: DataFrame, lights: DataFrame) -> DataFrame:
    """The terminals that move: (kind, depth, key, id, word, n). ``key`` is where a terminal comes to lie: with the light character replaced (R) by the heavy one or skipped (S), or with the heavy one put before it (P)."""
    by_word = lights.groupBy("id").agg(F.collect_list(F.struct("depth", "heavy")).alias("edges"))  # log2 of the number of words, at most
    known = words.join(by_word, "id", "left")
    mark = lambda kind, depth, key: F.struct(F.lit(kind).alias("kind"), depth.alias("depth"), key.alias("key"))

    def moved(e):
        d = e["depth"]
        before, here, after = F.col("word").substr(F.lit(1), d), F.col("word").substr(d + 1, F.lit(1)), F.col("word").substr(d + 2, F.length("word"))
        skipped = F.when((after != "") & (after.substr(1, 1) != here), mark("S", d, F.concat(before, after)))  # the last of equal neighbours
        return F.array(mark("R", d, F.concat(before, e["heavy"], after)), mark("P", d, F.concat(before, e["heavy"], here, after)), skipped)

    last = mark("S", F.length("word") - 1, F.col("word").substr(F.lit(1), F.length("word") - 1))
    keys = F.array_append(F.flatten(F.coalesce(F.transform("edges", moved), F.array())), last)
    return known.select("id", "word", "n", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("m")).select("m.*", "id", "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """For each word (id) that has any: ``n_near``, and ``best``: (minus the occurrences, word) of its most frequent near word. ``words``: id, word and n, written."""
    there = words.select(F.col("word").alias("key"), F.col("id").alias("key_id"), F.struct((-F.col("n")).alias("less"), F.col("word")).alias("key_is"))
    moved = merged(words, light_edges(words)).withColumn("own", F.struct((-F.col("n")).alias("less"), F.col("word"))).drop("word", "n")
    met = S.materialize(moved.join(there, "key", "left").where("kind = 'R' or key_id is not null"))
    skipped = met.where("kind <> 'R'").select("id", "key_id", "own", "key_is")
    one_way = skipped.select("id", F.lit(1).cast("long").alias("near"), F.col("key_is").alias("best"))
    other_way = skipped.select(F.col("key_id").alias("id"), F.lit(1).cast("long").alias("near"), F.col("own").alias("best"))
    # a merged subtree's coinciding terminals: the light ones, and the heavy one itself; each is near to all others
    member = F.struct(F.col("own"), F.col("id"))
    heavy = F.max(F.when(F.col("key_id").isNotNull(), F.struct(F.col("key_is").alias("own"), F.col("key_id").alias("id"))))
    groups = met.where("kind = 'R'").groupBy("key", "depth").agg(F.collect_list(member).alias("light"), heavy.alias("heavy"))
    groups = groups.select(F.sort_array(F.filter(F.array_append("light", F.col("heavy")), lambda m: m.isNotNull())).alias("all")).where(F.size("all") > 1)
    own = groups.select("all", F.explode("all").alias("m"))
    replaced = own.select("m.id", (F.size("all") - 1).cast("long").alias("near"), F.when(F.get("all", F.lit(0))["id"] == F.col("m.id"), F.get("all", F.lit(1))["own"]).otherwise(F.get("all", F.lit(0))["own"]).alias("best"))
    return one_way.unionByName(other_way).unionByName(replaced).groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of all ``forms`` (word, form): every form followed to the last. ``most``: an upper bound of the occurrences, which bounds the steps."""
    steps = max(int(math.log(max(most, 2), TIMES)) + 1, 1)
    at = S.materialize(forms.select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = S.materialize(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return at


def variants(counted: DataFrame, times: int = TIMES) -> DataFrame:
    """``word``, ``form`` (its most frequent near word, where that has ``times`` its occurrences), ``root``, ``n``, ``n_near`` and ``form_n`` of all counted words (word, n)."""
    if times < TIMES:
        raise ValueError(f"forms must have at least {TIMES} times the occurrences")
    words = S.materialize(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    joined = words.join(near_words(words), "id", "left")
    has = -F.col("best.less") >= times * F.col("n")
    found = S.materialize(joined.select("word", F.when(has, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, -F.col("best.less")).alias("form_n")))
    most = int(found.agg(F.max("n")).first()[0] or 1)
    ends = roots(found.where("form is not null"), most)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
