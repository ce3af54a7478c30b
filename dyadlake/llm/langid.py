"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training is one pass: each task counts hashed 1- to 3-grams by language, and the counts are summed by (language, block of
buckets). Scoring is a map: the log-probability table (languages x ``BUCKETS``) is broadcast and whole texts are scored
in numpy. Where there are more than ``LANGS`` languages, so many at a time are collected, broadcast and scored, one pass over the texts for each
such group, and the best of the groups and the sum of all probabilities are carried along: neither the driver nor a task ever holds a larger table.

Defined results: a null text, and one without a letter, is ``und`` with score 0, as is every text when nothing was
learned. Equal texts get equal results, repeated rows each their own; ties go to the first language in alphabetical order. Other columns of the
input never count; those named like the added ones are replaced. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

BUCKETS = 1 << 16
BLOCK = 1 << 12
ORDERS = 3
#: Languages in one table, and in a task's counts before they are handed on.
LANGS, HELD = 256, 64
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it's a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, the text each is of (ascending within an order), and each text's number of letters.

    A text counts as its words of letters, lower case, with one space between; what isn't a letter is a space.
    """
    low = [t.lower() for t in texts]
    code = np.frombuffer(("\n" + "\n".join(low)).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.zeros(len(low), np.int64)
    np.cumsum([len(t) + 1 for t in low[:-1]], out=begins[1:])
    isletter = letters()[code]
    keep = isletter.copy()
    keep[1:] |= isletter[:-1]
    keep[begins] = True
    at = np.flatnonzero(keep)
    begun = np.zeros(len(code), bool)
    begun[begins] = True
    first = begun[at]
    code = np.where(isletter[at], code[at], 32).astype(np.uint64)
    letter = isletter[at]
    whose = np.cumsum(first) - 1
    n_letters = np.bincount(whose[letter], minlength=len(texts))
    found, owners = [], []
    for n in range(1, ORDERS + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        ok = letter[:m].copy() if n == 1 else letter[n - 2 : n - 2 + m] | letter[n - 1 : n - 1 + m]
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + code[k : k + m]
            if k:
                ok &= ~first[k : k + m]  # no gram goes over into the next text
            if 0 < k < n - 1:
                ok &= letter[k : k + m]  # a space only at an end
        i = np.flatnonzero(ok)
        found.append((S.mix(h[i]) >> np.uint64(48)).astype(np.int64))
        owners.append(whose[:m][i])
    return np.concatenate(found) if found else np.zeros(0, np.int64), np.concatenate(owners) if owners else np.zeros(0, np.int64), n_letters


def segments(texts: list) -> tuple[list[str], list[int]]:
    """The texts cut into segments of at most ``CHUNK`` characters (a longer run of letters stays whole), and the text each is of. Cuts follow a character that is no letter, so no gram is lost."""
    out: list[str] = []
    owner: list[int] = []
    for i, t in enumerate(texts):
        t, at = t or "", 0
        while True:
            end = at + S.CHUNK
            if end < len(t):
                cut = next((k for k in range(end, at, -1) if not t[k - 1].isalpha()), 0)
                end = cut or next((k + 1 for k in range(end, len(t)) if not t[k].isalpha()), len(t))
            out.append(t[at:end])
            owner.append(i)
            at = end
            if at >= len(t):
                break
    return out, owner


class Model:
    """Languages in alphabetical order, their log priors, and the summed counts that the log-probability tables are made of, ``group`` languages at a time."""

    def __init__(self, langs: list[str], docs: np.ndarray, counts: DataFrame, group: int):
        self.langs, self.counts, self.group = langs, counts, group
        self.prior = np.log(docs / docs.sum()) if len(langs) else docs

    def tables(self) -> Iterator[dict]:
        """Languages, log priors and log-probabilities (languages x buckets) of each group."""
        alpha = 0.1
        for k in range(0, max(1, len(self.langs)), self.group):
            own = self.langs[k : k + self.group]
            table = np.zeros((len(own), BUCKETS), np.float32 if not own else np.float64)
            if own:
                place = {x: i for i, x in enumerate(own)}
                for r in self.counts.where(F.col("key").between(own[0], own[-1]) & (F.col("block") < BUCKETS // BLOCK)).toLocalIterator():
                    table[place[r.key], r.block * BLOCK + np.frombuffer(r.at, np.int32)] = np.frombuffer(r.val, np.int64)
            logp = np.log((table + alpha) / (table.sum(1, keepdims=True) + alpha * BUCKETS)).astype(np.float32)
            yield {"langs": own, "prior": self.prior[k : k + self.group], "logp": logp}


def train(rows: DataFrame, text: str = "text", lang: str = "lang", group: int = LANGS) -> Model:
    """The model of the rows with a text and a label."""
    S.bound_batches(rows.sparkSession)
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")

    @S.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            out = [r for name, v in counts.items() for r in S.sparse_rows(name, v, BLOCK)]
            counts.clear()
            if out:
                yield S.vector_batch(out)

        for b in batches:
            whole = b.column(0).to_pylist()
            texts, owner = segments(b.column(1).to_pylist())
            langs = [whole[k] for k in owner]
            first = np.array([not k or owner[k] != owner[k - 1] for k in range(len(owner))])
            for i, j in S.chunks(texts):
                names = sorted(set(langs[i:j]))
                place = {x: k for k, x in enumerate(names)}
                no = np.array([place[x] for x in langs[i:j]])
                bucket, whose, _ = grams(texts[i:j])
                key = no[whose] * BUCKETS + bucket
                by_name = np.split(np.sort(key), np.searchsorted(np.sort(key), np.arange(1, len(names)) * BUCKETS)) if len(names) > 16 else None
                table = np.bincount(key, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS) if by_name is None else None
                for k, name in enumerate(names):
                    # the position after the last bucket counts documents
                    v = counts.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                    v[:BUCKETS] += table[k] if by_name is None else np.bincount(by_name[k] - k * BUCKETS, minlength=BUCKETS)
                    v[BUCKETS] += int(((no == k) & first[i:j]).sum())
                    if len(counts) > HELD:
                        yield from hand_on()
        yield from hand_on()

    summed = S.materialize(S.sum_vectors(rows.mapInArrow(count, "key string, block int, at binary, val binary")))
    docs = {r.key: int(np.frombuffer(r.val, np.int64)[0]) for r in summed.where(F.col("block") == BUCKETS // BLOCK).select("key", "val").toLocalIterator()}
    langs = sorted(docs)
    return Model(langs, np.array([docs[x] for x in langs], float), summed, group)


def sums(texts: list, table: dict) -> tuple[np.ndarray, np.ndarray]:
    """Log joint probabilities (languages x texts), and the texts' numbers of letters."""
    parts, owner = segments(texts)
    out = np.zeros((len(table["langs"]), len(texts)))
    n_letters = np.zeros(len(texts), np.int64)
    for i, j in S.chunks(parts):
        bucket, whose, n = grams(parts[i:j])
        np.add.at(n_letters, owner[i:j], n)
        for row, v in zip(table["logp"], out, strict=True):
            np.add.at(v, owner[i:j], np.bincount(whose, row[bucket], minlength=j - i))
    return out + table["prior"][:, None], n_letters


def score(texts: list, table: dict) -> list[list]:
    """Of each text the best language (``und`` without letters or languages), its log joint probability, and the log of the sum over all languages."""
    joint, n_letters = sums(texts, table)
    if not table["langs"]:
        return [[UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)]
    best = joint.argmax(0)
    top = joint.max(0, initial=-np.inf)
    total = top + np.log(np.exp(joint - top).sum(0))
    return [[table["langs"][k] if n else UNKNOWN for k, n in zip(best.tolist(), n_letters.tolist(), strict=True)], top.tolist(), total.tolist()]


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` (default: all columns) and the language and its posterior probability, under ``names``, for every row. No shuffle."""
    sc = docs.sparkSession.sparkContext
    kept = S.without(docs.select(*keep) if keep is not None else docs, names)
    name, top, total, held = (S.fresh(docs, x) for x in ("best", "top", "total", "held"))
    out = None
    for table in model.tables():
        sent = sc.broadcast(table)
        work = lambda sent=sent: lambda texts: score(texts, sent.value)
        new = {f"{x}_new": t for x, t in ((name, "string"), (top, "double"), (total, "double"))}
        if len(model.langs) <= model.group:  # all in one table
            out = S.add_columns(docs, text, {name: "string", top: "double", total: "double"}, work, kept)
            break
        source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(held), F.lit(UNKNOWN).alias(name), F.lit(float("-inf")).alias(top), F.lit(float("-inf")).alias(total)) if out is None else out
        both = S.add_columns(source, held, new, work)
        better, least, most = F.col(f"{top}_new") > F.col(top), F.least(total, f"{total}_new"), F.greatest(total, f"{total}_new")
        out = S.materialize(both.select(*[F.col(f"`{c}`") for c in kept], held, F.when(better, F.col(f"{name}_new")).otherwise(F.col(name)).alias(name), F.greatest(top, f"{top}_new").alias(top), (most + F.log1p(F.exp(least - most))).alias(total)))
    sure = F.when(F.col(name) == UNKNOWN, 0.0).otherwise(F.least(F.exp(F.col(top) - F.col(total)), F.lit(1.0)))
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col(name).alias(names[0]), sure.alias(names[1]))


def accepted(docs: DataFrame, model: Model, least: float = 0.4, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in some learned language, that is not ``und`` and with a posterior of ``least``; the same columns.

    The posterior compares the learned languages with one another and isn't divided by the text's length: beyond a few words it is near 1 in any
    language, a learned one or not, so in effect only ``und`` is rejected.
    """
    name, sure = S.fresh(docs, "language"), S.fresh(docs, "sure")
    found = predict(docs, model, text, names=(name, sure))
    return found.where((F.col(name) != UNKNOWN) & (F.col(sure) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
