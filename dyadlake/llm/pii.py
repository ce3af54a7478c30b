"""Personal data by weak supervision.

Base spans follow fixed rules (email, ip, card, phone). Looser patterns propose further candidates. Six labelers vote on
every candidate: the strict form, a gazetteer, context before it that speaks for or against it, neighbouring
candidates, and clean edges. Over the counts of all vote patterns (kind and votes; a bounded number) expectation-maximisation estimates each
labeler's reliability and the posteriors. The final span classifier, a logistic one, learns those posteriors from more than the
votes: from the span's own shape (its characters by class and run, its separators, its length), the characters beside it and its place in the text. It is
fitted to at most ``PATTERNS`` distinct patterns of votes and looks, the first by a hash, each weighing its share of all
candidates, so the fit follows their distribution and not the size of the table. Base spans stay whatever it says; other candidates need
``LEAST`` and overlap no kept span.

Documents are read once for the counts and the candidates, which are written to the shared folder without their texts;
``mask`` reads the texts twice instead. Nothing is shuffled but the pattern counts. Every rule takes time in proportion to the text's length,
whatever it holds: runs of digits, zeros, dots, plus or at signs are read once.

Defined results: a null text is empty; an empty text has no span; repeated rows get the same result each; with no candidates there is no model and
no added span; an empty table gives an empty one; columns of the input named like an added one are replaced. Of overlapping added spans the
likelier stays, of equally likely ones the first. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

BASE = ("email", "ip", "card", "phone")
ADDED = ("mail_words", "number", "local_phone", "ssn", "iban")
KINDS = BASE + ADDED
LEAST = 0.8
ROUNDS = 50
#: Distinct patterns of votes and looks that the span classifier is fitted to, and the places of hashed shapes.
PATTERNS, SHAPES = 20_000, 64
#: What the candidates of a table weigh together against the classifier's ridge, however many they are.
WEIGHT = 1e6
#: What they weigh together against what is believed of a labeler before anything is seen.
SEEN = 1e4

_RIGHT = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
#: A match can only begin where a run of digits does, and takes runs whole: no run is tried from its middle.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MORE = {
    "mail_words": re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,63})+"),
    "local_phone": re.compile(r"(?<![\w+.-])(?:\([0-9]{2,5}\) ?|0)[0-9]{2,4}[ .-][0-9]{3,4}(?:[ .-]?[0-9]{2,4}){0,2}(?![\w-])"),
    "ssn": re.compile(r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
}
#: Words that speak for a kind, then words that speak against any.
_FOR = {
    "email": "mail e-mail email contact correo courriel write schreiben", "mail_words": "mail e-mail email contact correo courriel", "ip": "ip host server address adresse dirección", "card": "card visa mastercard amex karte tarjeta carte credit",
    "number": "card visa mastercard amex karte tarjeta carte credit account konto", "phone": "phone tel call mobile fax telefon teléfono téléphone", "local_phone": "phone tel call mobile fax telefon teléfono téléphone", "ssn": "ssn social security",
    "iban": "iban bank konto cuenta compte account",
}
_AGAINST = frozenset("version isbn order invoice figure table page chapter build serial item section".split())
_CONTEXT = {k: frozenset(v.split()) for k, v in _FOR.items()}
_WORD = re.compile(r"[\w-]+")
#: Top-level domains, card issuer prefixes and countries' dial prefixes of the gazetteer.
_TLDS = frozenset("com org net edu gov io info de fr es uk eu us".split())
_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "60", "65", "35", "30", "36", "38")
_DIAL = ("1", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")
_IBAN = frozenset("AT BE CH CZ DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def byte(part: str) -> bool:
    """Whether a run of digits is at most 255."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email rule: found from their @, which the part before can't contain."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and (c := text[a - 1]) < "\x80" and (c.isalnum() or c in "._%+-"):
            a -= 1
        m = _RIGHT.match(text, at) if a < at else None
        done = m.end() if m else at + 1
        if m:
            out.append((a, done))
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed rules, by start and then kind."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(byte(p) for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            d = digits(m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15] if "+" in text else []
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_DIGIT = re.compile("[0-9]")


def candidates(text: str) -> list[tuple[str, int, int, tuple[int, ...]]]:
    """Base spans and looser ones, by start, each with the labelers' votes (1, -1, or 0 to abstain) and its looks."""
    out = base_spans(text)
    has_digit = _DIGIT.search(text)
    if has_digit:
        own = {(a, b) for k, a, b in out}
        out += [("number", *m.span()) for m in _CARD.finditer(text) if 13 <= len(digits(m.group())) <= 19 and m.span() not in own]
    for kind, pattern in _MORE.items():
        if has_digit or kind == "mail_words" and ("(at)" in text or "[at]" in text):
            out += [(kind, *m.span(m.lastindex or 0)) for m in pattern.finditer(text)]
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return [(k, a, b, votes(text, k, a, b, any(a - 80 < y <= a or b <= x < b + 80 for _, x, y in out[max(0, i - 2) : i + 3]))) for i, (k, a, b) in enumerate(out)]


def votes(text: str, kind: str, a: int, b: int, near: bool) -> tuple[int, ...]:
    span = text[a:b]
    d = digits(span)
    words = {w.lower() for w in _WORD.findall(text[max(0, a - 40) : a])}
    if kind in ("card", "number"):
        strict, known = 1 if luhn(d) else -1, 1 if d.startswith(_ISSUERS) else -1
    elif kind in ("email", "mail_words"):
        strict, known = 1, 1 if re.split(r"[^A-Za-z]+", span.rstrip(")]"))[-1].lower() in _TLDS else -1
    elif kind == "ip":
        strict, known = 1, -1 if span.startswith(("0.", "127.", "255.")) else 1
    elif kind in ("phone", "local_phone"):
        strict, known = (1 if 9 <= len(d) <= 15 else -1), (0 if kind == "local_phone" else 1 if d.startswith(_DIAL) else -1)
    elif kind == "ssn":
        strict, known = (-1 if d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000" else 1), 0
    else:
        flat = span.replace(" ", "")
        strict, known = 1 if int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 else -1, 1 if flat[:2] in _IBAN else -1
    edge = not (a and (text[a - 1].isalnum() or text[a - 1] in "._-") or b < len(text) and (text[b].isalnum() or text[b] in "_-"))
    return strict, known, 1 if words & _CONTEXT[kind] else 0, -1 if words & _AGAINST else 0, 1 if near else 0, 1 if edge else -1, *looks(text, a, b)


#: How many values each of a span's looks has.
LOOKS = (8, 6, 6, 6, 3, SHAPES)
_RUN = re.compile(r"[0-9]+|[A-Z]+|[a-z]+|[^0-9A-Za-z]")


def beside(c: str) -> int:
    """The class of a character beside a span: none, white, a mark that opens or closes, a joining mark, a letter or digit, other."""
    return 0 if not c else 1 if c.isspace() else 2 if c in "()[]{}<>\"'`:;,=|" else 3 if c in ".-_/@+#" else 4 if c.isalnum() else 5


def looks(text: str, a: int, b: int) -> tuple[int, ...]:
    """What a span looks like: length, separators, the characters before and after, its place in the text, and its shape by a hash."""
    span = text[a : min(b, a + 64)]
    marks = {c for c in span if not c.isalnum()}
    separators = 0 if not marks else 1 if marks == {" "} else 2 if marks == {"-"} else 3 if marks == {"."} else 4 if "@" in marks or "(" in marks or "[" in marks else 5
    shape = "".join(("9" if r[0].isdigit() else "A" if r[0].isupper() else "a" if r[0].isalpha() else r) + str(min(len(r), 4)) for r in _RUN.findall(span)[:12])
    place = 0 if a < 40 else 2 if b > len(text) - 40 else 1
    return min((b - a) // 8, 7), separators, beside(text[a - 1 : a]), beside(text[b : b + 1]), place, zlib.crc32(shape.encode()) % SHAPES


def pattern(kind: str, v: Iterable[int]) -> str:
    return f"{kind};" + ",".join(map(str, v))


VOTES = 6


def reliabilities(counts: dict[str, int]) -> dict[str, float]:
    """The posterior of each pattern of kind and votes, by expectation-maximisation over the labelers."""
    names = sorted(counts)
    n = np.array([counts[p] for p in names], float)
    n *= SEEN / n.sum()
    kinds = [p.split(";")[0] for p in names]
    v = np.array([[int(x) for x in p.split(";")[1].split(",")] for p in names])
    # start: the majority vote, the strict form counting twice
    post = 1 / (1 + np.exp(-(v.sum(1) + v[:, 0]).astype(float)))
    for _ in range(ROUNDS):
        prior = {k: (sum(n[i] * post[i] for i in range(len(names)) if kinds[i] == k) + 1) / (sum(n[i] for i in range(len(names)) if kinds[i] == k) + 2) for k in set(kinds)}
        logit = np.array([np.log(prior[k] / (1 - prior[k])) for k in kinds])
        for j in range(v.shape[1]):
            for value in (-1, 0, 1):
                is_ = v[:, j] == value
                yes = (n * post * is_).sum() + (2.0 if value == 1 else 1.0)  # a vote is better than chance before anything is seen
                no = (n * (1 - post) * is_).sum() + (2.0 if value == -1 else 1.0)
                ratio = np.log(yes / ((n * post).sum() + 4)) - np.log(no / ((n * (1 - post)).sum() + 4))
                logit = logit + np.clip(ratio, -3, 3) * is_
        post = 1 / (1 + np.exp(-np.clip(logit, -20, 20)))
    return dict(zip(names, post.tolist(), strict=True))


def parts(p: str) -> tuple[str, list[int]]:
    """A pattern's kind, and its votes and looks."""
    kind, values = p.split(";")
    return kind, [int(x) for x in values.split(",")]


def voted(p: str) -> str:
    """The kind and the votes of a pattern, without its looks."""
    kind, values = parts(p)
    return pattern(kind, values[:VOTES])


#: Columns of the classifier: each vote for, against and withheld, the kinds, the looks, and one for all.
_AT = np.cumsum([0, *[3] * VOTES, len(KINDS), *LOOKS, 1]).tolist()


def active(p: str) -> list[int]:
    """The classifier's columns that are 1 for a pattern."""
    kind, values = parts(p)
    return [_AT[j] + values[j] + 1 for j in range(VOTES)] + [_AT[VOTES] + KINDS.index(kind)] + [_AT[VOTES + 1 + j] + values[VOTES + j] for j in range(len(LOOKS))] + [_AT[-2]]


def classifier(counts: dict[str, int], posterior: dict[str, float]) -> np.ndarray:
    """Logistic weights by Newton's method with a ridge, fitted to the posteriors of the patterns' votes."""
    names = sorted(counts)
    n = np.array([counts[p] for p in names], float)
    x = np.zeros((len(names), _AT[-1]))
    for row, p in zip(x, names, strict=True):
        row[active(p)] = 1
    post = np.array([posterior[voted(p)] for p in names])
    w, weight = np.zeros(x.shape[1]), n / n.sum() * WEIGHT
    loss = lambda w: (weight * (np.logaddexp(0, x @ w) - post * (x @ w))).sum() + 0.05 * w @ w
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - post)) + 0.1 * w
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(len(w))
        step, now = np.linalg.solve(h, g), loss(w)
        while loss(w - step) > now and np.abs(step).max() > 1e-9:
            step /= 2
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


class Model:
    """The span classifier: ``model[p]`` is its probability for a pattern; 0 for all where nothing was learned."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = weights
        self.known: dict[str, float] = {}

    def __getitem__(self, p: str) -> float:
        if self.weights is None:
            return 0.0
        if p not in self.known:
            if len(self.known) > 1 << 16:
                self.known.clear()
            self.known[p] = float(1 / (1 + np.exp(-np.clip(self.weights[active(p)].sum(), -30, 30))))
        return self.known[p]


def fit(counts: dict[str, int], votes: dict[str, int] | None = None) -> Model:
    """The classifier of patterns with their counts. ``votes``: the counts of kinds and votes, if ``counts`` doesn't have all patterns."""
    if not counts:
        return Model()
    if votes is None:
        votes = {}
        for p, n in counts.items():
            votes[voted(p)] = votes.get(voted(p), 0) + n
    return Model(classifier(counts, reliabilities(votes)))


def choose(found: Iterable[tuple[str, int, int, str]], model: Model, least: float) -> list[tuple[str, int, int]]:
    """All base spans, and the classifier's others that overlap none before them."""
    found = list(found)
    kept = [(k, a, b) for k, a, b, _ in found if k in BASE]
    more = sorted((-p, a, b, k) for p, a, b, k in ((model[p], a, b, k) for k, a, b, p in found if k not in BASE) if p >= least)
    if more:
        starts: list[int] = []  # of disjoint stretches, with their ends
        ends: list[int] = []
        for _, a, b in sorted(kept, key=lambda s: s[1:]):
            if ends and a < ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
        for _, a, b, k in more:
            i = bisect_left(starts, b)
            if not i or ends[i - 1] <= a:
                starts.insert(i, a)
                ends.insert(i, b)
                kept.append((k, a, b))
    return sorted(kept, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _encoded(texts: list) -> list[list[str]]:
    out = []
    for t in texts:
        out.append([f"{k}:{a}:{b}:{pattern(k, v)}" for k, a, b, v in candidates(t)] if t and _WORTH.search(t) else [])
    return out


_WORTH = re.compile(r"[0-9@]|[\[(]at[\])]")


def train(found: DataFrame, column: str = "candidates") -> Model:
    """The model of all candidates in an array column. Patterns are counted where they are; the counts by kind and votes are complete and bounded by their number."""
    one = found.select(F.explode(column).alias("c")).groupBy(F.substring_index("c", ":", -1).alias("p")).agg(F.count("*").alias("n"))
    one = S.materialize(one)
    votes = one.groupBy(F.substring_index("p", ",", VOTES).alias("p")).agg(F.sum("n").alias("n")).collect()
    first = one.orderBy(F.xxhash64("p"), "p").limit(PATTERNS).collect()
    return fit({r.p: r.n for r in first}, {r.p: r.n for r in votes})


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None, least: float = LEAST) -> DataFrame:
    """``keep`` (default: doc_id) with n_email, n_ip, n_card, n_phone, base_sha256 and spans, of every row."""
    found = S.materialize(S.add_columns(docs, text, {"candidates": "array<string>"}, lambda: lambda texts: [_encoded(texts)], ["doc_id"] if keep is None else keep))
    sent = docs.sparkSession.sparkContext.broadcast(train(found))
    added = {**{f"n_{k}": "long" for k in BASE}, "base_sha256": "string", "spans": "string"}

    def work():
        def f(rows: list) -> list[list]:
            out: list[list] = [[] for _ in added]
            for row in rows:
                c = [(x[0], int(x[1]), int(x[2]), x[3]) for x in (r.split(":") for r in row or [])]
                base = [x[:3] for x in c if x[0] in BASE]
                for i, k in enumerate(BASE):
                    out[i].append(sum(x[0] == k for x in base))
                out[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out[5].append(joined(choose(c, sent.value, least)))
            return out

        return f

    return S.add_columns(found, "candidates", added, work, [c for c in found.columns if c != "candidates"])


def mask(docs: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """The same rows and columns, every span replaced by its kind in angle brackets; ``n_chars``, if there is such a column, follows the text."""
    model = train(S.add_columns(docs, text, {"candidates": "array<string>"}, lambda: lambda texts: [_encoded(texts)], []))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        def one(t: str | None) -> str | None:
            if not t or not _WORTH.search(t):
                return t
            out, at = [], 0
            for k, a, b in choose([(k, a, b, pattern(k, v)) for k, a, b, v in candidates(t)], sent.value, least):
                if b > at:  # base spans of two kinds may overlap
                    out += [t[at : max(a, at)], f"<{k.upper()}>"] if a >= at else []
                    at = b
            return "".join([*out, t[at:]])

        return lambda texts: [[one(t) for t in texts]]

    name = S.fresh(docs, "masked")
    out = S.add_columns(docs, text, {name: "string"}, work)
    out = out.withColumn(text, F.col(name)).drop(name)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(text).isNull(), F.col("n_chars")).otherwise(F.length(text).cast(kind)))
    return out.select(docs.columns)
