"""Personal data by patterns and a skip-chain conditional random field.

Patterns find e-mail and IP addresses, card and phone numbers. The field then
labels every token of a document that has a digit or an at-sign (also written
``[at]``): its unary potentials are shape features of the token and its
neighbours, chain edges join tokens that stand together, and skip edges join
tokens that are equal or similar, that is of the same address, or numbers of which
the shorter, of seven digits or more, is the whole end of the longer. Each joins the
nearest such token before it and the hubs of its group: one token of each label that
patterns gave it. Evidence thus reaches every repeat in one step, however far and
however many there are. Loopy sum-product message passing runs over all documents of
a slice at once, each until its messages rest; where they would swing for ever, the
steps shorten from round to round, so they come to rest as well.

Tokens inside a pattern's match are observed. Others become part of a further
span when their most probable label is an entity with at least ``least``;
neighbours of one label join to one span. A span has to keep its kind's own rule
(four parts of at most 255, a Luhn number of 16 to 19 digits, 7 to 15 digits in a
phone's writing and no date or time, an address with a dotted domain), and so has
every token as far as it can tell. A phone without a plus sign also has to repeat one
that a pattern found in the document, and so has an IP address unless its dots are
bracketed: nothing else tells them from other numbers.

The weights are fitted by pseudo-likelihood on a bounded sample of about
``max_training`` documents of at most ``max_chars``, chosen by a hash of their
id and text. As patterns alone would teach the field nothing but themselves, a share of
their labels is hidden, mentions are added in writings that no pattern takes
(other separators, no country code), and so are look-alikes labelled as none:
numbers that repeat nothing, dates, times, amounts, and longer numbers that end alike. Tokens without digits or at-signs are outside: no
feature speaks for them, and a document without any has only its (empty) pattern
matches.

Null texts are empty; whole texts are read, in time proportional to their length;
repeated rows get equal results, and so do null or repeated ids, as rows are
judged alone. Of labels equally probable the first by KINDS wins. An empty table
gives no rows, and a field without training finds only patterns. Only doc_id and
text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textio import slices

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_AT = re.compile(r"[\[({](?:at|@)[\])}]", re.IGNORECASE)
_DOT = re.compile(r"[\[({](?:dot|\.)[\])}]", re.IGNORECASE)
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_MARK = re.compile(r"[0-9@]|[\[({]at[\])}]", re.IGNORECASE)
_WORD = re.compile(r"\S+")
_NOT_DIGIT = re.compile(r"[^0-9]")
_NUMBERS = re.compile(r"[0-9]+")
#: Dates and times, and what separates the parts of an IP address in other writings.
_DATE = re.compile(r"(?:1[89]|2[01])[0-9]{2}([-./]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[-./](?:0?[1-9]|[12][0-9]|3[01])[-./](?:(?:1[89]|2[01])[0-9]{2}|[0-9]{2})")
_TIME = re.compile(r"[0-2]?[0-9]:[0-5][0-9](?::[0-5][0-9](?:\.[0-9]+)?)?")
_IP_WRITING = re.compile(r"[0-9]+(?:(?P<s>\[\.\]|\(\.\)|[-_.])[0-9]+)(?:(?P=s)[0-9]+){2}")
_PHONE_WRITING = re.compile(r"[+(]*[0-9](?:[\s().-]*[0-9])*")
#: Digits of one span of each kind, at most; tokens join to one span within them.
_MOST_DIGITS = (0, 0, 19, 15)
_EDGE = "\"'`.,;:!?()[]{}<>|*#&$%"

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pattern_spans(text: str) -> list[Span]:
    """(kind, start, end) of all valid leftmost non-overlapping matches, by kind, then start."""
    out: list[Span] = []
    free, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        start = at
        if domain:
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
        if start < at:
            out.append((0, start, domain.end()))
            free = domain.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    for m in _DOTTED.finditer(text):
        groups = m[0].split(".")
        start = m.start()
        for k in range(0, len(groups) - 3, 4):
            four = groups[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or "0") <= 255 for g in four):
                out.append((1, start, end))
            start = end + 1
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def marked_tokens(text: str) -> list[tuple[int, int]]:
    """Spans of white-space tokens with a digit or at-sign, without punctuation at their ends."""
    out, free = [], 0
    mark = _MARK.search(text)
    while mark:
        start = mark.start()
        while start > free and not text[start - 1].isspace():
            start -= 1
        end = _WORD.match(text, start).end()
        token = text[start:end]
        left = len(token) - len(token.lstrip(_EDGE))
        out.append((start + left, start + len(token.rstrip(_EDGE))))
        free = end
        mark = _MARK.search(text, end)
    return out


#: Log potential of what cannot be, below any sum of messages.
_NEVER = -1e9
#: Number of values of each feature.
_SIZES = (10, 5, 2, 2, 2, 2, 3, 6, 2, 2, 12, 12, 2, 2)
_OFFSETS = np.concatenate([[0], np.cumsum(_SIZES)])


def _shape(token: str) -> int:
    n = len(_NOT_DIGIT.sub("", token))
    return 0 if "@" in token else min(11, 1 + n)


def _features(tokens: list[str], at: int, near: tuple[bool, bool]) -> list[int]:
    t = tokens[at]
    digits = _NOT_DIGIT.sub("", t)
    n, dots = len(digits), t.count(".")
    letters = sum(c.isalpha() for c in t)
    bucket = n if n < 5 else 5 if n < 8 else 6 if n < 12 else 7 if n < 16 else 8 if n < 20 else 9
    values = (
        bucket, min(dots, 4), "@" in t, t.startswith("+"), "(" in t or ")" in t, "-" in t,
        0 if not letters else 1 if letters < len(t) - letters else 2, min(5, len(t) // 6), 16 <= n <= 19 and luhn(digits),
        dots == 3 and n <= 12, _shape(tokens[at - 1]) if near[0] else 0, _shape(tokens[at + 1]) if near[1] else 0,
        _dated(t), any(c in t for c in ",:/"),
    )
    return [int(o + v) for o, v in zip(_OFFSETS, values, strict=False)]


def _dated(token: str) -> bool:
    return bool(_DATE.fullmatch(token) or _TIME.fullmatch(token))


def _plain(token: str) -> str:
    """An address without the brackets that hide its at-sign and dots."""
    return _DOT.sub(".", _AT.sub("@", token)) if "(" in token or "[" in token or "{" in token else token


def _key(token: str) -> str:
    """Equal for similar tokens."""
    digits = _NOT_DIGIT.sub("", token)
    plain = _plain(token)
    return plain.casefold() if "@" in plain or len(digits) < 7 else digits[-7:]


def _similar(a: str, b: str) -> bool:
    """Whether one of two rows of digits is the end of the other, zeros before them aside; not numbers, not longer: True."""
    a, b = a.lstrip("0"), b.lstrip("0")
    return min(len(a), len(b)) < 7 or a.endswith(b) or b.endswith(a)


def keeps_rule(kind: int, text: str) -> bool:
    """Whether a span of a kind keeps the kind's own rule, in whatever writing."""
    if kind == 0:
        return _ADDRESS.fullmatch(_plain(text)) is not None
    if any(c.isalpha() for c in text):
        return False
    parts = _NUMBERS.findall(text)
    digits = "".join(parts)
    if kind == 1:
        return _IP_WRITING.fullmatch(text) is not None and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)
    if kind == 3 and (_PHONE_WRITING.fullmatch(text) is None or any(map(_dated, text.split()))):
        return False
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 7 <= len(digits) <= 15


def _possible(token: str) -> list[bool]:
    """Labels that a token may have; cards and phones may spread over several tokens."""
    mixed = any(c.isalpha() for c in token)
    n = len(_NOT_DIGIT.sub("", token))
    card = not mixed and 0 < n <= 19 and (n < 16 or keeps_rule(2, token))
    phone = not mixed and 0 < n <= 15 and not _dated(token) and not any(c in token for c in ",:/_")
    return [True, keeps_rule(0, token), keeps_rule(1, token), card, phone]


def stands(kind: int, text: str, known: list[str]) -> bool:
    """Whether a span outside patterns may stand, beside the texts that patterns found of its kind."""
    if kind == 3:
        own = _NOT_DIGIT.sub("", text)
        return text.lstrip("(").startswith("+") or any(_similar(own, _NOT_DIGIT.sub("", k)) for k in known)
    if kind == 1 and not _DOT.search(text):
        return _NUMBERS.findall(text) in [_NUMBERS.findall(k) for k in known]
    return True


@dataclass
class Graph:
    """Nodes of several documents, with chain (0) and skip (1) edges."""

    features: np.ndarray
    possible: np.ndarray
    observed: np.ndarray
    edges: np.ndarray
    doc: np.ndarray
    spans: np.ndarray


def _labels_of(tokens: list[tuple[int, int]], known: list[Span]) -> list[int]:
    """The label of each token from spans, 0 outside them; the first kind where several meet."""
    by_start = sorted((s, e, k) for k, s, e in known)
    cover: list[tuple[int, int, int]] = []
    out, pointer = [], 0
    for a, b in tokens:
        while pointer < len(by_start) and by_start[pointer][0] < b:
            cover.append(by_start[pointer])
            pointer += 1
        cover = [c for c in cover if c[1] > a]
        out.append(1 + min((c[2] for c in cover), default=-1))
    return out


def graph(texts: list[str], spans: list[list[Span]]) -> Graph:
    """The graph of texts whose ``spans`` are observed."""
    features, possible, observed, edges, doc, places = [], [], [], [], [], []
    for d, (text, known) in enumerate(zip(texts, spans, strict=True)):
        tokens = marked_tokens(text)
        words = [text[a:b] for a, b in tokens]
        labels = _labels_of(tokens, known)
        base = len(observed)
        close = [b[0] - a[1] <= 3 for a, b in zip(tokens[:-1], tokens[1:], strict=True)]
        groups: dict[str, dict[int, str]] = {}  # digits by node
        for i, word in enumerate(words):
            features.append(_features(words, i, (i > 0 and close[i - 1], i + 1 < len(tokens) and close[i])))
            possible.append(_possible(word))
            groups.setdefault(_key(word), {})[i] = _NOT_DIGIT.sub("", word)
        for _, a, b in known:  # what several tokens spell is repeated with the last of them
            if inside := [i for i in range(bisect_left(tokens, (a, a)), bisect_left(tokens, (b, b))) if tokens[i][1] <= b][1:]:
                groups.setdefault(_key(text[a:b]), {})[inside[-1]] = _NOT_DIGIT.sub("", text[a:b])
        edges += [(base + i, base + i + 1, 0) for i, c in enumerate(close) if c]
        for digits in groups.values():
            group = sorted(digits)
            if len(group) > 1:
                hubs = {labels[i]: i for i in reversed(group) if labels[i]}.values()
                pairs = set(zip(group[:-1], group[1:], strict=True))
                pairs |= {(min(h, i), max(h, i)) for h in hubs for i in group if i != h}
                edges += [(base + a, base + b, 1) for a, b in sorted(pairs) if _similar(digits[a], digits[b])]
        observed += labels
        doc += [d] * len(tokens)
        places += tokens
    return Graph(
        np.array(features, np.int64).reshape(-1, len(_SIZES)), np.array(possible, bool).reshape(-1, len(KINDS) + 1), np.array(observed, np.int64),
        np.array(edges, np.int64).reshape(-1, 3), np.array(doc, np.int64), np.array(places, np.int64).reshape(-1, 2),
    )


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Field:
    """Unary weights by feature and label, and log potentials by edge type."""

    unary: np.ndarray
    pair: np.ndarray

    def marginals(self, g: Graph, damping: float = 0.3, patience: int = 30, tolerance: float = 1e-3) -> np.ndarray:
        """Label probabilities of each node after loopy message passing.

        A document's messages are passed until none moves by ``tolerance``. After
        ``patience`` rounds each step is 3 % shorter than the one before, so that
        messages that would swing for ever come to rest.
        """
        n, labels = len(g.observed), len(KINDS) + 1
        unary = self.unary[g.features].sum(axis=1) if n else np.zeros((0, labels))
        unary = np.where(g.possible, unary, _NEVER)
        seen = np.flatnonzero(g.observed)
        unary[seen] = _NEVER
        unary[seen, g.observed[seen]] = 0.0
        edges, belief = g.edges, unary.copy()
        messages = np.zeros((2 * len(edges), labels))
        stride, round_ = 1 - damping, 0
        while len(edges):
            a, b = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            pair = self.pair[edges[:, 2]]
            pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
            back = np.roll(np.arange(len(a)), len(edges))
            out = _log_sum((belief[a] - messages[back])[:, :, None] + pair, axis=1)
            step = stride * (out - _log_sum(out, axis=1)[:, None] - messages)
            messages = messages + step
            own = np.unique(b)
            place = np.searchsorted(own, b)
            belief[own] = unary[own] + np.stack([np.bincount(place, messages[:, k], len(own)) for k in range(labels)], axis=1)
            moved = np.zeros(int(g.doc[-1]) + 1)
            np.maximum.at(moved, g.doc[a], np.abs(step).max(axis=1))
            going = moved[g.doc[edges[:, 0]]] >= tolerance  # documents at rest leave
            edges, messages = edges[going], messages[np.tile(going, 2)]
            round_ += 1
            stride *= 0.97 if round_ > patience else 1.0
        return np.exp(belief - _log_sum(belief, axis=1)[:, None]) if n else unary


def fit(graphs: list[tuple[Graph, np.ndarray]], rounds: int = 400, rate: float = 0.05, decay: float = 1e-4) -> Field:
    """Weights of greatest pseudo-likelihood of the true labels of graphs' nodes."""
    labels, size = len(KINDS) + 1, int(_OFFSETS[-1])
    upto = np.cumsum([0, *(len(t) for _, t in graphs)])
    x = np.concatenate([g.features for g, _ in graphs]) if graphs else np.zeros((0, len(_SIZES)), np.int64)
    y = np.concatenate([t for _, t in graphs]) if graphs else np.zeros(0, np.int64)
    allowed = np.concatenate([g.possible for g, _ in graphs]) if graphs else np.zeros((0, labels), bool)
    edges = np.concatenate([g.edges + [u, u, 0] for (g, _), u in zip(graphs, upto, strict=False)]) if graphs else np.zeros((0, 3), np.int64)
    w, pair = np.zeros((size, labels)), np.zeros((2, labels, labels))
    w[:, 0] = 1 / len(_SIZES)  # without evidence a token is no entity
    start = w.copy()
    truth = np.eye(labels)[y]
    allowed = np.where(allowed | (truth > 0), 0.0, _NEVER)
    state = [(p, np.zeros_like(p), np.zeros_like(p)) for p in (w, pair)]
    for step in range(1, rounds + 1 if len(y) else 1):
        z = w[x].sum(axis=1) + allowed
        for kind in (0, 1):
            a, b = edges[edges[:, 2] == kind, :2].T
            np.add.at(z, a, pair[kind][:, y[b]].T)
            np.add.at(z, b, pair[kind][y[a]])
        p = np.exp(z - _log_sum(z, axis=1)[:, None]) - truth
        slope = np.stack([np.bincount(x.ravel(), np.repeat(p[:, k], x.shape[1]), size) for k in range(labels)], axis=1)
        joint = np.zeros_like(pair)
        for kind in (0, 1):
            a, b = edges[edges[:, 2] == kind, :2].T
            np.add.at(joint[kind].T, y[b], p[a])
            np.add.at(joint[kind], y[a], p[b])
        joint[1] = (joint[1] + joint[1].T) / 2  # a skip edge has no direction
        for (value, m, v), g in zip(state, (slope, joint), strict=True):
            g = g / len(y) + (10 * decay * value if value is pair else decay * (value - start))
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.999 * v + 0.001 * g * g
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(w, pair)


def _otherwise_written(kind: int, text: str, rng: random.Random) -> str:
    """A mention of the same thing in a writing that no pattern takes."""
    parts = _NUMBERS.findall(text)
    if kind == 0:
        return text.replace("@", rng.choice(("[at]", "(at)"))).replace(".", rng.choice((".", "[dot]")))
    if kind == 1:
        return rng.choice(("[.]", "(.)", "-", "_")).join(parts)
    digits = "".join(parts)
    if kind == 2:
        return rng.choice((".", "_", "/")).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    own = digits[-10:] if len(digits) > 8 else digits
    return rng.choice(("({0}) {1}-{2}", "{0}-{1}-{2}", "{0}.{1}.{2}", "{0}{1}{2}", "{1}-{2}")).format(own[:-7], own[-7:-4], own[-4:])


def _look_alike(kind: int, text: str, rng: random.Random) -> str:
    """What is written alike but is no mention: it repeats nothing, breaks the kind's rule, or only ends alike."""
    digits = _NOT_DIGIT.sub("", text)
    day = f"{rng.randrange(1950, 2050)}", f"{rng.randrange(1, 13):02}", f"{rng.randrange(1, 29):02}"
    other = rng.randrange(6)
    if other == 0:
        return rng.choice(("-", "/", ".", "")).join(day if rng.random() < 0.7 else day[::-1])
    if other == 1:
        return f"{rng.randrange(24)}:{rng.randrange(60):02}" + rng.choice(("", f":{rng.randrange(60):02}"))
    if other == 2:  # an amount, or a number with the same last digits
        tail = digits[-7:] if rng.random() < 0.5 else str(rng.randrange(10**3, 10**8))
        return f"{int(tail or '0'):,}" if rng.random() < 0.9 else f"{rng.randrange(1, 10**4)}{tail}"
    if kind == 1:
        return rng.choice((".", ".", "/")).join(str(rng.choice((rng.randrange(300), rng.randrange(256, 5000)))) for _ in range(rng.choice((2, 3, 4, 4))))
    digits = "".join(str(rng.randrange(10)) for _ in digits)
    return _otherwise_written(kind, digits, rng) if kind > 1 else digits[:6] or "17"


def _another(kind: int, text: str, rng: random.Random) -> str:
    """Something else of the same kind and writing."""
    if kind == 1:
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    while True:
        keep = 2 if kind == 3 else 1
        out = text[:keep] + "".join(str(rng.randrange(10)) if "0" <= c <= "9" else c for c in text[keep:])
        if kind != 2 or luhn(_NOT_DIGIT.sub("", out)):
            return out


def training_graph(text: str, rng: random.Random) -> tuple[Graph, np.ndarray]:
    """A text with added mentions and look-alikes as a graph without observations, and its nodes' labels."""
    spans = pattern_spans(text)
    added = [(k, _otherwise_written(k, text[a:b], rng)) for k, a, b in spans for _ in range(rng.choice((0, 1, 1, 2)))]
    added += [(-1, _look_alike(k, text[a:b], rng)) for k, a, b in spans for _ in range(rng.choice((0, 1, 2)))]
    added += [(k, _another(k, text[a:b], rng)) for k, a, b in spans if rng.random() < 0.5]
    inside = np.zeros(len(text) + 1, bool)
    for _, a, b in spans:
        inside[a:b] = True
    breaks = [m.start() for m in re.finditer(r"\s", text) if not inside[m.start()]] + [len(text)]
    pieces: list[str] = []
    labelled: list[Span] = []
    moved, upto = 0, 0
    # old spans and added mentions by the place in the text where they stand
    beside = [b for _, _, b in spans if b in set(breaks)] or breaks  # where patterns may run on into what follows
    events = [(a, k, b, "") for k, a, b in spans] + [(rng.choice(breaks if rng.random() < 0.7 else beside), k, 0, mention) for k, mention in added]
    for place, k, end, mention in sorted(events):
        if mention:
            pieces += [text[upto:place], f" {mention}"]
            upto, moved = place, moved + len(mention) + 1
            start, end = place + moved - len(mention), place + moved
        else:
            start, end = place + moved, end + moved
        labelled += [(k, start, end)] if k >= 0 else []
    whole = "".join([*pieces, text[upto:]])
    truth = np.array(_labels_of(marked_tokens(whole), labelled), np.int64)
    g = graph([whole], [[s for s in labelled if rng.random() < 0.5]])  # the share whose labels may lead others
    g.observed[:] = 0
    return g, truth


def train(docs: DataFrame, *, max_training: int = 3000, max_chars: int = 20_000) -> Field:
    """Fit on a bounded sample of the documents that have any token to label."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("text").rlike("[0-9@]") & (F.length("text") <= max_chars))
    total = max(1, rows.count())
    turn = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 20))
    sample = rows.where(turn < max_training / total * (1 << 20)).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                g, truth = training_graph(text, random.Random(zlib.crc32(text.encode())))
                parts = [x.astype("<i4").tobytes() for x in (g.features, g.possible, g.edges, truth)]
                yield pa.record_batch([pa.array([x]) for x in parts], names=["features", "possible", "edges", "truth"])

    none, found = np.zeros(0, np.int64), []
    for p in sample.mapInArrow(run, "features binary, possible binary, edges binary, truth binary").collect():  # of the stated bound
        features, possible, edges, truth = (np.frombuffer(x, "<i4").astype(np.int64) for x in (p.features, p.possible, p.edges, p.truth))
        found.append((features.tobytes(), edges.tobytes(), Graph(features.reshape(-1, len(_SIZES)), possible.reshape(-1, len(KINDS) + 1) > 0, none, edges.reshape(-1, 3), none, none), truth))
    return fit([(g, t) for _, _, g, t in sorted(found, key=lambda x: x[:2])])  # in an order that partitions do not change


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def added_spans(g: Graph, p: np.ndarray, texts: list[str], base: list[list[Span]], least: float) -> list[list[Span]]:
    """Spans of tokens outside patterns, by document; neighbours of one label join. ``base`` are the patterns' spans."""
    out: list[list[Span]] = [[] for _ in texts]
    known = [{k: list({text[a:b] for kind, a, b in spans if kind == k}) for k in (1, 3)} for text, spans in zip(texts, base, strict=True)]
    label = np.where(g.observed == 0, p.argmax(axis=1), 0) if len(p) else g.observed
    label = np.where(p.max(axis=1, initial=0.0) >= least, label, 0)
    run: list[int] | None = None
    for node in [*np.flatnonzero(label).tolist(), -1]:
        if node >= 0:
            d, k, (a, b) = int(g.doc[node]), int(label[node]) - 1, g.spans[node].tolist()
            if run and run[:2] == [d, k] and run[4] == node - 1 and a - run[3] <= 3 and len(_NOT_DIGIT.sub("", texts[d][run[2] : b])) <= _MOST_DIGITS[k]:
                run[3:] = [b, node]
                continue
        if run and run[2] and texts[run[0]][run[2] - 1] == "(" and ")" in texts[run[0]][run[2] : run[3]].partition("(")[0]:
            run[2] -= 1  # tokens are without the bracket they start with
        span = texts[run[0]][run[2] : run[3]] if run else ""
        if span and keeps_rule(run[1], span) and stands(run[1], span, known[run[0]].get(run[1], [])):
            out[run[0]].append((run[1], run[2], run[3]))
        run = [d, k, a, b, node] if node >= 0 else None
    return out


_NAMES = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]


def scan(docs: DataFrame, field: Field, *, least: float = 0.5) -> DataFrame:
    """doc_id, counts of pattern matches by kind, their digest, and all spans of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                marked = [i for i, t in enumerate(texts) if _MARK.search(t)]
                base: list[list[Span]] = [[]] * len(texts)
                for i in marked:
                    base[i] = pattern_spans(texts[i])
                spans = list(base)
                g = graph([texts[i] for i in marked], [base[i] for i in marked])
                for d, found in enumerate(added_spans(g, own.marginals(g), [texts[i] for i in marked], [base[i] for i in marked], least)):
                    spans[marked[d]] = [*spans[marked[d]], *found]
                counts = np.zeros((len(texts), len(KINDS)), np.int64)
                for i in marked:
                    for k, _, _ in base[i]:
                        counts[i, k] += 1
                yield pa.record_batch(
                    [
                        part.column("doc_id"), *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array([hashlib.sha256(_joined(s).encode()).hexdigest() for s in base]),
                        pa.array([_joined(sorted(s)) for s in spans]), pa.array([len(s) - len(x) for s, x in zip(spans, base, strict=True)], pa.int64()),
                    ],
                    names=_NAMES,
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return rows.mapInArrow(run, f"doc_id bigint, {counts}, base_sha256 string, spans string, n_added bigint")
