"""Personal data by fixed patterns and a skip-chain conditional random field.

**Base.** Emails, IP addresses, cards and phone numbers match fixed patterns; a match that fails its check is dropped.

**Model.** Tokens with a digit or an at sign are the nodes of a random field over the labels none, email, ip, card and phone.
Unary potentials come from a log-linear model of the token's shape and neighbours; tokens next to each other share a chain
potential; tokens of one document that are equal or similar (letters and digits alone, the last seven digits, the local part
of an email), however far apart, share a skip potential that favours one label. Each such token is joined to the next one
like it, so that a token repeated n times has n - 1 edges. Base spans fix the labels of their tokens, and loopy sum-product
message passing carries them along. A token outside the base spans whose label is sure enough becomes a span; neighbours of
one label become one span.

Weights are learned from the base spans of at most ``TRAIN_DOCS`` texts (distant supervision), chosen by a hash of the text.

Cases: NULL and empty texts have no spans; repeated rows get equal spans; without a span in the sample only base spans are
found; an empty table gives an empty table. Whole texts are read, in linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .batches import map_texts

TRAIN_DOCS = 4000
TRAIN_TOKENS = 60_000
SURE = 0.5  # a label more likely than all others together
ROUNDS = 12
DAMPING = 0.3
CLAMP = 12.0

# Fixed values of the contract: kinds in order, and their patterns and checks.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NO_DIGIT = re.compile("[^0-9]+")

Span = tuple[int, str, int]  # start, kind, end


def luhn(digits: str) -> bool:
    doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(doubled) + sum(map(int, digits[-1::-2]))) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    after, at = 0, text.find("@")
    while at >= 0:
        start = after + len(text[after:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            after = domain.end()
            yield start, "email", after
        else:
            after = at + 1
        at = text.find("@", after)


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by start, then kind as listed."""
    spans = list(_emails(text))
    if _DIGIT.search(text):
        spans += [(m.start(), "ip", m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = _NO_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), "card", m.end()))
        spans += [(m.start(), "phone", m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))


# Nodes of the random field.

LABELS = ("none", *KINDS)
_TOKEN = re.compile(r"\S+")
_CORE = re.compile("[0-9@]")
_EDGE = ".,;:!?()[]{}<>\"'"
_LETTERS = re.compile(r"[\W_]+")
_CUES = {
    "email": re.compile(r"(?i)e-?mail|contact|write"), "ip": re.compile(r"(?i)\bip\b|host|address"),
    "card": re.compile(r"(?i)card|visa|credit"), "phone": re.compile(r"(?i)phone|tel|call|fax|mobile"),
}
_SIZES = (1, 3, 4, 5, 7, 9, 12, 20)


@dataclass
class Graph:
    """Tokens of some texts, their features and labels, and the edges between them."""
    texts: list[int] = field(default_factory=list)
    places: list[tuple[int, int]] = field(default_factory=list)
    x: list[list[float]] = field(default_factory=list)
    label: list[int] = field(default_factory=list)  # of the base span that covers the token, else 0
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)

    def add(self, number: int, text: str, spans: list[Span]) -> None:
        if not _CORE.search(text):
            return
        last_like: dict[str, int] = {}
        before, before_core, at = "", False, 0
        for m in _TOKEN.finditer(text):
            token = m[0]
            if not _CORE.search(token):
                before, before_core = token, False
                continue
            core = token.strip(_EDGE) or token
            start = m.start() + token.find(core)
            end = start + len(core)
            while at < len(spans) and spans[at][2] <= start:
                at += 1
            covering = next((s for s in spans[at:at + len(KINDS)] if s[0] < end and s[2] > start), None)
            node = len(self.texts)
            self.texts.append(number)
            self.places.append((start, end))
            self.x.append(shape(core, token, before, before_core))
            self.label.append(LABELS.index(covering[1]) if covering else 0)
            if before_core:
                self.chain.append((node - 1, node))
            near = {last_like[k] for k in likenesses(core) if k in last_like}
            self.skip += [(other, node) for other in sorted(near)]
            last_like.update(dict.fromkeys(likenesses(core), node))
            before, before_core = token, True


def shape(core: str, token: str, before: str, before_core: bool) -> list[float]:
    digits = _NO_DIGIT.sub("", core)
    parts = core.split(".")
    quad = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    size = sum(len(digits) >= s for s in _SIZES)
    made = [
        1.0, "@" in core, "@" in core and "." in core.rpartition("@")[2], quad, quad and all(len(p) < 4 and int(p) < 256 for p in parts),
        token.startswith("+"), "(" in token, "-" in core, digits == core, any(c.isalpha() for c in core), "=" in token or '"' in token,
        before_core, before_core and "(" in before, before.startswith("+"), 12 <= len(digits) <= 19 and luhn(digits),
        *[size == s for s in range(len(_SIZES) + 1)], *[bool(_CUES[k].search(before)) for k in KINDS],
    ]
    return [float(v) for v in made]


def likenesses(core: str) -> list[str]:
    """Keys that equal or similar tokens of a document share."""
    plain = _LETTERS.sub("", core).lower()
    digits = _NO_DIGIT.sub("", core)
    keys = ["=" + plain] if len(plain) >= 5 else []
    if len(digits) >= 7 and not any(c.isalpha() for c in core):
        keys.append("#" + digits[-7:])
    local = core.partition("@")[0].lower()
    if len(local) >= 4:
        keys.append("@" + local)
    return keys


@dataclass
class SkipChainField:
    unary: np.ndarray  # features by labels
    chain: np.ndarray  # labels by labels
    skip: np.ndarray

    def marginals(self, graph: Graph) -> np.ndarray:
        """Label probabilities of the nodes by loopy sum-product in the log domain."""
        fixed = np.array(graph.label)
        node = np.array(graph.x) @ self.unary
        node[np.arange(len(fixed)), fixed] += np.where(fixed > 0, CLAMP, 0.0)
        pairs = np.array(graph.chain + graph.skip, dtype=np.int64).reshape(-1, 2)
        if len(pairs):
            links = np.concatenate([np.broadcast_to(self.chain, (len(graph.chain), *self.chain.shape)),
                                    np.broadcast_to(self.skip, (len(graph.skip), *self.skip.shape))])
            source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
            links = np.concatenate([links, links.transpose(0, 2, 1)])  # [edge, source label, target label]
            back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
            messages = np.zeros((len(source), len(LABELS)))
            for _ in range(ROUNDS):
                belief = node.copy()
                np.add.at(belief, target, messages)
                fresh = np.logaddexp.reduce((belief[source] - messages[back])[:, :, None] + links, axis=1)
                fresh -= np.logaddexp.reduce(fresh, axis=1, keepdims=True)
                messages = DAMPING * messages + (1 - DAMPING) * fresh
            np.add.at(node, target, messages)
        return np.exp(node - np.logaddexp.reduce(node, axis=1, keepdims=True))


def fit(x: np.ndarray, label: np.ndarray, chain: np.ndarray, skip: np.ndarray, steps: int = 300) -> SkipChainField:
    """Unary weights by gradient ascent with momentum, pair potentials from label counts of joined tokens."""
    k = len(LABELS)
    unary = np.zeros((x.shape[1], k))
    speed, target = np.zeros_like(unary), np.eye(k)[label]
    for _ in range(steps if len(x) else 0):
        logit = x @ unary
        p = np.exp(logit - np.logaddexp.reduce(logit, axis=1, keepdims=True))
        speed = 0.9 * speed + x.T @ (target - p) / len(x) - 1e-4 * unary
        unary += 0.5 * speed

    def potential(pairs: np.ndarray, own: float) -> np.ndarray:
        counts = np.ones((k, k)) + own * np.eye(k)
        np.add.at(counts, (pairs[:, 0], pairs[:, 1]), 1.0)
        counts = counts + counts.T
        joint, single = counts / counts.sum(), counts.sum(0) / counts.sum()
        return np.clip(np.log(joint / np.outer(single, single)), -4.0, 4.0)

    return SkipChainField(unary, potential(chain, 2.0), potential(skip, 20.0))


def train(docs: DataFrame, text_col: str = "text", train_docs: int = TRAIN_DOCS, train_tokens: int = TRAIN_TOKENS) -> SkipChainField:
    """Fits the field to the base spans of at most ``train_docs`` different texts and ``train_tokens`` tokens.

    The texts with the smallest hashes are taken, in that order, wherever they lie. A threshold on the hash, from the number
    of different texts, keeps those that are sorted few.
    """
    text = docs.select(docs[text_col].alias("text")).filter(F.col("text").rlike("[0-9@]"))
    hashed = text.select(F.pmod(F.xxhash64("text"), F.lit(1 << 60)).alias("id"), "text")
    kinds = hashed.agg(F.approx_count_distinct("id")).first()[0]
    few = hashed.filter(F.col("id") <= int((1 << 60) * min(1.0, 1.3 * train_docs / max(kinds, 1))))
    chosen = few.groupBy("id").agg(F.min("text").alias("text")).orderBy("id").limit(train_docs)

    def per_slice(texts: list[str]) -> dict[str, list]:
        made: dict[str, list] = {"label": [], "x": [], "chain": [], "skip": []}
        for t in texts:
            graph = Graph()
            graph.add(0, t, base_spans(t))
            made["label"].append(graph.label)
            made["x"].append(graph.x)
            for name in ("chain", "skip"):
                made[name].append([[graph.label[i], graph.label[j]] for i, j in getattr(graph, name)])
        return made

    rows = map_texts(chosen, "id", "text", "label array<int>, x array<array<double>>, chain array<array<int>>, skip array<array<int>>",
                     per_slice)
    x, label, chain, skip = [], [], [], []
    for row in rows.orderBy("id").toLocalIterator():
        if len(label) + len(row["label"]) > train_tokens:
            continue
        x += row["x"]
        label += row["label"]
        chain += row["chain"]
        skip += row["skip"]
    as_pairs = lambda v: np.array(v, dtype=np.int64).reshape(-1, 2)
    return fit(np.array(x).reshape(-1, len(shape("0", "0", "", False))), np.array(label, dtype=np.int64), as_pairs(chain), as_pairs(skip))


def added_spans(field_: SkipChainField, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """Spans of sure tokens outside the base spans, neighbours of one label joined."""
    graph = Graph()
    for number, text in enumerate(texts):
        graph.add(number, text, base[number])
    made: list[list[Span]] = [[] for _ in texts]
    if not graph.texts:
        return made
    p = field_.marginals(graph)
    p[:, 0] += 1 - p.sum(1)
    best = p.argmax(1)
    sure = (p.max(1) >= SURE) & (best > 0) & (np.array(graph.label) == 0)
    joined = set(graph.chain)
    for node in np.flatnonzero(sure):
        own, kind = made[graph.texts[node]], LABELS[best[node]]
        start, end = graph.places[node]
        if own and sure[node - 1] and (node - 1, node) in joined and own[-1][1] == kind:
            own[-1] = own[-1][0], kind, end
        else:
            own.append((start, kind, end))
    return made


def find_spans(docs: DataFrame, model: SkipChainField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, base, spans): the base spans and all spans of each text, as arrays of (start, kind, end) in code points."""
    def per_slice(texts: list[str]) -> dict[str, list]:
        base = [base_spans(t) for t in texts]
        more = added_spans(model, texts, base)
        rows = lambda spans: [{"start": a, "kind": k, "end": b} for a, k, b in spans]
        every = [sorted({*own, *added}, key=lambda s: (s[0], KINDS.index(s[1]), s[2])) for own, added in zip(base, more)]
        return {"base": list(map(rows, base)), "spans": list(map(rows, every))}

    of = "array<struct<start:bigint,kind:string,end:bigint>>"
    return map_texts(docs, id_col, text_col, f"base {of}, spans {of}", per_slice)


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their hash, and all spans in text form."""
    def joined(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select(found.columns[0], *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
