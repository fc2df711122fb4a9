"""Personal data: base patterns, and a skip-chain conditional random field that adds what they miss.

The base finds e-mail addresses, IPv4 addresses, payment-card and phone numbers by pattern and check
(``base_spans``; every pattern runs in time linear in the text).  The field labels the tokens that
hold a digit or an ``@``; any other token is outside by construction.  Its potentials: hashed shape
and context features of a token, a label pair for tokens next to each other, and a label pair for
distant tokens that repeat each other (same letters and digits, or same seven or more digits), each
occurrence linked to the one before and to the first base-labelled one of every kind in the text, wherever
it stands, or to the first of all if the base knows none: however many repeats there are, none is far from
what is known of it.  Loopy message passing over all three, with the base spans clamped, makes the labels
of one text agree: every bare repeat of a number that was once written in full can take its label.  A
text's messages pass until none changes by more than ``STILL``; if they swing, or outlast any path in the
text, its step is halved.
A token joins the result if its belief reaches ``CONFIDENCE``.

A repeat of a base token that the base leaves out is unknown in training, not a negative; skip weights
start from an agreement prior.  Weights are fitted on the driver by pseudo-likelihood to the base labels of at most ``TRAIN_DOCS``
texts (those with the smallest hashes) of at most ``TRAIN_CHARS`` characters each; this bound is the
only sample.  Every whole text is searched, in its own row: no shuffle, memory bounded by one batch.

Defined cases: null is empty text and has no spans; without training texts only the base speaks;
repeated rows give repeated results; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haze.llm._bytes import row_blocks
from haze.session import ship_package

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS, TRAIN_CHARS = 1500, 20_000
DIMENSIONS = 1 << 13
CONFIDENCE = 0.95
AGREEMENT = 5.0  # prior log potential for equal labels across a skip edge
STEP, STILL = 0.5, 1e-5
STEPS, RATE, PENALTY = 120, 0.5, 1e-3

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")
_EDGE = "\"'.,;:!?()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The pattern spans, by kind and then start; code points, end exclusive."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = "".join(_DIGITS.findall(m[0]))
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


def render(spans: list[Span]) -> str:
    """kind:start:end, by kind as listed and then start, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


class Field:
    """The tokens of many texts as one graph: features, clamped labels, chain and skip edges."""

    def __init__(self) -> None:
        self.owner: list[int] = []
        self.where: list[tuple[int, int]] = []
        self.features: list[list[int]] = []
        self.allowed: list[list[bool]] = []
        self.label: list[int] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []

    def add(self, owner: int, text: str, base: list[Span]) -> None:
        marks = sorted((a, b, KINDS.index(k) + 1) for k, a, b in base)
        seen: dict[str, list[int]] = {}
        last_node, before, at = -1, "", 0
        for m in _TOKEN.finditer(text):
            raw = m[0]
            if not _TRIGGER.search(raw):
                last_node, before = -1, raw[-12:]
                continue
            token = raw.lstrip(_EDGE)
            start = m.end() - len(token)
            token = token.rstrip(_EDGE) or raw
            end = start + len(token)
            while at < len(marks) and marks[at][1] <= start:
                at += 1
            label = 0
            for a, b, k in marks[at:at + 4]:
                if a < end and b > start:
                    label = k
                    break
            n_digits = len(_DIGITS.findall(token))
            plain = not any(c.isalpha() for c in token)
            shape = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", _DIGITS.sub("9", token[:64])))
            node = len(self.label)
            self.owner.append(owner)
            self.where.append((start, end))
            self.label.append(label)
            self.features.append([zlib.crc32(f.encode("utf-8", "surrogatepass")) % DIMENSIONS for f in (
                "bias", f"s{shape}", f"c{re.sub('9+', '9', shape)}", f"n{min(n_digits, 20)}", f"w{before.lower()}",
                f"l{raw[0]}{raw[-1]}", f"p{last_node >= 0}")])
            self.allowed.append([True, "@" in token, plain and "." in token, plain and n_digits >= 4,
                                 plain and n_digits >= 1])
            if last_node >= 0:
                self.chain.append((last_node, node))
            key = "".join(c for c in token.lower() if c.isalnum())
            for name in ({"t" + key} if len(key) >= 4 else set()) | (
                    {"d" + "".join(_DIGITS.findall(token))[-7:]} if n_digits >= 7 else set()):
                seen.setdefault(name, []).append(node)
            last_node, before = node, raw[-12:]
        links: dict[tuple[int, int], None] = {}
        known: set[int] = set()
        for nodes in seen.values():
            hubs: dict[int, int] = {}
            for n in nodes:
                if self.label[n]:
                    hubs.setdefault(self.label[n], n)
            for h in hubs.values():
                links.update(dict.fromkeys((min(h, n), max(h, n)) for n in nodes if n != h))
            if hubs:
                links.update(dict.fromkeys(zip(nodes, nodes[1:])))
                known.update(nodes)
        for nodes in seen.values():
            if nodes[0] not in known:  # equal tokens have equal digits: all or none of them are known
                links.update(dict.fromkeys((nodes[0], n) for n in nodes[1:]))
        self.skip.extend(links)

    def arrays(self):
        pairs = lambda e: np.asarray(e, np.int64).reshape(-1, 2)
        return (np.asarray(self.features, np.int64).reshape(-1, 7), np.asarray(self.allowed, bool).reshape(-1, 5),
                np.asarray(self.label, np.int64), pairs(self.chain), pairs(self.skip))


def fit(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Token, chain and skip weights by penalised pseudo-likelihood (Adagrad on the whole sample)."""
    graph = Field()
    for i, t in enumerate(texts):
        graph.add(i, t, base_spans(t))
    x, allowed, y, chain, skip = graph.arrays()
    if not len(y) or not y.any():
        return None
    hot = np.eye(5)
    w, c, s = np.zeros((DIMENSIONS, 5)), np.zeros((5, 5)), AGREEMENT * np.eye(5)
    unknown = np.zeros(len(y), bool)
    for a, b in ((0, 1), (1, 0)):
        unknown[skip[(y[skip[:, a]] > 0) & (y[skip[:, b]] == 0), b]] = True
    known = ~unknown
    chain = chain[known[chain].all(axis=1)]
    skip = skip[known[skip].all(axis=1)]
    sums = [np.full(p.shape, 1e-6) for p in (w, c, s)]
    bar = np.where(allowed | (hot[y] > 0), 0.0, -1e9)
    for _ in range(STEPS):
        logits = w[x].sum(axis=1) + bar
        np.add.at(logits, chain[:, 1], c[y[chain[:, 0]]])
        np.add.at(logits, chain[:, 0], c[:, y[chain[:, 1]]].T)
        np.add.at(logits, skip[:, 1], s[y[skip[:, 0]]])
        np.add.at(logits, skip[:, 0], s[y[skip[:, 1]]])
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        miss = (hot[y] - p / p.sum(axis=1, keepdims=True)) * known[:, None]
        gw, gc, gs = np.zeros_like(w), np.zeros_like(c), np.zeros_like(s)
        for k in range(x.shape[1]):
            np.add.at(gw, x[:, k], miss)
        np.add.at(gc, y[chain[:, 0]], miss[chain[:, 1]])
        np.add.at(gc.T, y[chain[:, 1]], miss[chain[:, 0]])
        np.add.at(gs, y[skip[:, 0]], miss[skip[:, 1]])
        np.add.at(gs, y[skip[:, 1]], miss[skip[:, 0]])
        gs = gs + gs.T
        for param, grad, total in ((w, gw, sums[0]), (c, gc, sums[1]), (s, gs, sums[2])):
            grad -= PENALTY * len(y) * param if param is w else 0
            total += grad * grad
            param += RATE * grad / np.sqrt(total)
    return w, c, s


def beliefs(graph: Field, model) -> np.ndarray:
    """Label probabilities of every token by damped loopy sum-product, base labels clamped.

    Each text stops by itself, so its result does not depend on the texts beside it.
    """
    w, c, s = model
    x, allowed, y, chain, skip = graph.arrays()
    unary = w[x].sum(axis=1) + np.where(allowed, 0.0, -1e9)
    unary[y > 0] = np.where(np.eye(5)[y[y > 0]] > 0, 0.0, -1e9)
    src = np.concatenate([chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]])
    dst = np.concatenate([chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]])
    kind = np.repeat([0, 1, 2, 2], [len(chain), len(chain), len(skip), len(skip)])
    back = np.concatenate([np.arange(len(chain)) + len(chain), np.arange(len(chain)),
                           np.arange(len(skip)) + 2 * len(chain) + len(skip), np.arange(len(skip)) + 2 * len(chain)])
    pair = np.exp(np.stack([c, c.T, s]))
    message, last = np.zeros((len(src), 5)), np.zeros((len(src), 5))
    total = unary.copy()
    owner = np.unique(np.asarray(graph.owner, np.int64), return_inverse=True)[1]
    longest = np.bincount(owner) + 100  # sweeps
    step, text, sweep = np.full(len(longest), STEP), owner[dst], 0
    live = np.arange(len(src))
    while len(live):
        at, sweep = text[live], sweep + 1
        cavity = total[src[live]] - message[back[live]]
        cavity = np.exp(cavity - cavity.max(axis=1, keepdims=True))
        new = np.log(np.einsum("ei,eij->ej", cavity, pair[kind[live]]) + 1e-300)
        change = step[at, None] * (new - new.max(axis=1, keepdims=True) - message[live])
        message[live] += change
        np.add.at(total, dst[live], change)
        turned = np.bincount(at, (change * last[live]).sum(axis=1), len(step)) < 0
        step[turned | (sweep % longest == 0)] /= 2
        last[live] = change
        moves = np.bincount(at, np.abs(change).max(axis=1) > STILL, len(step)) > 0
        live = live[moves[at]]
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(graph: Field, model) -> dict[int, list[Span]]:
    """Confident unclamped tokens by text, neighbours of one kind joined, none across a base span."""
    p = beliefs(graph, model)
    best = p.argmax(axis=1)
    sure = (best > 0) & (p[np.arange(len(p)), best] >= CONFIDENCE) & (np.asarray(graph.label) == 0)
    nexts = set(graph.chain)
    out: dict[int, list[Span]] = {}
    for i in np.flatnonzero(sure):
        spans, kind = out.setdefault(graph.owner[i], []), KINDS[best[i] - 1]
        if spans and sure[i - 1] and best[i - 1] == best[i] and (i - 1, i) in nexts:
            spans[-1] = (kind, spans[-1][1], graph.where[i][1])
        else:
            spans.append((kind, *graph.where[i]))
    return out


def training_texts(docs: DataFrame, text: str, most: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> list[str]:
    """At most ``most`` distinct texts that hold a digit or an @, those with the smallest hashes.

    A first count sets a hash bound that about ``2 * most`` texts pass, so tasks send few rows at any size.
    """
    t = F.col(text)
    rows = docs.where(t.rlike("[0-9@]") & (F.char_length(t) <= chars)).select(t.alias("t"), F.xxhash64(t).alias("h"))
    n = rows.agg(F.approx_count_distinct("h").alias("n")).first()["n"]
    bound = -(1 << 63) + min((1 << 64) - 1, int((1 << 64) * 2 * most / max(n, 1)))
    few = rows.where(F.col("h") <= F.lit(bound)).groupBy("h").agg(F.min("t").alias("t"))
    return [r["t"] for r in few.orderBy("h").limit(most).collect()]


def found(docs: DataFrame, text: str = "text", model=...) -> DataFrame:
    """``docs`` as struct ``row`` with ``base`` and ``spans``: arrays of (kind, start, end)."""
    ship_package(docs.sparkSession)
    model = fit(training_texts(docs, text)) if model is ... else model
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("t"))
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def search(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("t").to_pylist()]
            for a, b in row_blocks([len(t) for t in texts]):
                graph, base = Field(), []
                for i in range(a, b):
                    if _TRIGGER.search(texts[i]):
                        base.append(base_spans(texts[i]))
                        graph.add(i, texts[i], base[-1])
                    else:
                        base.append([])
                more = added_spans(graph, model) if model is not None and graph.label else {}
                packed = lambda spans: pa.array([[dict(zip(("kind", "start", "end"), s)) for s in x] for x in spans], item)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row")[a:b], packed(base),
                     packed([x + more.get(i, []) for i, x in enumerate(base, a)])], ["row", "base", "spans"])

    kind = rows.schema["row"].dataType.simpleString()
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(search, f"row {kind}, base {span}, spans {span}")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; overlaps become one."""
    spans = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    body = F.col(f"row.`{text}`")
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, s):
        here = F.concat(acc["out"], F.substr(body, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                        F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.when(s["start"] >= acc["at"], here).otherwise(acc["out"]).alias("out"),
                        F.greatest(acc["at"], s["end"]).alias("at"))

    masked = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substr(body, (acc["at"] + 1).cast("int"))))
    rows = found(docs, text).withColumn("_masked", F.when(F.size("spans") > 0, masked).otherwise(body))
    return rows.select(*[F.col("_masked").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, base counts by kind, digest of the base spans and all spans as text."""
    rows = found(docs.select(doc_id, text), text)
    order = F.create_map(*[F.lit(x) for k, n in enumerate(KINDS) for x in (n, k)])
    line = lambda c: F.array_join(F.transform(F.array_sort(F.transform(c, lambda s: F.struct(
        F.element_at(order, s["kind"]).alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return rows.select(
        F.col(f"row.`{doc_id}`").alias("doc_id"),
        *[F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(line("base").cast("binary"), 256).alias("base_sha256"), line("spans").alias("spans"))


def _is(kind: str):
    return lambda s: s["kind"] == kind
