"""Secret scans: patterns of known kinds, and a character convolutional network over every candidate.

The network is numpy: an embedding of characters, one convolution, the maximum over positions, one dense layer. It
sees a candidate with the characters around it. It is fitted on labelled findings: candidates of a bounded sample of
documents, true where a known kind covers them and false where a rule shows them harmless, and a fixed number of findings made by rule (keys of many
shapes in many surroundings against identifiers, numbers, paths and words). Its scores are calibrated by Platt's
method on findings that it was not fitted on, and the threshold is the highest that still finds the required share of
the true ones there that no known kind covers. `Network.precision` tells what that costs.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capstrata.llm.common import in_parts, read_table
from capstrata.llm.ngrams import sigmoid
from capstrata.llm.quality import platt

KINDS = ("assign", "access", "hex", "network")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
#: A candidate for the network: so long a run of such characters.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_PLAIN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,8}")
#: Documents whose candidates are fitted on, the most candidates of each, and how much of the true findings a threshold must keep.
SAMPLE_DOCS, SAMPLE_PER_DOC, RECALL = 4000, 100, 0.95
BEFORE, INSIDE, AFTER = 20, 36, 8
#: Characters from one window of a long candidate to the next.
STRIDE = 12
_WIDTH, _FILTERS, _EMBED = 5, 16, 8
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_LEAST = min(HEX_LEAST, ACCESS_LEAST, 16)

Span = tuple[int, int, int]  # start, place in KINDS, end


def base_spans(text: str) -> list[Span]:
    """Spans of the three known kinds, by start and then kind."""
    found: list[Span] = []
    lowered = text.lower()
    if any(k in lowered for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    for start, word in _long_words(text):
        if "AKIA" in word:
            found += [(start + m.start(), 1, start + m.end()) for m in ACCESS.finditer(word) if m.end() - m.start() >= ACCESS_LEAST]
        found += [(start + m.start(), 2, start + m.end()) for m in HEX.finditer(word) if m.end() - m.start() >= HEX_LEAST]
    return sorted(found)


def _long_words(text: str) -> Iterator[tuple[int, str]]:
    """Words long enough to hold a finding, with their places. No finding of `access`, `hex` or the network has a blank."""
    at = 0
    for word in text.split():
        if len(word) >= _LEAST:
            at = text.index(word, at)
            yield at, word
            at += len(word)


def candidates(text: str, known: list[Span]) -> list[tuple[int, int, bool]]:
    """(start, end, whether known spans cover it) of each candidate; one that they cover in part is given by its parts."""
    found = []
    for start, word in _long_words(text):
        for m in CANDIDATE.finditer(word):
            at, end = start + m.start(), start + m.end()
            for s, _, e in known:
                if s >= end or e <= at:
                    continue
                if s > at:
                    found.append((at, s, False))
                found.append((max(s, at), min(e, end), True))
                at = e
            if at < end:
                found.append((at, end, False))
    return found


def harmless(value: str) -> bool:
    """Whether a candidate of no known kind is shown harmless: it consists of plain words and short numbers between its marks.

    A plain word is of letters of one case, or has one capital before them, however long it is: a run of letters alone is
    a word of some language before it is a key.
    """
    return all(_PLAIN.fullmatch(part) for part in re.split(r"[+/_=-]+", value) if part)


def windows_of(start: int, end: int) -> list[tuple[int, int]]:
    """Overlapping windows, by start and end, over the whole of a candidate."""
    last = max(start, end - INSIDE)
    return [(a, min(end, a + INSIDE)) for a in [*range(start, last, STRIDE), last]]


def window(text: str, start: int, end: int) -> np.ndarray:
    """Codes of the characters around and in one window of a candidate: 0 for none, 1 for any beyond ASCII, else the character's."""
    before = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    value = text[start : min(end, start + INSIDE)].ljust(INSIDE, "\0")
    after = text[end : end + AFTER].ljust(AFTER, "\0")
    points = np.frombuffer((before + value + after).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points >= 128, 1, points).astype(np.uint8)


@dataclass
class Network:
    """Weights of the network, its calibration, and the probability from which a candidate is a finding."""

    embed: np.ndarray
    filters: np.ndarray
    filter_bias: np.ndarray
    dense: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5
    #: Share of true ones among the held-out findings of no known kind that reach the threshold.
    precision: float = float("nan")
    #: Share of the held-out harmless candidates of documents, none of them made by rule, that reach it.
    false_alarms: float = float("nan")

    @classmethod
    def new(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        fan = _WIDTH * (_EMBED + 1)
        return cls(rng.normal(0, 0.5, (128, _EMBED)), rng.normal(0, np.sqrt(2 / fan), (fan, _FILTERS)), np.zeros(_FILTERS), rng.normal(0, 0.3, _FILTERS))

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Scores of a batch of windows, and what the gradient needs."""
        place = np.zeros((codes.shape[1], 1))
        place[BEFORE : BEFORE + INSIDE] = 1.0  # tells the candidate from what surrounds it
        x = np.concatenate([self.embed[codes], np.broadcast_to(place, (*codes.shape, 1))], axis=2)
        spans = codes.shape[1] - _WIDTH + 1
        columns = np.concatenate([x[:, k : k + spans] for k in range(_WIDTH)], axis=2)
        maps = columns @ self.filters + self.filter_bias
        at = maps.argmax(axis=1)
        top = np.maximum(np.take_along_axis(maps, at[:, None, :], 1)[:, 0], 0)
        return top @ self.dense + self.bias, (columns, at, top)

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.zeros(0)
        z = np.concatenate([self.forward(codes[i : i + 512])[0] for i in range(0, len(codes), 512)])
        return sigmoid(self.slope * z + self.offset)


def fit(codes: np.ndarray, y: np.ndarray, recall: float = RECALL, epochs: int = 10, seed: int = 7, known: np.ndarray | None = None, real: np.ndarray | None = None) -> Network:
    """Adam on four fifths of the findings; calibration and threshold on the rest.

    known: findings that a known kind covers (none by default), of which the threshold takes no account. real: those
    that documents hold (none by default).
    """
    net, rng = Network.new(seed), np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 4
    train = np.flatnonzero(~held)
    moments: dict[str, list] = {}
    step = 0
    balance = np.where(y == 1, 0.5 / max(1e-9, y[train].mean()), 0.5 / max(1e-9, 1 - y[train].mean()))
    for _ in range(epochs):
        rng.shuffle(train)
        for i in range(0, len(train), 64):
            rows = train[i : i + 64]
            z, (columns, at, top) = net.forward(codes[rows])
            error = (sigmoid(z) - y[rows]) * balance[rows] / len(rows)
            lit = error[:, None] * net.dense * (top > 0)
            picked = np.take_along_axis(columns[:, :, :, None], at[:, None, None, :], 1)[:, 0]  # rows, inputs, filters
            back = net.filters[None] * lit[:, None, :]
            embed = np.zeros_like(net.embed)
            for k in range(_WIDTH):
                of = np.take_along_axis(codes[rows], at + k, 1)  # rows, filters
                part = back[:, k * (_EMBED + 1) : k * (_EMBED + 1) + _EMBED].transpose(0, 2, 1)
                np.add.at(embed, of.ravel(), part.reshape(-1, _EMBED))
            gradients = {"embed": embed, "filters": np.einsum("rif,rf->if", picked, lit), "filter_bias": lit.sum(0), "dense": top.T @ error, "bias": error.sum()}
            step += 1
            for name, g in gradients.items():
                m = moments.setdefault(name, [0.0, 0.0])
                m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
                setattr(net, name, getattr(net, name) - 0.01 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8))
    z = net.forward(codes[held])[0]
    net.slope, net.offset = platt(z, y[held])
    p, alone = sigmoid(net.slope * z + net.offset), np.ones(int(held.sum()), bool) if known is None else ~known[held]
    true = np.sort(p[alone & (y[held] == 1)])
    if len(true):
        net.threshold = float(true[int((1 - recall) * len(true))])
        net.precision = float(y[held][alone & (p >= net.threshold)].mean())
    if real is not None and (harm := real[held] & (y[held] == 0)).any():
        net.false_alarms = float((p[harm] >= net.threshold).mean())
    return net


def made_findings(count: int = 3000, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Labelled findings made by rule: windows, and 1 for a secret."""
    rng = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda chars, low, high: "".join(rng.choice(chars) for _ in range(rng.randint(low, high)))
    word = lambda: some(lower, 2, 9)
    syllable = lambda: rng.choice("bcdfghklmnprstvwz") + rng.choice("aeiou") + rng.choice(("", "", "n", "r", "s"))
    secrets = (
        lambda: some(lower + upper + digits, 20, 44),
        lambda: some(lower + upper + digits + "+/", 24, 64) + rng.choice(("", "=", "==")),
        lambda: rng.choice(("sk_live_", "pk_test_", "key-", "tok_", "gh_", "pat-")) + some(lower + upper + digits, 20, 36),
        lambda: some(lower + upper, 16, 40),
        lambda: some(lower + upper + digits, 16, 20),
        lambda: some(upper + digits, 20, 32),
        lambda: some(lower + digits, 24, 40),
        lambda: some(lower + upper + digits + "_-", 28, 48),
    )
    others = (
        lambda: "-".join(word() for _ in range(4)) + "-" + some(digits, 1, 4),
        lambda: "/".join(word() for _ in range(4)) + "/" + some(digits, 1, 6),
        lambda: "_".join(word() for _ in range(4)) + some(digits, 1, 3),
        lambda: word() + word() + word() + some(digits, 1, 4),
        lambda: f"{some(digits, 4, 4)}-{some(digits, 2, 2)}-{some(digits, 2, 2)}T{some(digits, 6, 6)}Z",
        lambda: word().title() + word().title() + word().title() + some(digits, 1, 3),
        lambda: some(digits, 14, 20) + rng.choice(("px", "ms", "kb")),
        lambda: "".join(syllable() for _ in range(rng.randint(8, 12))),
        lambda: "".join(syllable() for _ in range(rng.randint(8, 12))).title(),
        lambda: "/".join("".join(syllable() for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(4, 14))),
        lambda: rng.choice("=-_") * rng.randint(16, 60),
        lambda: "=" * rng.randint(12, 20) + some(digits, 1, 3) + word(),
        lambda: some(lower, 16, 36),
        lambda: "".join(syllable() for _ in range(rng.randint(3, 5))) + some(lower, 3, 8) + "".join(syllable() for _ in range(rng.randint(2, 5))),
        lambda: some(lower, 16, 30).capitalize(),
        lambda: rng.choice((some(upper, 16, 30), "".join(syllable() for _ in range(rng.randint(8, 12))).upper())),
        lambda: "/" + word() + "/" + some(digits, 4, 4) + "/" + some(digits, 2, 2) + "/" + word() + "-" + word(),
    )
    leads = (lambda: word() + " " + word() + " ", lambda: word() + ". ", lambda: word() + ": ", lambda: word() + ' = "', lambda: word() + "=", lambda: "", lambda: "\n")
    codes, y = [], []
    for i in range(count):
        true = i % 2
        value, lead = rng.choice(secrets if true else others)(), rng.choice(leads)()
        if len(value) < 16:
            value += some(lower, 16, 20) if not true else some(lower + digits, 16, 20)
        text = lead + value + rng.choice((" ", '" ', ".", "\n", "")) + word()
        ends = windows_of(len(lead), len(lead) + len(value))
        if true and rng.random() < 0.3:  # a key at the end of a longer run: only its last window is sure to hold it
            run = "/".join(word() for _ in range(rng.randint(1, 8))) + rng.choice("/=_-")
            text, ends = lead + run + text[len(lead) :], windows_of(len(lead), len(lead) + len(run) + len(value))[-1:]
        codes.append(window(text, *(ends[0] if true else rng.choice(ends))))
        y.append(true)
    return np.array(codes), np.array(y, np.float64)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Network:
    """Fits the network on the candidates of a bounded sample of documents, the first by a hash of their id, and on made findings.

    docs: doc_id, text; rows without doc_id are not in the sample, null and empty texts have no candidates, repeated rows
    count each. At most `sample_docs` documents, SAMPLE_PER_DOC candidates of each and `sample_docs` candidates in all
    are used. Without any, or without rows, the made findings alone are.
    """
    chosen = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(it):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                known = base_spans(text or "")
                rows += [{"doc_id": doc, "start": s, "codes": window(text, s, e).tobytes(), "secret": int(k)} for s, e, k in candidates(text or "", known)[:SAMPLE_PER_DOC] if k or harmless(text[s:e])]
            yield pa.RecordBatch.from_pylist(rows, schema=_LABELLED)

    found = texts.mapInArrow(batches, "doc_id long, start long, codes binary, secret int").orderBy(F.xxhash64("doc_id", "start"), "doc_id", "start", "codes").limit(sample_docs).collect()
    codes, y = made_findings()
    if found:
        codes = np.concatenate([codes, np.array([np.frombuffer(r.codes, np.uint8) for r in found])])
        y = np.concatenate([y, np.array([r.secret for r in found], np.float64)])
    real = np.arange(len(y)) >= len(y) - len(found)
    mixed = np.random.default_rng(3).permutation(len(y))
    return fit(codes[mixed], y[mixed], known=(real & (y == 1))[mixed], real=real[mixed])


_LABELLED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("codes", pa.binary()), ("secret", pa.int32())])


def scored_candidates(texts: list[str], net: Network, base: list[list[Span]]) -> list[tuple[int, int, int, bool, float]]:
    """(text, start, end, whether known spans cover it, probability) of every candidate: the highest of its windows."""
    all_ = [(i, s, e, known) for i, t in enumerate(texts) for s, e, known in candidates(t, base[i])]
    parts = ((k, a, b) for k, (_, s, e, _) in enumerate(all_) for a, b in windows_of(s, e))
    best = np.zeros(len(all_))
    while part := list(islice(parts, 4096)):
        p = net.probabilities(np.array([window(texts[all_[k][0]], a, b) for k, a, b in part]))
        np.maximum.at(best, [k for k, _, _ in part], p)
    return [(*c, float(p)) for c, p in zip(all_, best, strict=True)]


def spans_of(texts: list[str], net: Network, scored: list | None = None) -> list[list[Span]]:
    """All spans of each text: the known kinds, whatever the network says of them, and the other candidates that it accepts
    and that are not shown harmless.

    `scored` takes what scored_candidates() gives, if it was asked for before.
    """
    found = [base_spans(t) for t in texts]
    for i, s, e, known, p in scored_candidates(texts, net, found) if scored is None else scored:
        if not known and p >= net.threshold and not harmless(texts[i][s:e]):
            found[i].append((s, 3, e))
    return [sorted(f) for f in found]


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by the mark; of an assignment only its value."""
    out, at = [], 0
    for s, k, e in spans:
        if k == 0:
            s = ASSIGN.match(text, s).start(2)
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join(out) + text[at:]


def scan(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_scored, known_score) for each row.

    Whole texts are scanned; a null text has no spans, repeated rows are scanned alike. n_scored: candidates that the
    network scored; known_score: the least of what it gave those that known kinds cover, null without any.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(it):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            scored = scored_candidates(texts, net, [base_spans(t) for t in texts])
            found = spans_of(texts, net, scored)
            count, least = np.zeros(len(texts), np.int64), [None] * len(texts)
            for i, _, _, known, p in scored:
                count[i] += 1
                if known:
                    least[i] = p if least[i] is None else min(p, least[i])
            base = [[x for x in f if x[1] < 3] for f in found]
            columns = [pa.array([sum(x[1] == k for x in b) for b in base], pa.int64()) for k in range(3)]
            digests = [hashlib.sha256(join_spans(b).encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests, pa.string()), pa.array([join_spans(f) for f in found], pa.string()), pa.array(count), pa.array(least, pa.float64())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_scored", "known_score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(batches, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_scored long, known_score double")


def redacted(docs: DataFrame, net: Network) -> DataFrame:
    """docs with every finding in `text` replaced by a mark; n_chars, where there is one, follows the new text.

    Null texts stay null and empty ones empty, repeated rows are redacted alike, further columns stay as they are; no rows: none.
    """
    columns = docs.columns
    place = columns.index("text")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(it):
            texts = batch.column(place).to_pylist()
            found = spans_of([t or "" for t in texts], net)
            new = [redact(t, f) if f else t for t, f in zip(texts, found, strict=True)]
            yield batch.set_column(place, batch.schema.field(place), pa.array(new, batch.schema.field(place).type))

    out = docs.mapInArrow(batches, docs.schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in every document, by a network fitted on a bounded sample of them. Null and empty texts have none;
    repeated rows are scanned alike; no rows, no result.
    """
    docs = read_table(spark, sf_dir, "documents")
    return scan(docs, train(docs))
