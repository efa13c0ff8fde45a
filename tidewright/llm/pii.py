"""Personal data: base patterns, and a skip-chain conditional random field beside them.

The base finds emails, IP addresses, card and phone numbers by their patterns
(leftmost, non-overlapping, kind by kind; matches that fail the kind's test are
dropped). ``base_spans`` gives exactly what the patterns give, but looks only
around an ``@``, a ``+`` or a digit, and in time linear in the text.

The field labels *chunks*: runs of digits and number punctuation, and words with
an ``@`` or a digit. Its potentials are

* a chunk's shape (number of digits, separators, check digit, letters, ...);
* neighbouring chunks, label by label;
* skip edges, label by label: chunks of a document that are alike (same digits,
  same mailbox name), however far apart.

A chunk that the base found has its label given. Loopy sum-product message
passing carries labels along the edges, so that ``555-0142 (988)`` becomes a
phone number where the document has ``+1 (988) 555 0142``. Chunks that end up
with a label of probability over one half and touch no base span are added.
Chunks alike are linked in a row and to the first of them: a number of edges
that is linear in the document. Every document with a chunk is decoded; the
graphs of a slice of documents are passed over together.

All weights are fitted together, by pseudo-likelihood with a normal prior, on at
most ``SAMPLES`` documents with digits or an ``@`` (the one of smallest hash in
each of as many buckets, of at most ``SAMPLE_CHARS`` characters), with the base's
labels. As a shape mostly tells its label by itself, each chunk is also taken
with its shape blurred to the number of digits: what its neighbours and those
alike tell is then learned too. The prior has chunks alike agree by ``ALIKE``;
chunks alike one that the base found, but passed over by it, are no examples.

Defined results: a null text is empty; no digit and no ``@`` means no spans; a
null id is kept; repeated rows are searched each; texts of any length are
searched whole, in time linear in text, chunks and spans; chunks whose labels tie
take the first of none, email, ip, card, phone; an empty table gives no rows;
without a sample the field adds nothing; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.worker import drop, slices

SAMPLES = 1024
SAMPLE_CHARS = 20_000
KINDS = ("email", "ip", "card", "phone")
ROUNDS = 12
#: Before any example, how much likelier it is (in logarithms) that chunks alike have one label.
ALIKE = 6.0
STEPS = 300

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_MARK = re.compile(r"[0-9@]")
_CHUNK = re.compile(r"[+(]?[0-9](?:[0-9().+-]|[ ](?=[(0-9]))*(?![^\s.,;:!?)\]}\"'])|\S+")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    """The check of card numbers: doubled every second digit from the right, sums to a multiple of ten."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if not i % 2 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all base matches, by kind, then start."""
    found = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            found.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.groups()):
                found.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    found.append((3, m.start(), m.end()))
    return found


def chunks(text: str) -> list[tuple[int, int]]:
    """Spans of number runs and of words with an ``@`` or a digit, without punctuation around."""
    found = []
    for m in _CHUNK.finditer(text):
        a, b = m.span()
        if not _MARK.search(text, a, b):
            continue
        while b > a and text[b - 1] in ".,;:!?)]}\"'" and not (text[b - 1] == ")" and "(" in text[a:b]):
            b -= 1
        while a < b and text[a] in "[{\"'" :
            a += 1
        if a < b:
            found.append((a, b))
    return found


#: The features that a blurred shape keeps: the first, and the numbers of digits.
_BLURRED = np.array([i == 0 or 10 <= i <= 15 for i in range(18)] + [True])


def features(chunk: str) -> list[float]:
    """The shape of a chunk as zeros and ones; the last is one for blurred shapes."""
    digits = _NOT_DIGIT.sub("", chunk)
    n = len(digits)
    letters = any(map(str.isalpha, chunk))
    return [
        1.0, "@" in chunk, chunk.count("@") == 1 and "." in chunk.rpartition("@")[2], letters, chunk[:1] == "+", "(" in chunk,
        chunk.count(".") == 3 and not letters, "." in chunk, "-" in chunk, " " in chunk,
        n == 0, 1 <= n <= 4, 5 <= n <= 8, 9 <= n <= 12, 13 <= n <= 19, n > 19, 13 <= n <= 19 and luhn(digits), chunk[:1] == "+" and 9 <= n <= 15, 0.0,
    ]


def likeness(chunk: str) -> str | None:
    """What chunks that are alike have in common."""
    if "@" in chunk:
        return "m" + chunk.partition("@")[0].lower()
    digits = _NOT_DIGIT.sub("", chunk)
    if any(c.isalpha() for c in chunk):
        return "m" + chunk.lower() if digits else None
    return "d" + digits.lstrip("0")[-9:] if len(digits) >= 7 else None


def skip_edges(keys: list[str | None]) -> list[tuple[int, int]]:
    """Pairs of chunks alike: each with the one before it and with the first."""
    seen: dict[str, list[int]] = {}
    edges = []
    for i, key in enumerate(keys):
        if key is None:
            continue
        if key in seen:
            first, last = seen[key]
            edges.append((first, i))
            if last != first:
                edges.append((last, i))
            seen[key][1] = i
        else:
            seen[key] = [i, i]
    return edges


def labels_of(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[int]:
    """1 + kind of the base span that covers most of each chunk, if half of it at least, or 0."""
    best = [(0, 0)] * len(spans)
    for kind in range(len(KINDS)):
        own = sorted((s, e) for k, s, e in base if k == kind)  # they don't overlap
        j = 0
        for i, (a, b) in enumerate(spans):
            while j < len(own) and own[j][1] <= a:
                j += 1
            k = j
            while k < len(own) and own[k][0] < b:
                best[i] = max(best[i], (min(b, own[k][1]) - max(a, own[k][0]), kind + 1))
                k += 1
            j = max(j, k - 1)
    return [label if 2 * size >= b - a else 0 for (a, b), (size, label) in zip(spans, best, strict=True)]


class Graph:
    """The chunks of some texts, their shapes and edges, and the labels that the base gives."""

    def __init__(self, texts: list[str], bases: list[list[tuple[int, int, int]]]):
        shape, self.given, near, skip, self.spans, self.first = [], [], [], [], [], [0]
        for text, base in zip(texts, bases, strict=True):
            own = chunks(text)
            at = len(self.given)
            shape += [features(text[a:b]) for a, b in own]
            self.given += labels_of(own, base)
            near += [(at + i, at + i + 1) for i in range(len(own) - 1)]
            skip += [(at + a, at + b) for a, b in skip_edges([likeness(text[a:b]) for a, b in own])]
            self.spans.append(own)
            self.first.append(len(self.given))
        self.shape = np.array(shape, float).reshape(-1, len(_BLURRED))
        self.given = np.array(self.given, np.int64)
        self.near, self.skip = (np.array(e, np.int64).reshape(-1, 2) for e in (near, skip))

    def around(self, edges: np.ndarray, labels: int) -> np.ndarray:
        """How many chunks of each label are linked to each chunk."""
        found = np.zeros((len(self.given), labels))
        for a, b in ((0, 1), (1, 0)):
            np.add.at(found, (edges[:, a], self.given[edges[:, b]]), 1.0)
        return found


class Field:
    """The weights: shapes x labels, and labels x labels for neighbours and for chunks alike."""

    def __init__(self, shape: np.ndarray, near: np.ndarray, skip: np.ndarray):
        self.shape, self.near, self.skip = shape, near, skip

    @classmethod
    def fit(cls, texts: list[str]) -> "Field | None":
        """Maximum pseudo-likelihood under the prior, by accelerated gradient steps."""
        graph, k = Graph(texts, [base_spans(text) for text in texts]), len(KINDS) + 1
        if not len(graph.given):
            return None
        blurred = graph.shape * _BLURRED
        blurred[:, -1] = 1.0
        around = np.concatenate([graph.around(graph.near, k), graph.around(graph.skip, k)], 1)
        # That the patterns pass over a chunk alike one that they found says nothing about its label.
        told = np.flatnonzero((graph.given > 0) | (around[:, k + 1 :].sum(1) == 0))
        x = np.concatenate([np.concatenate([s[told], around[told]], 1) for s in (graph.shape, blurred)])
        y = np.eye(k)[np.tile(graph.given[told], 2)]
        f = graph.shape.shape[1]
        prior = np.zeros((x.shape[1], k))
        prior[f + k :] = ALIKE * np.eye(k)
        # An example weighs no more for having many chunks around it.
        step = 4.0 / max(1.0, float((x**2).sum(1).mean()))
        w, ahead = prior.copy(), prior.copy()
        for i in range(STEPS):
            z = x @ ahead
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            new = ahead + step * (x.T @ (y - p) / len(x) - 1e-4 * (ahead - prior))
            for a in (f, f + k):
                new[a : a + k] = (new[a : a + k] + new[a : a + k].T) / 2
            ahead = new + i / (i + 3) * (new - w)
            w = new
        return cls(w[:f], w[f : f + k], w[f + k :])

    def beliefs(self, graph: Graph, rounds: int = ROUNDS) -> np.ndarray:
        """Probabilities of the labels of all chunks, by loopy message passing."""
        unary = graph.shape @ self.shape
        known = np.flatnonzero(graph.given)
        unary[known] = -30.0
        unary[known, graph.given[known]] = 30.0
        belief = unary
        edges = np.concatenate([graph.near, graph.skip])
        if len(edges):
            e = np.concatenate([edges, edges[:, ::-1]])
            skip = np.tile(np.arange(len(edges)) >= len(graph.near), 2)
            back = (np.arange(len(e)) + len(edges)) % len(e)
            near, alike = np.exp(self.near), np.exp(self.skip)
            message = np.zeros((len(e), unary.shape[1]))
            for _ in range(rounds):
                belief = unary.copy()
                np.add.at(belief, e[:, 1], message)
                out = belief[e[:, 0]] - message[back]
                out = np.exp(out - out.max(1, keepdims=True))
                new = np.log(np.maximum(np.where(skip[:, None], out @ alike, out @ near), 1e-300))
                new -= new.max(1, keepdims=True)
                message = 0.5 * message + 0.5 * new
            belief = unary.copy()
            np.add.at(belief, e[:, 1], message)
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def decode_all(self, texts: list[str], bases: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        """Spans to add to the base's, text by text."""
        graph = Graph(texts, bases)
        p = self.beliefs(graph)
        label = p.argmax(1) if len(p) else np.zeros(0, np.int64)
        add = (label > 0) & (graph.given == 0) & (p.max(1, initial=0) > 0.5)
        found = []
        for i, base in enumerate(bases):
            own, at = [], graph.first[i]
            taken, j = sorted((s, e) for _, s, e in base), 0
            ends = np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []
            for k in np.flatnonzero(add[at : graph.first[i + 1]]).tolist():
                a, b = graph.spans[i][k]
                while j < len(taken) and taken[j][0] < b:  # spans that start before the chunk ends
                    j += 1
                if not (j and ends[j - 1] > a):
                    own.append((int(label[at + k]) - 1, a, b))
            found.append(own)
        return found

    def decode(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        return self.decode_all([text], [base])[0]


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Field | None:
    """The field fitted on a bounded sample of ``docs``."""
    usable = docs.filter((F.length(text_col) <= SAMPLE_CHARS) & F.col(text_col).rlike("[0-9@]"))
    hashed = usable.select(F.xxhash64(F.lit("pii"), id_col).alias("h"), F.col(id_col).alias("id"))
    picked = hashed.groupBy(F.pmod("h", F.lit(SAMPLES))).agg(F.min(F.struct("h", "id")).alias("m")).select("m.id").collect()
    ids = [r["id"] for r in picked if r["id"] is not None]
    rows = usable.filter(F.col(id_col).isin(ids)).groupBy(F.col(id_col).alias("id")).agg(F.min(text_col).alias("text")).collect() if ids else []
    return Field.fit([r["text"] for r in sorted(rows, key=lambda r: r["id"])])


def find_spans(docs: DataFrame, field: Field | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added): arrays of (kind, start, end), code points, end exclusive."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def pack(found: list[list[tuple[int, int, int]]]) -> pa.Array:
        ends = np.zeros(len(found) + 1, np.int32)
        np.cumsum([len(x) for x in found], out=ends[1:])
        flat = np.array([x for own in found for x in own], np.int32).reshape(-1, 3)
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["kind", "start", "end"])).cast(span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop()
        for batch in slices(batches):
            texts = [text if text and _MARK.search(text) else "" for text in batch.column(1).to_pylist()]
            base = [base_spans(text) for text in texts]
            added = field.decode_all(texts, base) if field else [[]] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pack(base), pack(added)], ["id", "base", "added"])

    kind = "array<struct<kind: int, start: int, end: int>>"
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, base {kind}, added {kind}")


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end`` by kind, then start, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
