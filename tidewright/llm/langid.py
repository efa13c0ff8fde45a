"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is kept. A text is parsed
greedily into the longest matches that occur in that labelled text: c phrases.
``c * log2(N) / n`` (N and n the lengths of the labelled text and of the text)
estimates the cross entropy of the text under the language's source, and the
language with the least wins. No n-gram order or smoothing has to be chosen.

Fitting reads a bounded sample of labelled rows: for every label the row of
smallest hash in each of ``buckets`` hash buckets, of rows of at most
``row_chars`` characters, whole rows in the order of their hashes up to
``lang_chars`` characters a label and ``total_chars`` in all. At most
``buckets`` rows a label reach the driver, however often a row is repeated. The
sample's text goes to the executors, which build the automata once each; a
worker's memory is bounded by ``total_chars`` (two states a character, one row
of ``DENSE`` steps a state) and doesn't depend on the input.

Texts are parsed whole. They are lower-cased, letters (Unicode category L) keep
their identity, every run of other characters is one space. Steps by the
commonest letters are in a dense table, those by all other letters in a sorted
list. Segments of ``SEGMENT`` characters are parsed side by side, all languages
at once, each as if a phrase began with it; then every segment is parsed again
from the state in which the one before it ended, until its phrases begin where
they began before, and again while that changes the state at its end. So
phrases cross segments as in one parse from left to right.

Defined results: null text or text without letters is ``und`` with score 0;
with one label, that label with score 1; ties go to the label that sorts first;
without any labelled row every text is ``und``; repeated rows are predicted
each; a text of any length is parsed to its end; other columns are ignored, and
kept columns may have any names but those of the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.worker import kept, slices

BUCKETS = 64
ROW_CHARS = 20_000
LANG_CHARS = 40_000
TOTAL_CHARS = 320_000
SEGMENT = 256
#: Characters that are parsed side by side.
GROUP_CHARS = 1_000_000
#: Letters with a column of their own in the table of steps.
DENSE = 48
_MOST_LABELS = 2_000
_NEW = 1 << 30


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS, row_chars: int = ROW_CHARS, lang_chars: int = LANG_CHARS, total_chars: int = TOTAL_CHARS) -> dict[str, list[str]]:
    """The sample's texts by label."""
    usable = labelled.filter(F.col(lang_col).isNotNull() & (F.length(text_col) > 0) & (F.length(text_col) <= row_chars))
    hashed = usable.select(F.col(lang_col).alias("lang"), F.xxhash64(F.lit("langid"), F.col(id_col)).alias("h"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("t"))
    picked = hashed.filter("id is not null").groupBy("lang", F.pmod("h", F.lit(buckets)).alias("b")).agg(F.min(F.struct("h", "id", "t")).alias("m")).select("lang", "m.*").limit(_MOST_LABELS * buckets + 1).collect()
    if len(picked) > _MOST_LABELS * buckets:
        raise ValueError(f"more than {_MOST_LABELS} labels")
    labels = sorted({r["lang"] for r in picked})
    each = min(lang_chars, total_chars // max(1, len(labels)))
    order = {(r["lang"], r["id"], r["t"]): r["h"] for r in picked}
    if not order:
        return {}
    # One row a label, id and text, whatever number of rows repeat them.
    keys = [F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("t")]
    rows = usable.filter(F.col(id_col).isin(sorted({i for _, i, _ in order}))).select(*keys, F.col(text_col).alias("text"))
    rows = rows.filter(F.col("t").isin([t for _, _, t in order])).groupBy("lang", "id", "t").agg(F.min("text").alias("text")).collect()
    found: dict[str, list[str]] = {}
    used: Counter = Counter()
    for r in sorted((r for r in rows if (r["lang"], r["id"], r["t"]) in order), key=lambda r: (r["lang"], order[r["lang"], r["id"], r["t"]], r["text"])):
        lang, text = r["lang"], r["text"]
        if any(map(str.isalpha, text)) and (used[lang] + len(text) <= each or lang not in found):
            found.setdefault(lang, []).append(text)
            used[lang] += len(text)
    return found


class CrossParser:
    """The automata of all labels as one table, and the parser."""

    def __init__(self, sample: dict[str, list[str]]):
        self.labels = sorted(sample)
        counts = Counter(c for texts in sample.values() for text in texts for c in text.lower() if c.isalpha())
        letters = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
        # Codes: 0 pads, 1 is space, 2 a letter that the sample lacks, then its letters, commonest first.
        self.code = np.fromiter((2 if chr(c).isalpha() else 1 for c in range(0x110000)), np.int32, 0x110000)
        self.code[[ord(c) for c in letters]] = np.arange(3, 3 + len(letters))
        self.width = min(DENSE, len(letters)) + 3
        tables, self.roots, self.bits, states, rare = [], [], [], 0, []
        for label in self.labels:
            step, length = self._automaton([self.codes([text])[0] for text in sample[label]])
            table = np.full((len(step), self.width), -1, np.int32)
            for state, out in enumerate(step):
                for c, to in out.items():
                    if c < self.width:
                        table[state, c] = to
                    else:
                        rare.append((state + states, c, to + states))
            # A phrase starts with every step out of the root, and with every step that leaves a match.
            starts = table < 0
            starts[0] = True
            np.copyto(table, np.maximum(table[0], 0), where=table < 0)
            table += np.int32(states)
            np.add(table, np.int32(_NEW), out=table, where=starts)
            table[:, 0] = np.arange(len(step)) + states
            n = len(step)
            del step, starts
            tables.append(table)
            self.roots.append(states)
            self.bits.append(np.log2(max(2, length)))
            states += n
        if states >= _NEW:
            raise ValueError("the sample is too large")
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        keys = np.array([s * len(self.code) + c for s, c, _ in rare], np.int64)
        order = np.argsort(keys, kind="stable")
        self.rare_keys, self.rare_to = np.append(keys[order], np.iinfo(np.int64).max), np.append(np.array([t for _, _, t in rare], np.int32)[order], 0).astype(np.int32)

    def step(self, state: np.ndarray, codes: np.ndarray, root: np.ndarray) -> np.ndarray:
        """States after one more character each; ``_NEW`` is added where it starts a phrase."""
        dense = codes < self.width
        found = self.table.take(state * self.width + np.where(dense, codes, 2))
        i = np.flatnonzero(~dense)
        if len(i):
            found[i] = self._rare(state[i], codes[i], root[i])
        return found

    def _rare(self, state: np.ndarray, codes: np.ndarray, root: np.ndarray) -> np.ndarray:
        def out(s):
            key = s.astype(np.int64) * len(self.code) + codes
            at = np.searchsorted(self.rare_keys, key)
            return self.rare_keys[at] == key, self.rare_to[at]

        goes, to = out(state)
        first, begins = out(root)
        return np.where(goes & (state != root), to, np.where(first, begins, root) + _NEW).astype(np.int32)

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts, runs of spaces as one, and each text's number of codes."""
        lower = [text.lower() for text in texts]
        flat = self.code[np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), "<u4")]
        ends = np.cumsum([len(x) for x in lower])
        keep = np.ones(len(flat), bool)
        keep[1:] = (flat[1:] != 1) | (flat[:-1] != 1)
        keep[ends[:-1][ends[:-1] < len(flat)]] = True
        sizes = np.diff(np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])])
        return flat[keep], sizes

    def _automaton(self, texts: list[np.ndarray]) -> tuple[list[dict[int, int]], int]:
        """Suffix automaton of the texts one after another; matches don't cross from one to the next."""
        step, link, length = [{}], [-1], [0]
        for text in texts:
            last = 0
            for c in text.tolist():
                there = step[last].get(c)
                if there is not None and length[there] == length[last] + 1:
                    last = there
                    continue
                if there is None:
                    new, at = len(step), last
                    step.append({})
                    length.append(length[last] + 1)
                    link.append(0)
                    while at >= 0 and c not in step[at]:
                        step[at][c] = new
                        at = link[at]
                    last, old = new, (step[at][c] if at >= 0 else -1)
                    if old < 0:
                        continue
                    if length[old] == length[at] + 1:
                        link[new] = old
                        continue
                else:
                    new, at, old = -1, last, there
                copy = len(step)
                step.append(dict(step[old]))
                length.append(length[at] + 1)
                link.append(link[old])
                link[old] = copy
                if new >= 0:
                    link[new] = copy
                else:
                    last = copy
                while at >= 0 and step[at].get(c) == old:
                    step[at][c] = copy
                    at = link[at]
        return step, sum(map(len, texts))

    def phrases(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases (labels x texts) of texts of ``sizes`` codes one after another."""
        parts = -(-sizes // SEGMENT)
        first = np.concatenate([[0], np.cumsum(parts)])
        padded = np.zeros(first[-1] * SEGMENT, np.int32)
        shift = first[:-1] * SEGMENT - np.concatenate([[0], np.cumsum(sizes)[:-1]])
        padded[np.arange(len(flat)) + np.repeat(shift, sizes)] = flat
        grid = np.ascontiguousarray(padded.reshape(-1, SEGMENT).T)
        n = grid.shape[1]
        later = np.ones(n, bool)
        later[first[:-1][parts > 0]] = False
        counts = np.zeros((len(self.labels), len(sizes)), np.int64)
        for k in range(len(self.labels)):
            root = np.full(n, self.roots[k], np.int32)
            state, begins = root.copy(), np.zeros((SEGMENT, n), bool)
            for i, column in enumerate(grid):
                state = self.step(state, column, root)
                begins[i] = state >= _NEW
                state &= _NEW - 1
            # A segment goes on where the one before it ended; that may change where it ends itself.
            todo = np.flatnonzero(later)
            into = root.copy()
            while len(todo):
                todo = todo[state[todo - 1] != into[todo]]
                into[todo] = state[todo - 1]
                at, now = todo, into[todo]
                for i in range(SEGMENT):
                    if not len(at):
                        break
                    now = self.step(now, grid[i, at], root[at])
                    new = now >= _NEW
                    now &= _NEW - 1
                    met = new & begins[i, at]
                    begins[i, at] = new
                    at, now = at[~met], now[~met]
                changed = at[state[at] != now]
                state[at] = now
                todo = changed[(changed + 1 < n) & later[np.minimum(changed + 1, n - 1)]] + 1
            sums = np.concatenate([[0], np.cumsum(begins.sum(0))])
            counts[k] = sums[first[1:]] - sums[first[:-1]]
        return counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        labels, scores = ["und"] * len(texts), [0.0] * len(texts)
        known = [i for i, text in enumerate(texts) if self.labels and text]
        while known:
            size, end = 0, 0
            while end < len(known) and (not end or size + len(texts[known[end]]) <= GROUP_CHARS):
                size += len(texts[known[end]])
                end += 1
            now, known = known[:end], known[end:]
            flat, sizes = self.codes([texts[i] for i in now])
            ends = np.cumsum(sizes)
            letters = np.concatenate([[0], np.cumsum(flat > 1)])
            has = letters[ends] > letters[ends - sizes]
            entropy = self.phrases(flat, sizes) * np.array(self.bits)[:, None] / sizes
            best = entropy.argmin(0)
            two = np.sort(entropy, 0)[:2]
            score = 1 - two[0] / np.maximum(two[1], 1e-300) if len(two) > 1 else np.ones(len(now))
            for i, b, s, ok in zip(now, best, score, has, strict=True):
                if ok:
                    labels[i], scores[i] = self.labels[b], float(s)
        return labels, scores


def classify(docs: DataFrame, sample: dict[str, list[str]], *, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of all rows with lang_pred and score."""
    chosen = docs.select(*keep, F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(sample)
    names = [*chosen.columns[:-1], "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = shared.value
        parser = kept(("langid", hash(tuple((k, tuple(v)) for k, v in sorted(texts.items())))), lambda: CrossParser(texts))
        for batch in slices(batches, 2000):
            labels, scores = parser.predict(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names)

    kinds = [f"`{x}` {chosen.schema[x].dataType.simpleString()}" for x in names[:-2]]
    return chosen.mapInArrow(run, ", ".join([*kinds, "lang_pred string", "score double"]))


def held_out(id_col: str = "doc_id") -> Column:
    """Every fourth row by the checksum of its id; such rows are never learned from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2
