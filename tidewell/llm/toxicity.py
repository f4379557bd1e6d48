"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are given for documents, so the labelled tokens the field learns from are derived first. Over all labelled
documents, words and beginnings of words are counted in toxic and in other documents; for those that are notably more
frequent in toxic ones, the distinct contexts (word before, word after) are counted and must be significantly so. Copies
of one document share their contexts, so a word of one much-copied text counts little. What passes marks tokens of toxic
documents; all other tokens are clean. The field (two states, features of
the word, its ends, its shape and its neighbours, hashed) is fitted on a bounded sample of windows. Forward-backward marginals of all tokens of a text then give
its offending spans and, over a logistic curve fitted on labelled documents, its score.

Bounds: about ``WINDOWS`` windows of ``SPAN`` tokens for each of three kinds (with a toxic token, with such a word in a clean document,
others) and ``CURVE`` labelled documents, both by least hash, so the fit has
a fixed size; the counts cover all labelled rows, and scoring covers every token of every text.

Defined results: a null text is an empty one and scores like a text without any toxic token. A document id that is labelled
more than once counts as toxic if one of its labels says so; null labels and null ids are no labels. Repeated rows are scored
each. Without any toxic or any clean label all scores are the share of toxic labels (0 without labels). Labels, language, source
and id are never inputs of a score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  not loaded by pyarrow itself
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import materialize

TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[^\w\s]+|_+")
BITS = 18  # of a feature's hash
WINDOWS = 3000  # windows to learn from, of each kind
SPAN = 32  # tokens of a window
CURVE = 4000  # labelled documents the curve is fitted on
STEPS = 60  # of the field's fit
KEPT_WORDS = 200_000  # words whose features a worker keeps
AT_ONCE = 1 << 20  # characters scored at a time
BLOCK = 256  # tokens between two carries of the chain
SEEN = 3  # distinct contexts a toxic word needs at least
PREFIXES = range(3, 8)  # lengths of beginnings that are counted besides whole words
RATIO = 8.0  # times the rate in other documents
CUT = 0.5  # marginal from which a token offends


# ---- features --------------------------------------------------------------------------------------------------------------


MASK = (1 << BITS) - 1
SEEDS = {k: zlib.crc32(k.encode()) for k in ("w:", "p:", "q:", "r:", "s:", "f:", "before:", "after:")}  # each kind of feature hashes on from its own start
SHAPES = {k: zlib.crc32(k.encode(), SEEDS["f:"]) & MASK for k in ("upper", "title", "lower", "mark")}
BIAS = zlib.crc32(b"bias") & MASK


def features(word: str) -> tuple[int, ...]:
    """Hashed features of a token: seven for its own state, then one for the state of the next token and one for that of the one before.

    Ends of words are counted in bytes.
    """
    w, crc = word.lower().encode(), zlib.crc32
    shape = "mark" if not word[0].isalpha() else "lower" if word.islower() else "upper" if word.isupper() and len(word) > 1 else "title"
    return (
        BIAS, crc(w, SEEDS["w:"]) & MASK, crc(w[:3], SEEDS["p:"]) & MASK, crc(w[:5], SEEDS["q:"]) & MASK, crc(w[:7], SEEDS["r:"]) & MASK, crc(w[-3:], SEEDS["s:"]) & MASK,
        SHAPES[shape], crc(w, SEEDS["before:"]) & MASK, crc(w, SEEDS["after:"]) & MASK,
    )


OWN = 7  # features for a token's own state


# ---- the chain -------------------------------------------------------------------------------------------------------------


def marginals(scores: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Probability of state 1 at every token of many chains laid end to end.

    ``scores`` are log potentials of state 1 against state 0, ``trans`` the 2 x 2 log potentials between states, ``first``
    tells where a chain begins. Blocks of BLOCK tokens are worked side by side: each yields the product of its 2 x 2
    matrices, the products are carried from block to block, then every block is filled from its own carry, once forwards
    and once backwards. A chain's first token forgets what was before it.
    """
    n = len(scores)
    if not n:
        return np.zeros(0)
    blocks = -(-n // BLOCK)
    size = blocks * BLOCK
    # One position of all blocks is one row, so every step works on whole rows of plain numbers.
    rows = lambda x: np.ascontiguousarray(x.reshape(blocks, BLOCK).T)
    e = np.ones(size)
    e[:n] = np.exp(np.clip(scores, -30, 30))
    start = np.ones(size, dtype=bool)
    start[:n] = first
    t = np.exp(trans)
    one, state = rows(e), rows(start)
    m = {(i, j): np.where(state, 1.0, t[i, j]) for i in (0, 1) for j in (0, 1)}  # from the state before
    alpha = carried(m[0, 0], m[0, 1] * one, m[1, 0], m[1, 1] * one)
    # Backwards: from the state of the next token; a chain's last token looks at nothing.
    last = np.append(start[1:], True)
    after = np.append(e[1:], 1.0)
    state, one = rows(last)[::-1, ::-1], rows(np.where(last, 1.0, after))[::-1, ::-1]
    m = {(i, j): np.where(state, 1.0, t[j, i]) for i in (0, 1) for j in (0, 1)}  # [next state, own state]
    beta = carried(m[0, 0], m[0, 1], m[1, 0] * one, m[1, 1] * one)
    whole = lambda x: x.T.reshape(size)
    one, none = whole(alpha[1] * beta[1][::-1, ::-1]), whole(alpha[0] * beta[0][::-1, ::-1])
    return (one / (none + one))[:n]


def carried(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row vectors after each of the matrices ((a, b), (c, d)), each scaled to sum 1.

    Row k of the arguments holds the matrices at place k of all blocks; the order is that of the blocks, then of the places.
    """
    length, blocks = a.shape
    p, q, r, s = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for k in range(length):
        p, q, r, s = p * a[k] + q * c[k], p * b[k] + q * d[k], r * a[k] + s * c[k], r * b[k] + s * d[k]
        scale = 1.0 / (p + q + r + s)
        p, q, r, s = p * scale, q * scale, r * scale, s * scale
    x, y, entries = 0.5, 0.5, []
    for p, q, r, s in zip(p.tolist(), q.tolist(), r.tolist(), s.tolist()):
        entries.append((x, y))
        x, y = x * p + y * r, x * q + y * s
        x, y = x / (x + y), y / (x + y)
    v, w = np.array(entries).T
    none, one = np.empty((length, blocks)), np.empty((length, blocks))
    for k in range(length):
        v, w = v * a[k] + w * c[k], v * b[k] + w * d[k]
        total = v + w
        v, w = v / total, w / total
        none[k], one[k] = v, w
    return none, one


@dataclass
class Field:
    """Weights of the field and of the curve over its marginals."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS))
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: np.ndarray = field(default_factory=lambda: np.zeros(4))
    base: float | None = 0.0  # the only score where nothing could be learned

    def packed(self) -> "Field":
        return Field(self.weights.astype(np.float32), self.trans, self.curve, self.base)


class Scorer:
    """Marginals of lists of texts; remembers the sums of words' weights."""

    def __init__(self, model: Field):
        self.model, self.weights = model, model.weights.astype(float)
        self.place: dict[str, int] = {}
        self.table = np.zeros((0, 3))  # own state, next token's, the one's before

    def _learn(self, words: set[str]) -> None:
        if len(self.place) > KEPT_WORDS:
            self.place, self.table = {}, np.zeros((0, 3))
        new = list(words.difference(self.place))
        if not new:
            return
        self.place.update(zip(new, range(len(self.table), len(self.table) + len(new))))
        w = self.weights[np.array([features(x) for x in new])]
        self.table = np.vstack([self.table, np.column_stack([w[:, :OWN].sum(axis=1), w[:, OWN:]])])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(marginal of every token, number of tokens before each text and at the end)."""
        cut = [TOKEN.findall(t) for t in texts]
        n = np.append(0, np.cumsum([len(c) for c in cut]))
        tokens = [*chain.from_iterable(cut)]
        self._learn(set(tokens))
        at = np.fromiter(map(self.place.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        first = np.zeros(len(at) + 1, dtype=bool)
        first[n] = True
        found = self.table[at]
        scores = found[:, 0].copy()
        inner = ~first[1:-1]
        scores[1:] += np.where(inner, found[:-1, 1], 0.0)
        scores[:-1] += np.where(inner, found[1:, 2], 0.0)
        return marginals(scores, self.model.trans, first[:-1]), n


def figures(p: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Per text: highest marginal, log of their sum, their share, and how many offend (log)."""
    out = np.zeros((len(upto) - 1, 4))
    full = np.flatnonzero(np.diff(upto))
    if len(full):
        starts, n = upto[full], np.diff(upto)[full]
        total = np.add.reduceat(p, starts)
        out[full] = np.column_stack([np.maximum.reduceat(p, starts), np.log1p(total), total / n, np.log1p(np.add.reduceat((p >= CUT).astype(float), starts))])
    return out


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


# ---- fitting ---------------------------------------------------------------------------------------------------------------


def fit_field(windows: list[tuple[list[str], list[int]]]) -> Field:
    """Weights by adaptive gradient steps on the conditional likelihood of all windows, with a small pull to zero."""
    tokens = [w for words, _ in windows for w in words]
    y = np.array([s for _, states in windows for s in states], dtype=np.int64)
    upto = np.append(0, np.cumsum([len(words) for words, _ in windows]))
    first = np.zeros(len(tokens) + 1, dtype=bool)
    first[upto] = True
    first, inner = first[:-1], ~first[1:-1]
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(tokens))}
    every = np.array([features(w) for w in vocabulary])
    own, near = every[:, :OWN], every[:, OWN:]
    at = np.array([vocabulary[w] for w in tokens])
    ids = [*own[at].T]
    before, after = near[at, 0], near[at, 1]
    model = Field(base=None)
    grads, t_grads = np.full(1 << BITS, 1e-6), np.full((2, 2), 1e-6)
    pairs = y[:-1][inner] * 2 + y[1:][inner]
    seen = np.bincount(pairs, minlength=4).reshape(2, 2).astype(float)
    for _ in range(STEPS):
        w = model.weights
        scores = sum(w[k] for k in ids)
        scores[1:] += np.where(inner, w[before[:-1]], 0.0)
        scores[:-1] += np.where(inner, w[after[1:]], 0.0)
        p, expected = chain_expectations(scores, model.trans, first)
        gap = y - p
        g = sum(np.bincount(k, gap, minlength=1 << BITS) for k in ids)
        g += np.bincount(before[:-1][inner], gap[1:][inner], minlength=1 << BITS) + np.bincount(after[1:][inner], gap[:-1][inner], minlength=1 << BITS)
        g -= 0.02 * w
        t_g = seen - expected - 0.02 * model.trans
        grads += g * g
        t_grads += t_g * t_g
        model.weights = w + 0.5 * g / np.sqrt(grads)
        model.trans = model.trans + 0.2 * t_g / np.sqrt(t_grads)
    return model


def chain_expectations(scores: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1, and the expected number of each pair of neighbouring states inside the chains.

    Windows have at most SPAN tokens, so all chains are worked side by side, one position at a time.
    """
    starts = np.flatnonzero(first)
    n = np.diff(np.append(starts, len(scores)))
    width = int(n.max())
    inside = np.arange(width)[None] < n[:, None]
    at = np.minimum(starts[:, None] + np.arange(width)[None], len(scores) - 1)
    e = np.ones((len(starts), width, 2))
    e[:, :, 1] = np.where(inside, np.exp(np.clip(scores[at], -30, 30)), 1.0)
    t = np.exp(trans)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for k in range(1, width):
        a = (alpha[:, k - 1] @ t) * e[:, k]
        alpha[:, k] = a / a.sum(axis=1, keepdims=True)
    for k in range(width - 2, -1, -1):
        b = (e[:, k + 1] * beta[:, k + 1]) @ t.T
        beta[:, k] = np.where(inside[:, k + 1, None], b / b.sum(axis=1, keepdims=True), 1.0)
    both = alpha * beta
    p = np.empty(len(scores))
    p[at[inside]] = (both[:, :, 1] / both.sum(axis=2))[inside]
    pair = alpha[:, :-1, :, None] * t * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    return p, pair[inside[:, 1:]].sum(axis=0) if width > 1 else np.zeros((2, 2))


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic curve over the figures of documents by Newton steps; the last weight is the constant."""
    x, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    pull = np.append(np.full(len(w) - 1, 1e-2), 1e-6)
    for _ in range(25):
        p = logistic(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - pull * w)
        w = w + step * min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
    return w


# ---- over all rows ---------------------------------------------------------------------------------------------------------


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", label_key: str = "doc_id") -> DataFrame:
    """(doc, t, y) of the documents that have a label."""
    known = labels.where(F.col(label).isNotNull() & F.col(label_key).isNotNull()).groupBy(F.col(label_key).alias("doc")).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    return docs.select(F.col(key).alias("doc"), F.coalesce(text, F.lit("")).alias("t")).join(known.hint("merge"), "doc")  # labels grow with the documents


def _telling(counts: DataFrame, strictness: float = 1.0) -> list[str]:
    """Units of (w, bad, good) counts that are significantly more frequent in toxic documents.

    The list is bounded by the words that can pass the test; it grows with the labelled vocabulary of toxic documents, not
    with the corpus.
    """
    total = counts.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("words")).first()
    if not total["bad"] or not total["good"]:
        return []
    begins = [F.when(F.length("w") > k, F.concat(F.lit("^"), F.substring("w", 1, k))) for k in PREFIXES]
    units = counts.select(F.explode(F.array_compact(F.array(F.concat(F.lit("="), "w"), *begins))).alias("u"), "bad", "good")
    units = units.groupBy("u").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    share = total["bad"] / (total["bad"] + total["good"])
    n, bad, good = F.col("bad") + F.col("good"), F.col("bad"), F.col("good")
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    weight = 2 * (part(bad, n * share) + part(good, n * (1 - share)))
    rate = (bad / total["bad"]) / ((good + 0.5) / total["good"])
    least = 2 * float(np.log(max(2, total["words"]))) + 2
    hits = units.where((bad >= SEEN) & (rate >= RATIO * strictness) & (weight >= least * strictness)).select("u")
    return sorted(r["u"] for r in hits.collect())


def _words(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def _begins_with_letter(word: str) -> bool:
    return word[0].isalpha()


def toxic_units(rows: DataFrame) -> list[str]:
    """Words ("=word") and beginnings ("^begin") that tell toxic documents from others, by documents and by distinct contexts."""

    def in_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def table() -> pa.RecordBatch:
            words = list(seen[0] | seen[1])
            columns = {"w": pa.array(words, pa.string()), "bad": pa.array([seen[1][w] for w in words], pa.int64()), "good": pa.array([seen[0][w] for w in words], pa.int64())}
            seen[0].clear()
            seen[1].clear()
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for t, y in zip(batch.column("t"), batch.column("y")):
                seen[y.as_py()].update(filter(_begins_with_letter, {*_words(t.as_py())}))
                if len(seen[0]) + len(seen[1]) > KEPT_WORDS:
                    yield table()
        yield table()

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(likely)
        for batch in batches:
            out: list[tuple[str, int, int]] = []
            for t, y in zip(batch.column("t").to_pylist(), batch.column("y").to_pylist()):
                padded = ["", *_words(t), ""]
                some = [k for k, w in enumerate(padded) if w and marks[w]]
                out += {(padded[k], zlib.crc32(f"{padded[k - 1]} {padded[k + 1]}".encode()), y) for k in some if padded[k][0].isalpha()}
            yield pa.RecordBatch.from_pydict({"w": pa.array([x[0] for x in out], pa.string()), "c": pa.array([x[1] for x in out], pa.int64()), "y": pa.array([x[2] for x in out], pa.int32())})

    counts = rows.select("t", "y").mapInArrow(in_documents, "w string, bad long, good long").groupBy("w").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counts = materialize(counts, "toxic-words")
    likely = frozenset(_telling(counts, 0.5))
    if not likely:
        return []
    seen = rows.select("t", "y").mapInArrow(contexts, "w string, c long, y int").distinct()
    counted = seen.groupBy("w").agg(F.sum(F.col("y").cast("long")).alias("bad"), F.sum((1 - F.col("y")).cast("long")).alias("good"))
    # The other words keep their documents' counts, so the totals the test compares with stay those of the whole vocabulary.
    mixed = counts.join(counted.select("w", F.struct("bad", "good").alias("x")), "w", "left")
    mixed = materialize(mixed.select("w", F.coalesce("x.bad", "bad").alias("bad"), F.coalesce("x.good", "good").alias("good")), "toxic-contexts")
    return [u for u in _telling(mixed) if u in likely]


class Marks(dict):
    """Whether a word is in one of the units or begins with one; what was asked before is remembered."""

    def __init__(self, units: Iterable[str]):
        super().__init__()
        self.units = frozenset(units)

    def __missing__(self, word: str) -> bool:
        w = word.lower()
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = found = "=" + w in self.units or any("^" + w[:k] in self.units for k in PREFIXES if len(w) > k)
        return found


def training_windows(rows: DataFrame, units: list[str]) -> list[tuple[list[str], list[int]]]:
    """About WINDOWS different windows of each kind, or fewer, by least hash of their content."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(units)
        kept: tuple[dict, dict, dict] = ({}, {}, {})  # (hash, words) to states, by kind
        highest, seen = [1 << 32] * 3, [0] * 3  # hashes that can still be among the least; windows met

        def least(found: dict) -> dict:
            return dict(sorted(found.items())[:WINDOWS])

        for batch in batches:
            for t, y in zip(batch.column("t"), batch.column("y")):
                tokens, y = TOKEN.findall(t.as_py()), y.as_py()
                hit = [int(marks[w]) for w in tokens]
                for k in range(0, len(tokens), SPAN):
                    some, hits = tokens[k : k + SPAN], hit[k : k + SPAN]
                    sort, h = max(hits) * (1 + y), zlib.crc32(" ".join(some).encode())
                    seen[sort] += 1
                    if h > highest[sort]:
                        continue
                    kept[sort][h, tuple(some)] = hits if y else [0] * len(some)
                    if len(kept[sort]) > 2 * WINDOWS:
                        found = least(kept[sort])
                        highest[sort] = max(h for h, _ in found)
                        kept[sort].clear()
                        kept[sort].update(found)
        for sort, found in enumerate(kept):
            out = [(None, None, None), *((h, list(w), s) for (h, w), s in least(found).items())]
            yield pa.RecordBatch.from_pydict({
                "sort": pa.array([sort] * len(out), pa.int32()), "met": pa.array([seen[sort], *[0] * (len(out) - 1)], pa.int64()), "h": pa.array([x[0] for x in out], pa.int64()),
                "words": pa.array([x[1] for x in out], pa.list_(pa.string())), "states": pa.array([x[2] for x in out], pa.list_(pa.int32())),
            })

    # Every task keeps its own least ones and says how many it met. Hashes are even, so the share to keep of all gives the
    # greatest hash, and no task has to see the windows of the others.
    windows = materialize(rows.select("t", "y").mapInArrow(cut, "sort int, met long, h long, words array<string>, states array<int>"), "toxic-windows")
    met = {r["sort"]: r["n"] for r in windows.groupBy("sort").agg(F.sum("met").alias("n")).collect()}
    wanted = F.lit(False)
    for sort, n in met.items():
        wanted |= (F.col("sort") == sort) & (F.col("h") < int((1 << 32) * min(1.0, WINDOWS / max(1, n))))
    got = windows.where(wanted).select("h", "words", "states").distinct().collect()
    return [(list(r["words"]), list(r["states"])) for r in sorted(got, key=lambda r: (r["h"], r["words"], r["states"]))]


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about AT_ONCE characters, and their texts."""
    for batch in batches:
        start = total = 0
        sizes = pa.compute.utf8_length(batch.column("t")).to_pylist()
        for k, size in enumerate(sizes, 1):
            total += size
            if total >= AT_ONCE or k == len(sizes):
                part = batch.slice(start, k - start)
                yield part, part.column("t").to_pylist()
                start, total = k, 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", label_key: str = "doc_id") -> Field:
    """The field and its curve from labelled documents; ``docs`` holds only those it may learn from."""
    rows = materialize(labelled(docs, labels, key, text, label, label_key).select("t", "y"), "labelled")
    share = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    flat = Field(base=share.get(1, 0) / max(1, sum(share.values())))
    units = toxic_units(rows) if len(share) == 2 else []
    windows = training_windows(rows, units) if units else []
    if not windows or not any(max(states) for _, states in windows):
        return flat
    model = fit_field(windows)
    sender = rows.sparkSession.sparkContext.broadcast(model.packed())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = Scorer(sender.value)
        for part, texts in _documents(batches):
            x = figures(*run(texts))
            yield pa.RecordBatch.from_pydict({"y": part.column("y"), "x": pa.array(list(x), pa.list_(pa.float64()))})

    # Equal texts count once, so no group of copies can fill the sample.
    part = int((1 << 32) * min(1.0, CURVE / sum(share.values())))
    sample = rows.where(F.crc32("t") < part).groupBy(F.crc32("t").alias("h"), "y").agg(F.min("t").alias("t"))
    got = sorted(sample.select("t", "y").mapInArrow(measure, "y int, x array<double>").collect(), key=lambda r: (r["y"], r["x"]))
    model.curve = fit_curve(np.array([r["x"] for r in got]), np.array([r["y"] for r in got], dtype=float))
    return model


def score(docs: DataFrame, model: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, spans): score from 0 to 1, and the offending spans as (start, end, marginal) in code points, neighbours joined."""
    kind = docs.schema[key].dataType.simpleString()
    sender = docs.sparkSession.sparkContext.broadcast(model.packed())
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def spans(t: str, p: np.ndarray) -> list[dict]:
        out: list[dict] = []
        last = -2
        for k, m in enumerate(TOKEN.finditer(t)):
            if p[k] >= CUT:
                if last == k - 1:
                    out[-1] |= {"end": m.end(), "marginal": max(out[-1]["marginal"], float(p[k]))}
                else:
                    out.append({"start": m.start(), "end": m.end(), "marginal": float(p[k])})
                last = k
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sender.value)
        for part, texts in _documents(batches):
            if model_base is not None:
                scores, found = np.full(len(texts), model_base), [[]] * len(texts)
            else:
                p, upto = scorer(texts)
                x = figures(p, upto)
                scores = logistic(np.column_stack([x, np.ones(len(x))]) @ sender.value.curve)
                found = [spans(t, p[a:b]) if x[k, 3] else [] for k, (t, a, b) in enumerate(zip(texts, upto, upto[1:]))]
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(scores, pa.float64()), pa.array(found, span)], names=["doc", "score", "spans"])

    model_base = model.base
    rows = docs.select(F.col(key).alias("doc"), F.coalesce(text, F.lit("")).alias("t"))
    return rows.mapInArrow(run, f"doc {kind}, score double, spans array<struct<start: long, end: long, marginal: double>>").withColumnRenamed("doc", key)


def held_out(key: str = "doc_id"):
    """A fifth of the ids, by their checksum; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))
