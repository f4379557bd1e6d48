"""Secret spans: fixed patterns, and formats learned from what they find by grammar inference.

The values that the fixed patterns find label themselves. For each kind a bounded sample of them (``SAMPLE`` distinct values, by hash)
becomes a prefix tree whose states are merged while their outgoing frequencies are statistically compatible; the result is a probabilistic
automaton. A background automaton is learned the same way from candidates outside all base spans. Every candidate of every text is then
scored by its log-likelihood for each letter under the best credential automaton against the background; the threshold comes from
held-out values. Both are smoothed, so an unseen letter costs likelihood but rules nothing out; the background falls back on the
letters of all its values, so that a harmless word does not stand out only because its letters did not occur in that order.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import materialize

# Fixed patterns of the base kinds, with the least length of the tested part.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ["assign", "access", "hex", "format"]
LETTERS = "A-Za-z0-9+/_.=-"
CANDIDATE = re.compile(f"(?<![{LETTERS}])[{LETTERS}]{{12,}}+")

SAMPLE = 1000  # distinct labelled values of a kind that are learned from; half as many again decide the threshold
LEAST = 10  # distinct labelled values without which a kind makes no format, because its threshold would be a guess
ALPHA = 0.05  # significance of the test that keeps two states apart
RARE = 1e-3  # probability that a state leaves for a letter it never saw
BACK = 0.1  # share of the background's likelihood that comes from its letters regardless of order

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the base kinds, leftmost and non-overlapping within a kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """Runs of credential letters, 12 or more, that touch no base span."""
    cover = sorted((s, e) for _, s, e in taken)
    k = 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while k < len(cover) and cover[k][1] <= start:
            k += 1
        j = k
        while j < len(cover) and cover[j][0] < end and cover[j][1] <= start:
            j += 1
        if j == len(cover) or cover[j][0] >= end:
            yield start, end


class Automaton:
    """A probabilistic automaton: for each state its arrivals, its ends, and count and target of every letter."""

    def __init__(self):
        self.arrive, self.end = [0], [0]
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]

    def add(self, word: str) -> None:
        q = 0
        self.arrive[0] += 1
        for c in word:
            if c not in self.next[q]:
                self.next[q][c] = len(self.arrive)
                self.arrive.append(0)
                self.end.append(0)
                self.next.append({})
                self.count.append({})
            self.count[q][c] = self.count[q].get(c, 0) + 1
            q = self.next[q][c]
            self.arrive[q] += 1
        self.end[q] += 1

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return abs(a / n - b / m) > bound

    def _compatible(self, p: int, q: int) -> bool:
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            n, m = self.arrive[p], self.arrive[q]
            if not n or not m:
                continue
            if self._differ(self.end[p], n, self.end[q], m):
                return False
            for c in self.count[p].keys() | self.count[q].keys():
                if self._differ(self.count[p].get(c, 0), n, self.count[q].get(c, 0), m):
                    return False
                if c in self.next[p] and c in self.next[q]:
                    stack.append((self.next[p][c], self.next[q][c]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the tree below ``q`` into ``p``."""
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            self.arrive[p] += self.arrive[q]
            self.end[p] += self.end[q]
            for c, target in self.next[q].items():
                self.count[p][c] = self.count[p].get(c, 0) + self.count[q][c]
                if c in self.next[p]:
                    stack.append((self.next[p][c], target))
                else:
                    self.next[p][c] = target

    def merge_states(self) -> None:
        """Visit the tree breadth first; a state joins the first kept state it is compatible with, or is kept itself."""
        kept = [0]
        border = [(0, c) for c in sorted(self.next[0])]
        while border:
            p, c = border.pop(0)
            q = self.next[p][c]
            if q in kept:
                continue
            for r in kept:
                if self._compatible(r, q):
                    self.next[p][c] = r
                    self._fold(r, q)
                    break
            else:
                kept.append(q)
            border = [(p, c) for p in kept for c in sorted(self.next[p]) if self.next[p][c] not in kept]
        place = {q: k for k, q in enumerate(kept)}
        self.arrive = [self.arrive[q] for q in kept]
        self.end = [self.end[q] for q in kept]
        self.count = [self.count[q] for q in kept]
        self.next = [{c: place[t] for c, t in self.next[q].items()} for q in kept]

    def score(self, word: str) -> float:
        """Log-likelihood of the word; letters a state never saw cost ``RARE`` and leave it where it is."""
        q, total = 0, 0.0
        for c in word:
            n = self.count[q].get(c)
            if n:
                total += math.log(n / self.arrive[q] * (1 - RARE))
                q = self.next[q][c]
            else:
                total += math.log(RARE / 64)
        return total + math.log(max(self.end[q] / self.arrive[q], RARE))

    def letters(self) -> dict[str, float]:
        """Share of each credential letter among all letters of the words, every letter counted once more than it occurs."""
        n = dict.fromkeys(string.ascii_letters + string.digits + "+/_.=-", 1)
        for count in self.count:
            for c, k in count.items():
                n[c] = n.get(c, 1) + k
        total = sum(n.values())
        return {c: k / total for c, k in n.items()}

    def backed_score(self, word: str, letters: dict[str, float]) -> float:
        """Log-likelihood of the word where each letter may also come from ``letters`` regardless of the state."""
        q, total = 0, 0.0
        for c in word:
            n = self.count[q].get(c, 0)
            total += math.log((1 - BACK) * n / max(self.arrive[q], 1) + BACK * letters[c])
            if n:
                q = self.next[q][c]
        return total + math.log(max(self.end[q] / max(self.arrive[q], 1), RARE))

    def as_rows(self) -> list[tuple[int, str, int, int]]:
        """(state, letter, target, count); the empty letter has the ends, target -1, and the arrivals go under target -2."""
        out = []
        for q in range(len(self.arrive)):
            out += [(q, "", -1, self.end[q]), (q, "", -2, self.arrive[q])]
            out += [(q, c, self.next[q][c], n) for c, n in self.count[q].items()]
        return out

    @staticmethod
    def of_rows(rows: Iterable[tuple[int, str, int, int]]) -> Automaton:
        a, rows = Automaton(), list(rows)
        size = max(r[0] for r in rows) + 1
        a.arrive, a.end, a.next, a.count = [0] * size, [0] * size, [{} for _ in range(size)], [{} for _ in range(size)]
        for q, c, target, n in rows:
            if target == -1:
                a.end[q] = n
            elif target == -2:
                a.arrive[q] = n
            else:
                a.next[q][c], a.count[q][c] = target, n
        return a


def infer(words: list[str]) -> Automaton:
    a = Automaton()
    for w in words:
        a.add(w)
    a.merge_states()
    return a


def values_of(texts: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(kind, value) of everything that can be learned from: base values by kind, other candidates as 'none'."""
    for t in texts:
        spans = base_spans(t)
        for kind, s, e in spans:
            yield kind, ASSIGN.match(t, s)[2] if kind == "assign" else t[s:e]
        for s, e in candidates(t, spans):
            yield "none", t[s:e]


ROWS = "kind string, state int, letter string, target int, count long"


def _learn(frame: pd.DataFrame) -> pd.DataFrame:
    words = frame.sort_values("h")["value"].tolist()
    kind = frame["kind"].iloc[0]
    if kind != "none" and len(words) < LEAST:
        words = []
    return pd.DataFrame([(kind, *r) for r in (infer(words).as_rows() if words else [])], columns=["kind", "state", "letter", "target", "count"])


class Scanner:
    """The learned automata with their thresholds; small, because the samples are bounded."""

    def __init__(self, automata: dict[str, Automaton], held_out: dict[str, list[str]]):
        self.background = automata.get("none")
        self.kinds: list[tuple[Automaton, float]] = []
        if self.background is None:
            return
        self.letters = self.background.letters()
        bad_words = held_out.get("none", [])
        for kind, a in automata.items():
            good = sorted(self.ratio(a, w, self.base(w)) for w in held_out.get(kind, []))
            bad = sorted(self.ratio(a, w, self.base(w)) for w in bad_words)
            if kind == "none" or not good or not bad:
                continue
            low, high = good[len(good) // 20], bad[len(bad) - 1 - len(bad) // 1000]
            # Between the two classes; where they overlap, only what is above all that is known to be harmless.
            self.kinds.append((a, max((low + high) / 2 if low > high else high + abs(high) / 10, 0.0)))

    def base(self, word: str) -> float:
        return self.background.backed_score(word, self.letters)

    @staticmethod
    def ratio(a: Automaton, word: str, base: float) -> float:
        """Log-likelihood ratio for each letter and the end."""
        return (a.score(word) - base) / (len(word) + 1)

    def accepts(self, word: str) -> bool:
        if not self.kinds:
            return False
        base = self.base(word)
        return any(self.ratio(a, word, base) > limit for a, limit in self.kinds)

    def spans(self, text: str) -> list[Span]:
        """Base spans and learned ones, by start, then kind."""
        found = base_spans(text)
        if self.kinds:
            found = found + [("format", s, e) for s, e in candidates(text, found) if self.accepts(text[s:e])]
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Scanner:
    """Learn from all texts: every value is found, a bounded sample by hash is learned from."""

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A task passes on its own least hashes only; the least of all are among them.
        best: dict[str, dict[str, int]] = {k: {} for k in (*KINDS[:3], "none")}
        import xxhash

        limit = sample + sample // 2
        for batch in batches:
            for kind, value in values_of(batch["t"]):
                best[kind][value] = xxhash.xxh64_intdigest(value) >> 1
            for kind, known in best.items():
                if len(known) > limit:
                    best[kind] = dict(sorted(known.items(), key=lambda x: (x[1], x[0]))[:limit])
        yield pd.DataFrame([(k, v, h) for k, known in best.items() for v, h in known.items()], columns=["kind", "value", "h"])

    found = materialize(docs.select(F.coalesce(text, F.lit("")).alias("t")).mapInPandas(values, "kind string, value string, h long").distinct(), "labelled-values")
    parts = [found.filter(F.col("kind") == k).orderBy("h", "value").limit(sample + sample // 2) for k in (*KINDS[:3], "none")]
    picked = parts[0]
    for p in parts[1:]:
        picked = picked.unionByName(p)
    picked = materialize(picked.withColumn("held", F.pmod(F.xxhash64("value"), F.lit(3)) == 0), "labelled-sample")
    rows = picked.filter("not held").groupBy("kind").applyInPandas(_learn, ROWS).collect()
    automata = {k: Automaton.of_rows((r["state"], r["letter"], r["target"], r["count"]) for r in rows if r["kind"] == k) for k in {r["kind"] for r in rows}}
    held: dict[str, list[str]] = {}
    for r in picked.filter("held").collect():
        held.setdefault(r["kind"], []).append(r["value"])
    return Scanner(dict(sorted(automata.items())), held)


SPANS = "array<struct<kind: string, start: int, end: int>>"


def with_secrets(docs: DataFrame, scanner: Scanner, text: str = "text", name: str = "secrets") -> DataFrame:
    """``docs`` with a column ``name``: array of (kind, start, end) in code points, end exclusive. A null text has none."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner)

    @F.pandas_udf(SPANS)
    def scan(texts: pd.Series) -> pd.Series:
        s = shared.value
        return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in s.spans(t)] for t in texts])

    return docs.withColumn(name, scan(F.coalesce(text, F.lit(""))))


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret span replaced by ``mark``; overlapping spans become one mark. Other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, text))

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        s, out = shared.value, []
        for t in texts:
            spans = [] if t is None else s.spans(t)
            if not spans:
                out.append(t)
                continue
            parts, at, reach = [], 0, -1
            for _, a, b in spans:
                if a >= reach:
                    parts += [t[at:a], mark]
                at = reach = max(reach, b)
            out.append("".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, clean(text))
