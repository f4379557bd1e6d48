"""SentencePiece encoding and decoding by a max-plus parallel scan.

The pieces and scores of a model file are read as a unigram model: the ids of a text are those of the segmentation with the highest sum of
scores (of equal ones, the one whose pieces begin earliest from the end on). With best sums F at the last ``L`` positions before a chunk, the sums at
its last ``L`` positions are a max-plus product with the chunk's L x L transfer matrix (L is the longest piece). So a giant text is cut into
chunks: each yields its matrix, matrices are combined associatively in blocks and the sums carried over them, each chunk then fills its own
back pointers and tells which entry every exit leads to, these maps are composed from the end, and every chunk is traced back on its own.

A text of one chunk is the same computation with nothing to combine. Inside a chunk no piece crosses from a visible character into a blank,
so words are segmented one by one and remembered.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import materialize

CHUNK = 1 << 14  # characters
FOLD = 64  # chunks whose matrices are multiplied in one step
NEAR = 256  # characters from a chunk's end within which a sure cut is of use
KEPT_WORDS = 200_000
NONE = -(1 << 60)
BLANK = "▁"
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
COARSE = re.compile(" +[^ ]*|[^ ]+")
SURE = re.compile("[^ ](?= )")  # no piece crosses from a visible character into a blank
FINE = re.compile(f" *[{LETTERS}]++| *[^ {LETTERS}]++| +")


class PieceModel:
    """Pieces, scores and the word-by-word segmentation of one model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.narrow = "<u2" if n <= 1 << 16 else "<u4"  # how ids travel between tasks
        self.pieces = [sp.id_to_piece(k) for k in range(n)]
        self.unk = sp.unk_id()
        self.bytes = {self.pieces[k]: k for k in range(n) if sp.is_byte(k)}
        self.raw = [p.encode() for p in self.pieces]
        for p, k in self.bytes.items():
            self.raw[k] = bytes([int(p[3:5], 16)])
        normal = [k for k in range(n) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k))]
        if any(sp.get_score(k) % 1 for k in normal):
            raise ValueError("a score of this model is not a whole number")  # rounded scores would give other ids
        self.trie: dict = {}
        for k in normal:
            node = self.trie
            for c in self.pieces[k].replace(BLANK, " "):
                node = node.setdefault(c, {})
            node[""] = (k, round(sp.get_score(k)))
        self.longest = max(len(self.pieces[k]) for k in normal)
        self.unknown = min(round(sp.get_score(k)) for k in normal) - 10
        text = [self.pieces[k].replace(BLANK, " ").lstrip(" ") for k in normal]
        if any(" " in t for t in text):
            raise ValueError("a piece of this model goes on after a blank")
        # Where no piece joins a letter to anything else, words end before marks too.
        mixed = re.compile(f"[{LETTERS}][^{LETTERS}]|[^{LETTERS}][{LETTERS}]")
        self.unit = COARSE if any(mixed.search(t) for t in text) else FINE
        self.words: dict[str, tuple[int, bytes]] = {}

    def matches(self, s: str, i: int) -> Iterator[tuple[int, int, int]]:
        """(end, id, score) of the pieces that begin at ``i``, and the unknown character where no single one does."""
        node, j, single = self.trie, i, False
        while j < len(s):
            node = node.get(s[j])
            if node is None:
                break
            j += 1
            hit = node.get("")
            if hit:
                single |= j == i + 1
                yield j, hit[0], hit[1]
        if not single:
            yield i + 1, self.unk, self.unknown

    def forward(self, s: str, start: dict[int, int], first: int) -> tuple[list[int], list[int], list[int]]:
        """Best sums, back pointers and ids at every position, from the sums ``start``; only positions after ``first`` are filled."""
        best, back, ids = [NONE] * (len(s) + 1), [-1] * (len(s) + 1), [0] * (len(s) + 1)
        for p, v in start.items():
            best[p] = v
        for i in range(min(start), len(s)):
            b = best[i]
            if b > NONE:
                for j, k, score in self.matches(s, i):
                    if j > first and b + score > best[j]:
                        best[j], back[j], ids[j] = b + score, i, k
        return best, back, ids

    def word(self, s: str) -> tuple[int, bytes]:
        """(sum, ids as little-endian uint32) of a part that all segmentations begin and end with."""
        # ``forward`` from one position, written out because it runs for every new word.
        n, trie = len(s), self.trie
        best, back, ids = [0] + [NONE] * n, [0] * (n + 1), [0] * (n + 1)
        for i in range(n):
            b = best[i]
            if b == NONE:
                continue
            node, j, single = trie, i, False
            while j < n:
                node = node.get(s[j])
                if node is None:
                    break
                j += 1
                if "" in node:
                    k, score = node[""]
                    if j == i + 1:
                        single = True
                    if b + score > best[j]:
                        best[j], back[j], ids[j] = b + score, i, k
            if not single and b + self.unknown > best[i + 1]:
                best[i + 1], back[i + 1], ids[i + 1] = b + self.unknown, i, self.unk
        out, p = [], n
        while p:
            k = ids[p]
            if k == self.unk:
                out += [self.bytes[f"<0x{x:02X}>"] for x in reversed(s[p - 1].encode())]
            else:
                out.append(k)
            p = back[p]
        return best[-1], np.array(out[::-1], dtype="<u4").tobytes()

    def parts(self, s: str) -> list[tuple[int, bytes]]:
        units = self.unit.findall(s)
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        known = self.words
        for u in set(units).difference(known):
            known[u] = self.word(u)
        return list(map(known.__getitem__, units))

    def encode(self, text: str) -> bytes:
        return b"".join([p[1] for p in self.parts(" " + text)]) if text else b""

    def decode(self, ids: np.ndarray) -> str:
        # Pieces are whole characters, so bytes that are none are replaced as if each run of them was read alone.
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode(errors="replace").replace(BLANK, " ")[1:]

    def sure_cuts(self, s: str, a: int) -> tuple[int, int] | None:
        """The first position after ``a`` at which all segmentations are cut, and the last one that no exit comes before; none if either is far from its end."""
        first, exits = SURE.search(s, a), len(s) - self.longest + 1
        if first is None or first.end() > min(exits, a + NEAR):
            return None
        f2 = s.rfind(" ", 0, exits + 1)
        while s[f2 - 1] == " ":
            f2 -= 1
        return (first.end(), f2) if len(s) - f2 <= NEAR else None

    def trace(self, s: str, p: int, a: int, back: list[int], ids: list[int]) -> tuple[list[int], bytes]:
        """Where the pieces from ``p`` back to ``a`` or before begin, and their ids in order."""
        begins, out = [], []
        while p > a:
            out += [self.bytes[f"<0x{x:02X}>"] for x in reversed(s[p - 1].encode())] if ids[p] == self.unk else [ids[p]]
            p = int(back[p])
            begins.append(p)
        return begins, np.array(out[::-1], dtype="<u4").tobytes()

    def ends(self, s: str, a: int) -> dict | None:
        """What a chunk's ids depend on at its ends, where sure cuts set the rest apart.

        For every entry the sum up to the first cut, the begins of its pieces from there back, and their ids; ids and sum between the cuts; for
        every exit the ids and the sum from the last cut.
        """
        cuts = self.sure_cuts(s, a)
        if cuts is None:
            return None
        f1, f2 = cuts
        out: dict = {"sums": [], "begins": [], "heads": []}
        for e in range(self.longest):
            best, back, ids = self.forward(s[:f1], {a - e: 0}, a) if a >= e else ([NONE], [-1], [])
            begins, head = self.trace(s, f1, a, back, ids) if best[-1] > NONE else ([], b"")
            for k, v in zip(out, (best[-1], begins, head)):
                out[k].append(v)
        parts = self.parts(s[f1:f2])
        tail = s[f2:]
        best, back, ids = self.forward(tail, {0: 0}, 0)
        exits = range(len(tail), len(tail) - self.longest, -1)
        return out | {
            "middle": b"".join([p[1] for p in parts]), "middle_sum": sum([p[0] for p in parts]),
            "tails": [self.trace(tail, p, 0, back, ids)[1] for p in exits], "tail_sums": [best[p] for p in exits],
        }

    def matrix(self, s: str, a: int, ends: dict | None = None) -> np.ndarray:
        """M[e, x]: best sum from position ``a`` - e to position len(s) - x over segmentations without a cut in between at or before ``a``."""
        size, b = self.longest, len(s)
        m = np.full((size, size), NONE, dtype=np.int64)
        entries = [e for e in range(size) if a - e >= 0]
        for e in entries:
            if 0 <= b - (a - e) < size:
                m[e, b - (a - e)] = 0
        ends = ends or self.ends(s, a)
        if ends:
            head, tail = np.array(ends["sums"])[:, None], np.array(ends["tail_sums"])[None, :]
            return np.where((head > NONE) & (tail > NONE), head + ends["middle_sum"] + tail, m)
        for e in entries:
            best = self.forward(s, {a - e: 0}, a)[0]
            for x in range(size):
                if b - x > a and best[b - x] > NONE:
                    m[e, x] = best[b - x]
        return m

    def entry(self, sums: np.ndarray, begins: list, v: np.ndarray) -> int:
        """The entry of a chunk with sure cuts, of equal ones the one whose pieces begin earliest from the first cut back."""
        whole = np.where((sums > NONE) & (v > NONE), sums + v, NONE)
        return min(np.flatnonzero(whole == whole.max()).tolist(), key=lambda e: list(begins[e]))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: the matrix of two chunks one after the other."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NONE)


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(_rid, key, chunk, ids binary): ids of every whole text as little-endian uint32, in chunks of ``chunk`` characters.

    An empty or null text has one chunk without ids. Texts of one chunk are encoded where they are read; only the chunks of longer ones are
    shuffled, as matrices, maps and back pointers. Rows with the same key are rows of their own. ``docs`` must be a written table.
    """
    short, long = _encoded(docs, path, key, text, chunk)
    return short.unionByName(long).withColumnRenamed("doc", key)


def _encoded(docs: DataFrame, path: str, key: str, text: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    """The rows of texts of one chunk, and those of longer ones."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), F.col(key).alias("doc"), F.coalesce(text, F.lit("")).alias("t"))
    out = f"_rid long, doc {kind}, chunk int, ids binary"

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = piece_model(path)
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.iloc[k : k + 256]
                yield pd.DataFrame({"_rid": part["_rid"], "doc": part["doc"], "chunk": 0, "ids": [model.encode(t) for t in part["t"]]})

    short = rows.filter(F.char_length("t") < chunk).mapInPandas(whole, out)
    return short, _giants(rows.filter(F.char_length("t") >= chunk), path, chunk, out)


def _texts(docs: DataFrame, path: str, key: str, text: str, chunk: int) -> DataFrame:
    """(doc, x array<binary>): the ids of every text by chunk; only texts of several chunks are brought together."""
    short, long = _encoded(docs, path, key, text, chunk)
    grouped = long.groupBy("_rid", "doc").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("x"))
    return short.select("doc", F.array("ids").alias("x")).unionByName(grouped.select("doc", F.col("x.ids").alias("x")))


def _giants(rows: DataFrame, path: str, chunk: int, out: str) -> DataFrame:
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    halo = 64  # more than the longest piece; the model says how much is used
    s = F.concat(F.lit(" "), F.col("t"))
    n = F.char_length("t") + 1
    chunks = rows.select("_rid", "doc", s.alias("s"), n.alias("n")).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / chunk).cast("int"))))
    begin = F.greatest(F.col("k") * chunk - halo, F.lit(0))
    end = F.least((F.col("k") + 1) * chunk, F.col("n"))
    chunks = chunks.select("_rid", "doc", "k", (F.col("k") * chunk - begin).alias("a"), F.substring(F.col("s"), begin + 1, end - begin).alias("s"))
    kind = rows.schema["doc"].dataType.simpleString()

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = piece_model(path)
        slim = lambda ids: np.frombuffer(ids, dtype="<u4").astype(model.narrow).tobytes()
        for batch in batches:
            got = []
            for t, a in zip(batch["s"], batch["a"]):
                ends = model.ends(t, a)
                m = model.matrix(t, a, ends).tobytes()
                if ends:
                    got.append((m, None, ends["sums"], ends["begins"], [slim(x) for x in ends["heads"]], slim(ends["middle"]), [slim(x) for x in ends["tails"]]))
                else:
                    got.append((m, t, None, None, None, None, None))
            names = ["m", "s", "sums", "begins", "heads", "middle", "tails"]
            yield pd.DataFrame({"_rid": batch["_rid"], "doc": batch["doc"], "k": batch["k"], "a": batch["a"]} | {n: [g[j] for g in got] for j, n in enumerate(names)})

    # The texts travel once; behind it, a chunk with sure cuts is its ids, and only others keep their characters.
    schema = f"_rid long, doc {kind}, k int, a int, m binary, s string, sums array<long>, begins array<array<int>>, heads array<binary>, middle binary, tails array<binary>"
    found = materialize(chunks.repartition(parts, "_rid", "k").mapInPandas(prepare, schema), "piece-chunks")

    def square(data: bytes) -> np.ndarray:
        flat = np.frombuffer(data, dtype=np.int64)
        return flat.reshape(int(len(flat) ** 0.5), -1)

    def product(frame: pd.DataFrame) -> pd.DataFrame:
        frame, m = frame.sort_values("k"), None
        for data in frame["m"]:
            m = square(data) if m is None else combine(m, square(data))
        return pd.DataFrame({"_rid": [frame["_rid"].iloc[0]], "block": [frame["block"].iloc[0]], "m": [m.tobytes()]})

    def carry(frame: pd.DataFrame, name: str) -> pd.DataFrame:
        """Sums that enter each matrix of the frame, in order; the frame's first row may bring its own."""
        frame, v, seen = frame.sort_values(name), None, []
        for row in frame.itertuples(index=False):
            m = square(row.m)
            if v is None:
                v = np.full(len(m), NONE, dtype=np.int64)
                v[0] = 0
                if getattr(row, "v", None) is not None:
                    v = np.frombuffer(row.v, dtype=np.int64)
            seen.append(v.tobytes())
            v = np.maximum((v[:, None] + m).max(axis=0), NONE)
        return pd.DataFrame({"_rid": frame["_rid"].to_numpy(), name: frame[name].to_numpy(), "v": seen})

    # Blocks of chunks, then the blocks of a text (one matrix of a few KB for a million characters), then the chunks of a block.
    blocked = found.select("_rid", "k", "m").withColumn("block", F.floor(F.col("k") / FOLD).cast("int"))
    blocks = blocked.groupBy("_rid", "block").applyInPandas(product, "_rid long, block int, m binary")
    entering = blocks.groupBy("_rid").applyInPandas(lambda f: carry(f, "block"), "_rid long, block int, v binary")
    sums = blocked.join(entering, ["_rid", "block"]).groupBy("_rid", "block").applyInPandas(lambda f: carry(f, "k"), "_rid long, k int, v binary")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = piece_model(path)
        for batch in batches:
            got = []
            for t, a, sums, begins, v in zip(batch["s"], batch["a"], batch["sums"], batch["begins"], batch["v"]):
                v = np.frombuffer(v, dtype=np.int64)
                if t is None:
                    e = model.entry(np.asarray(sums), begins, v)
                    got.append(([e] * len(v), e, None, None))
                    continue
                start = {a - e: int(v[e]) for e in range(len(v)) if a - e >= 0 and v[e] > NONE}
                _, back, ids = model.forward(t, start, a)
                # Where each exit enters: follow the pointers up to the first position that is not after the chunk's start.
                entry = {p: a - p for p in range(max(0, a - len(v) + 1), a + 1)}
                for p in range(a + 1, len(t) + 1):
                    entry[p] = entry.get(back[p], -1) if back[p] >= 0 else -1
                exits = [entry.get(len(t) - x, -1) for x in range(len(v))]
                steps = np.array([p - q if q >= 0 else 0 for p, q in enumerate(back)], dtype="<u2")
                got.append((exits, None, steps.tobytes(), np.array(ids, dtype=model.narrow).tobytes()))
            yield pd.DataFrame({"_rid": batch["_rid"], "k": batch["k"], "exits": [g[0] for g in got], "e": pd.array([g[1] for g in got], dtype="Int32"), "steps": [g[2] for g in got], "tokens": [g[3] for g in got]})

    entered = found.select("_rid", "k", "a", "s", "sums", "begins").join(sums, ["_rid", "k"])
    filled = materialize(entered.mapInPandas(fill, "_rid long, k int, exits array<int>, e int, steps binary, tokens binary"), "piece-pointers")

    def leave(frame: pd.DataFrame) -> pd.DataFrame:
        """The exit of each chunk, from the last one backwards: one small map a chunk."""
        frame, x, seen = frame.sort_values("k", ascending=False), 0, []
        for exits in frame["exits"]:
            seen.append(x)
            x = int(exits[x])
        return pd.DataFrame({"_rid": frame["_rid"].to_numpy(), "k": frame["k"].to_numpy(), "x": seen})

    left = filled.select("_rid", "k", "exits").groupBy("_rid").applyInPandas(leave, "_rid long, k int, x int")

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = piece_model(path)
        for batch in batches:
            got = []
            for r in batch.itertuples(index=False):
                if r.s is None:
                    ids = np.frombuffer(r.heads[int(r.e)] + r.middle + r.tails[r.x], dtype=model.narrow)
                    got.append(ids.astype("<u4").tobytes())
                    continue
                steps, ids = np.frombuffer(r.steps, dtype="<u2"), np.frombuffer(r.tokens, dtype=model.narrow)
                got.append(model.trace(r.s, len(r.s) - r.x, r.a, np.arange(len(steps)) - steps, ids)[1])
            yield pd.DataFrame({"_rid": batch["_rid"], "doc": batch["doc"], "chunk": batch["k"], "ids": got})

    both = found.select("_rid", "doc", "k", "a", "s", "heads", "middle", "tails").join(filled.drop("exits").join(left, ["_rid", "k"]), ["_rid", "k"])
    return both.mapInPandas(trace, out)


def decode_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(key, n_tokens, ids_crc32, n_chunks, decoded): every text encoded, and decoded from its own ids again."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = piece_model(path)
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.iloc[k : k + 256]
                data = [b"".join(x) for x in part["x"]]
                yield pd.DataFrame({
                    "doc": part["doc"], "n_tokens": [len(d) // 4 for d in data], "ids_crc32": [zlib.crc32(d) for d in data],
                    "n_chunks": [len(x) for x in part["x"]], "decoded": [model.decode(np.frombuffer(d, dtype="<u4")) for d in data],
                })

    rows = _texts(docs, path, key, text, chunk).mapInPandas(run, f"doc {kind}, n_tokens long, ids_crc32 long, n_chunks int, decoded string")
    return rows.withColumnRenamed("doc", key)
