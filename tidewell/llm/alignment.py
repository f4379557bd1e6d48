"""Alignment of two tokenizers' tokens over the same bytes by diagonal run skipping.

Both tokenizers cut the bytes of blank + text. Two end arrays are walked at an index shift (how far the second index is
ahead of the first): as long as the ends agree at that shift, tokens correspond one to one, and exponential probing compares
slices of 1, 2, 4, ... ends at once, then halves back to the first disagreement, so a stretch is jumped in a few
comparisons. Where the ends disagree, the irregular group up to the next common end is resolved token by token, which gives
its links and the new shift.

Texts travel once. A task aligns about ``AT_ONCE`` characters at a time and writes one row for them: the figures of each
text, its links as places in a table of the distinct id pairs of that row, and the table. Only the tables are shuffled: they are
summed to corpus-wide counts, the counts are joined back to the tables, and each row is finished with its own table. A
pair is in a table once however often it occurs, so no pair holds a large share of the shuffled rows.

Defined results: texts that are null, empty or whose joined token bytes differ from blank + text (the piece model writes
U+2581 as a blank) have no tokens, zeros and an empty ``groups_sha256``. Null and repeated ids stay as they are; a repeated row
counts as often as it occurs. Special tokens inside a text are plain text.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  not loaded by pyarrow itself
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.tokens import byte_letters, codec
from tidewell.session import fresh_path

AT_ONCE = 1 << 18  # characters aligned at a time; a longer text is one on its own
KEPT_UNITS = 150_000  # parts of texts whose piece ids a worker keeps
KEPT_CHARS = 40  # longer parts are not kept
ROW_GROUP = 16 << 20  # bytes a task holds back while it writes: the rows are long
WIDTH = 8  # bytes of one end offset
A, B, BOTH = 1, 2, 3  # whose next token comes
STRETCH = bytes([BOTH]) * 64
SHORT = 8  # ends compared one by one before slices pay
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"


def diagonal_walk(a: np.ndarray, b: np.ndarray) -> bytearray:
    """The moves through two rising end arrays with the same last end: A, B, or BOTH indices go on after each link."""
    xs, ys, x, y = a.astype("<i8").tobytes(), b.astype("<i8").tobytes(), a.tolist(), b.tolist()
    moves, i, j, n, m = bytearray(), 0, 0, len(a), len(b)
    while i < n:
        p, q = x[i], y[j]
        if p == q:
            k, step, room = 1, SHORT, min(n - i, m - j)
            near = min(SHORT, room)
            while k < near and x[i + k] == y[j + k]:
                k += 1
            while k < room and x[i + k] == y[j + k]:  # probe twice as far each time
                step = min(step, room - k)
                if xs[(i + k) * WIDTH : (i + k + step) * WIDTH] != ys[(j + k) * WIDTH : (j + k + step) * WIDTH]:
                    while step > 1:  # halve back to the first disagreement among the next ``step`` ends
                        step //= 2
                        if xs[(i + k) * WIDTH : (i + k + step) * WIDTH] == ys[(j + k) * WIDTH : (j + k + step) * WIDTH]:
                            k += step
                    break
                k, step = k + step, step * 2
            moves += STRETCH[:k] if k <= len(STRETCH) else STRETCH[:1] * k
            i, j = i + k, j + k
            continue
        while p != q:  # an irregular group: up to the next common end
            if p < q:
                i += 1
                p = x[i]
                moves.append(A)
            else:
                j += 1
                q = y[j]
                moves.append(B)
        moves.append(BOTH)
        i, j = i + 1, j + 1
    return moves


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first of a, first of b) of every group and (index of a, index of b) of every link, in order."""
    moves = np.frombuffer(diagonal_walk(a, b), dtype=np.uint8)
    link_a, link_b = np.cumsum(moves & A, dtype=np.int64), np.cumsum(moves >> 1, dtype=np.int64)
    link_a -= moves & A
    link_b -= moves >> 1
    first = np.append(True, moves[:-1] == BOTH)[: len(moves)]
    return link_a[first], link_b[first], link_a, link_b


def same_bytes(ids: list[np.ndarray], texts: list[str], bytes_of: np.ndarray) -> list[np.ndarray | None]:
    return [x if b"".join(bytes_of[x].tolist()) == (" " + t).encode() else None for x, t in zip(ids, texts)]


class ByteSide:
    """Ids of blank + text under a byte-level vocabulary, and the bytes of each id.

    With a letter for every byte and no normalisation the tokens' bytes are always those of the text.
    """

    def __init__(self, path: str):
        self.codec = codec(path)
        back = {c: k for k, c in byte_letters().items()}
        vocab = self.codec.tokenizer.get_vocab()
        self.bytes = np.full(max(vocab.values()) + 1, b"", dtype=object)
        for token, k in vocab.items():
            self.bytes[k] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.faithful = all(c in vocab for c in back) and self.codec.tokenizer.normalizer is None

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text, None where their bytes differ from blank + text."""
        got = [np.frombuffer(d, dtype="<u4") for d in self.codec.encode(" " + t for t in texts)]
        return got if self.faithful else same_bytes(got, texts, self.bytes)


class PieceSide:
    """Ids of a text under a piece model, and the bytes of each id.

    No piece of the model goes on after a blank, over a line feed or, where that holds, from a letter to another kind of
    character, so merges never cross these places: the parts between them are encoded on their own and remembered. A line
    feed goes before each part, because the model puts a blank before every text.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = sp = SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(k) for k in range(sp.get_piece_size())]
        self.bytes = np.full(len(pieces), b"", dtype=object)
        inner = []
        for k, p in enumerate(pieces):
            self.bytes[k] = bytes([int(p[3:5], 16)]) if sp.is_byte(k) else p.replace("▁", " ").encode()
            if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k)):
                inner.append(p.lstrip("▁"))
        self.head = sp.encode("\n")
        mixed = re.compile(f"[{LETTERS}][^{LETTERS}]|[^{LETTERS}][{LETTERS}]")
        self.whole = any("▁" in p or "\n" in p for p in inner) or len(self.head) != 2 or self.bytes[self.head[0]] != b" "
        self.unit = re.compile("\n| *[^ \n]+| +" if any(mixed.search(p) for p in inner) else f"\n| *[{LETTERS}]++| *[^ \n{LETTERS}]++| +")
        self.known: dict[str, bytes | None] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text, None where their bytes differ from blank + text."""
        if self.whole:
            return same_bytes([np.array(ids, dtype="<u4") for ids in self.model.encode(texts, num_threads=1)], texts, self.bytes)
        cut = [self.unit.findall(" " + t) for t in texts]
        units: set[str] = set()
        for c in cut:
            units.update(c)
        if len(self.known) > KEPT_UNITS:
            self.known = {}
        new = [u for u in units if u not in self.known]
        here = self.known
        if any(len(u) > KEPT_CHARS for u in new):
            here = dict(self.known)  # holds the long parts for this call only
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            for u, ids in zip(some, self.model.encode(["\n" + u for u in some], num_threads=1)):
                # A text's tokens have its bytes if those of all its parts have theirs; a part that has not is no ids at all.
                same = b"".join([self.bytes[k] for k in ids[2:]]) == u.encode()
                here[u] = got = array("I", ids[2:]).tobytes() if same else None
                if here is not self.known and len(u) <= KEPT_CHARS:
                    self.known[u] = got
        get, out = here.__getitem__, []
        for c in cut:
            got = list(map(get, c))
            out.append(None if None in got else np.frombuffer(b"".join(got), dtype="<u4"))
        return out


@lru_cache(maxsize=2)
def sides(byte_path: str, piece_path: str) -> tuple[ByteSide, PieceSide]:
    """One pair of tokenizers per worker process."""
    return ByteSide(byte_path), PieceSide(piece_path)


def written(bytes_of: np.ndarray, between: str, last: str) -> np.ndarray:
    """Two rows of texts: the decimal id followed by ``between`` or by ``last``."""
    return np.array([[f"{k}{mark}" for k in range(len(bytes_of))] for mark in (between, last)], dtype=object)


class Aligner:
    """Aligns lists of texts; one per worker process."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = sides(byte_path, piece_path)
        self.width_a, self.width_b = (np.array([len(x) for x in s.bytes], dtype=np.int64) for s in (self.a, self.b))
        self.text_a, self.text_b = written(self.a.bytes, ",", "|"), written(self.b.bytes, ",", ";")

    def __call__(self, texts: list[str]) -> dict:
        """Per text n_a, n_b, n_groups, n_links, groups_sha256; all links as places in the distinct pairs (id of b << 32 | id of a)."""
        ids_a, ids_b = self.a.encode(texts), self.b.encode(texts)
        for k, t in enumerate(texts):
            if not t or ids_a[k] is None or ids_b[k] is None:
                ids_a[k] = ids_b[k] = np.zeros(0, dtype="<u4")
        n_a, n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (ids_a, ids_b))
        a, b = np.concatenate(ids_a).astype(np.int64), np.concatenate(ids_b).astype(np.int64)
        # All texts are one stream of bytes: both sides end where a text ends.
        group_a, group_b, link_a, link_b = align(np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b]))
        to_a, to_b = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
        n_groups, n_links = np.diff(np.searchsorted(group_a, to_a)), np.diff(np.searchsorted(link_a, to_a))
        last_a, last_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        end_a, end_b = np.append(group_a[1:], len(a)), np.append(group_b[1:], len(b))
        parts = np.empty(len(a) + len(b), dtype=object)
        if len(a):
            last_a[end_a - 1] = last_b[end_b - 1] = 1
            parts[np.arange(len(a)) + np.repeat(group_b, end_a - group_a)] = self.text_a[last_a, a]
            parts[np.arange(len(b)) + np.repeat(end_a, end_b - group_b)] = self.text_b[last_b, b]
        hashes = []
        for s, e in zip(to_a + to_b, (to_a + to_b)[1:]):
            hashes.append(hashlib.sha256("".join(parts[s:e].tolist())[:-1].encode()).hexdigest() if e > s else "")
        pairs, links, times = np.unique(b[link_b] << 32 | a[link_a], return_inverse=True, return_counts=True)
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": hashes, "links": links.astype("<u2" if len(pairs) <= 1 << 16 else "<u4"), "pairs": pairs, "times": times}


@lru_cache(maxsize=2)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def portions(sizes: Iterable[int]) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive texts with about AT_ONCE characters together."""
    start = total = k = 0
    for k, size in enumerate(sizes, 1):
        total += size
        if total >= AT_ONCE:
            yield start, k
            start, total = k, 0
    if k > start:
        yield start, k


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def align_tokenizers(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row for each row of ``docs``."""
    kind = docs.schema[key].dataType.simpleString()

    def one(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        run, base = aligner(byte_path, piece_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            keys, texts = batch.column("doc"), batch.column("t")
            for s, e in portions(x.as_py() for x in pa.compute.utf8_length(texts)):
                got = run(texts.slice(s, e - s).to_pylist())
                columns = {"batch": pa.array([base], pa.int64()), "doc": one(pa.concat_arrays([keys.slice(s, e - s)]))}
                columns |= {c: one(pa.array(got[c], pa.int64())) for c in COUNTS}
                columns |= {"groups_sha256": one(pa.array(got["groups_sha256"], pa.string())), "links": pa.array([got["links"].tobytes()], pa.binary())}
                columns |= {c: one(pa.array(got[c], pa.int64())) for c in ("pairs", "times")}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
                base += 1

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner.cache_clear()  # a worker that aligned before does not need its tokenizers and words any more
        sides.cache_clear()
        codec.cache_clear()
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                value = lambda c: row.column(c).flatten()
                n = value("n_links").to_numpy(zero_copy_only=False)
                known, links = value("known").to_numpy(zero_copy_only=False), row.column("links")[0].as_py()
                known = known[np.frombuffer(links, dtype="<u2" if len(known) <= 1 << 16 else "<u4")]
                upto = np.append(0, np.cumsum(n))
                sums = [np.append(0, np.cumsum(x))[upto] for x in (known & 1, known >> 1)]
                out = {"doc": value("doc")} | {c: value(c) for c in COUNTS}
                out |= {"n_best": pa.array(np.diff(sums[0]), pa.int64()), "count_sum": pa.array(np.diff(sums[1]), pa.int64()), "groups_sha256": value("groups_sha256")}
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    lists = ", ".join(f"{c} array<long>" for c in COUNTS)
    rows = docs.select(F.col(key).alias("doc"), F.coalesce(text, F.lit("")).alias("t"))
    marked = rows.mapInArrow(mark, f"batch long, doc array<{kind}>, {lists}, groups_sha256 array<string>, links binary, pairs array<long>, times array<long>")
    path = fresh_path(docs.sparkSession, "alignment")
    marked.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    marked = docs.sparkSession.read.schema(marked.schema).parquet(path)
    tables = marked.select("batch", F.posexplode(F.arrays_zip("pairs", "times")).alias("at", "x")).select("batch", "at", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = tables.groupBy("pair").agg(F.sum("times").alias("n"))
    # One row for each id of the piece vocabulary at most, so its size does not grow with the input.
    tops = counts.groupBy(F.shiftright("pair", 32).alias("b")).agg(F.max("n").alias("top"))
    known = counts.join(F.broadcast(tops), F.shiftright("pair", 32) == F.col("b")).select("pair", (F.col("n") * 2 + (F.col("n") == F.col("top")).cast("long")).alias("known"))
    back = tables.join(known, "pair").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("at", "known"))).alias("known"))
    back = back.select("batch", F.col("known.known").alias("known"))
    # A row without any token has no table.
    whole = marked.drop("pairs", "times").join(back, "batch", "left").withColumn("known", F.coalesce("known", F.array().cast("array<long>"))).drop("batch")
    out = ", ".join(f"{c} long" for c in [*COUNTS, "n_best", "count_sum"])
    return whole.mapInArrow(finish, f"doc {kind}, {out}, groups_sha256 string").withColumnRenamed("doc", key)
