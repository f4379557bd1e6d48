"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm.

Documents become pieces of at most ``capacity`` tokens; a full piece is a sequence of its own, the others are dealt at
random into blocks of bounded size, and every block is packed by several islands. A chromosome is a grouping of the block's
pieces into bins. Crossover injects whole well-filled bins of one parent, removes the pieces they duplicate, and best-fits
the displaced pieces; mutation dissolves poor bins. After each epoch the islands of a block exchange elites through a
shuffle. Bins that stay poorly filled are dissolved and their pieces dealt anew over all blocks, so the loss of a block's
last bin is made good. Only lengths travel, never texts or ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.tokens import codec
from tidewell.session import materialize

CAPACITY = 1024
BLOCK = 1024  # pieces of one block
ISLANDS = 3
EPOCHS = 2
POPULATION = 5
OFFSPRING = 6  # children of an island in one epoch
ROUNDS = 3
GOOD = 0.999  # fill from which a bin is kept between rounds

PIECES = "rid long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int | None, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every whole text with the checksum of their ids; a null text is an empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = codec(vocabulary)
        tail = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, rid, data in zip(batch["doc"], batch["rid"], enc.encode(batch["t"])):
                data += tail
                for i, (start, length) in enumerate(cut_pieces(len(data) // 4, capacity)):
                    rows.append((doc, rid, i, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
            yield pd.DataFrame(rows, columns=["doc", "rid", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc"), F.monotonically_increasing_id().alias("rid"), F.coalesce(text, F.lit("")).alias("t"))
    return rows.mapInPandas(run, f"doc {kind}, {PIECES}")


Bin = tuple[int, list[int]]  # free space, pieces


class Bins:
    """A growing set of bins with best-fit insertion in constant time: one bit mask over the free space of all bins."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_free: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def put_bin(self, free: int, items: list[int]) -> None:
        self.by_free[free].append(items)
        self.mask |= 1 << free

    def best_fit(self, item: int, size: int) -> None:
        room = self.mask >> size
        if not room:
            self.put_bin(self.capacity - size, [item])
            return
        free = size + (room & -room).bit_length() - 1
        items = self.by_free[free].pop()
        if not self.by_free[free]:
            self.mask ^= 1 << free
        items.append(item)
        left = free - size
        self.by_free[left].append(items)
        self.mask |= 1 << left

    def bins(self) -> list[Bin]:
        """All bins, the fullest first."""
        return [(free, items) for free, many in enumerate(self.by_free) for items in many]


def fitness(bins: list[Bin], capacity: int) -> float:
    """Fewer bins first, then unevenly filled ones, whose last bins are easy to dissolve."""
    return -len(bins) + sum((1 - free / capacity) ** 2 for free, _ in bins) / (len(bins) + 1)


def crossover(a: list[Bin], b: list[Bin], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[Bin]:
    """Inject a share of ``a``'s best-filled bins into ``b``, drop the bins of ``b`` they touch, best-fit what is displaced."""
    top = a[: max(1, len(a) * 2 // 3)]
    chosen = [x for x, keep in zip(top, (rng.random(len(top)) < 0.5).tolist()) if keep]
    child, inside = Bins(capacity), set()
    for free, items in chosen:
        child.put_bin(free, items.copy())
        inside.update(items)
    displaced: list[int] = []
    for free, items in b:
        if inside.isdisjoint(items):
            child.put_bin(free, items.copy())
        else:
            displaced += [i for i in items if i not in inside]
    for i in sorted(displaced, key=sizes.__getitem__, reverse=True):
        child.best_fit(i, sizes[i])
    return child.bins()


def mutate(bins: list[Bin], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[Bin]:
    """Dissolve the emptiest bins and a few random ones; best-fit their pieces in a slightly shaken order."""
    n = len(bins)
    out = set(range(n - max(1, n // 20), n)) | set(rng.integers(0, n, max(1, n // 10)).tolist())
    child, loose = Bins(capacity), []
    for k, (free, items) in enumerate(bins):
        if k in out:
            loose += items
        else:
            child.put_bin(free, items.copy())
    shake = rng.normal(0, capacity / 50, len(loose)).tolist()
    for _, i in sorted(zip((s - sizes[i] for i, s in zip(loose, shake)), loose)):
        child.best_fit(i, sizes[i])
    return child.bins()


def first_fit(sizes: list[int], capacity: int, rng: np.random.Generator, shake: float) -> list[Bin]:
    """Best fit in decreasing size, shaken by ``shake`` tokens."""
    order = np.argsort(-(np.array(sizes) + (rng.normal(0, shake, len(sizes)) if shake else 0)), kind="stable")
    child = Bins(capacity)
    for i in order.tolist():
        child.best_fit(i, sizes[i])
    return child.bins()


def labels(bins: list[Bin], n: int) -> list[int]:
    out = [0] * n
    for k, (_, items) in enumerate(bins):
        for i in items:
            out[i] = k
    return out


def from_labels(marks: list[int], sizes: list[int], capacity: int) -> list[Bin]:
    out: list[list[int]] = [[] for _ in range(max(marks, default=-1) + 1)]
    for i, k in enumerate(marks):
        out[k].append(i)
    return sorted(((capacity - sum(sizes[i] for i in b), b) for b in out if b), key=lambda x: x[0])


def evolve(sizes: list[int], elites: list[list[Bin]], capacity: int, seed: int, population: int, offspring: int) -> list[list[Bin]]:
    """One epoch of one island; returns its individuals, best first. Stops early at the least possible number of bins."""
    rng = np.random.default_rng(seed)
    least = -(-sum(sizes) // capacity)
    pop = list(elites)
    shake = 0.0 if not pop else capacity / 40
    while len(pop) < population and min(map(len, pop), default=least + 1) > least:
        pop.append(first_fit(sizes, capacity, rng, shake))
        shake = capacity / 40
    score = [fitness(p, capacity) for p in pop]
    for _ in range(offspring):
        if min(map(len, pop)) <= least or len(pop) < 2:
            break
        i, j = rng.choice(len(pop), 2, replace=False)
        child = crossover(pop[i], pop[j], sizes, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, sizes, capacity, rng)
        worst = int(np.argmin(score))
        got = fitness(child, capacity)
        if got > score[worst]:
            pop[worst], score[worst] = child, got
    return [pop[k] for k in np.argsort(-np.array(score), kind="stable")]


STATE = "block long, island int, sizes array<int>, elites array<array<int>>"


def _epoch(state: DataFrame, epoch: int, capacity: int, population: int, offspring: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for block, island, sizes, elites in zip(batch["block"], batch["island"], batch["sizes"], batch["elites"]):
                sizes = [int(x) for x in sizes]
                start = [from_labels([int(x) for x in e], sizes, capacity) for e in elites]
                seed = zlib.crc32(f"{block}/{island}/{epoch}".encode())
                best = evolve(sizes, start, capacity, seed, population, offspring)[:2]
                rows.append((block, island, sizes, [labels(b, len(sizes)) for b in best]))
            yield pd.DataFrame(rows, columns=["block", "island", "sizes", "elites"])

    return state.mapInPandas(run, STATE)


def pack_lengths(items: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, population: int = POPULATION, offspring: int = OFFSPRING, rounds: int = ROUNDS) -> DataFrame:
    """Pack ``items`` (id long, length long <= capacity): returns (id, sequence_id long, offset long).

    Lengths of 0 are packed like any other; an empty table gives an empty result. Each block holds at most about ``block``
    items whatever the input; the rounds are fixed, so the number of jobs does not depend on the data.
    """
    spark = items.sparkSession
    open_items, parts = items.select("id", F.col("length").cast("int").alias("length")), []
    for r in range(rounds):
        total = open_items.count()
        if not total:
            break
        n_blocks = -(-total // block)
        last = r == rounds - 1 or n_blocks == 1
        dealt = open_items.withColumn("block", F.pmod(F.xxhash64("id", F.lit(r)), F.lit(n_blocks)))
        rows = dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("length", "id"))).alias("x"))
        rows = materialize(rows, "pack-blocks")
        state = rows.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("x.length").alias("sizes"), F.lit(None).cast("array<array<int>>").alias("elites"))
        state = state.withColumn("elites", F.coalesce("elites", F.array().cast("array<array<int>>")))
        state = state.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block", "island")
        for e in range(epochs):
            state = materialize(_epoch(state, e, capacity, population, offspring), "pack-state")
            if e < epochs - 1:
                # Elite migration: an island goes on with its own elites and the best of its neighbour.
                best = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.slice("elites", 1, 1).alias("guest"))
                state = state.join(best, ["block", "island"]).select("block", "island", "sizes", F.concat("elites", "guest").alias("elites"))
        bins = F.array_size(F.array_distinct(F.col("elites")[0]))
        winner = state.groupBy("block").agg(F.min_by(F.col("elites")[0], F.struct(bins, F.col("island"))).alias("bin"))
        placed = rows.join(winner, "block").select("block", F.explode(F.arrays_zip(F.col("x.id").alias("id"), F.col("x.length").alias("length"), F.col("bin").alias("bin"))).alias("z"))
        placed = placed.select("block", F.col("z.id").alias("id"), F.col("z.length").alias("length"), F.col("z.bin").alias("bin"))
        # A bin holds at most one block's items, so this window is bounded.
        inside = Window.partitionBy("block", "bin")
        placed = placed.withColumn("fill", F.sum("length").over(inside))
        placed = placed.withColumn("offset", F.sum("length").over(inside.orderBy("length", "id").rowsBetween(Window.unboundedPreceding, -1)))
        done = materialize(placed.withColumn("offset", F.coalesce("offset", F.lit(0))), "pack-placed")
        keep = done if last else done.filter(F.col("fill") >= GOOD * capacity)
        parts.append(keep.select("id", F.xxhash64(F.lit(r), "block", "bin").alias("seq"), "offset"))
        if last:
            break
        open_items = done.filter(F.col("fill") < GOOD * capacity).select("id", "length")
    if not parts:
        return spark.createDataFrame([], "id long, sequence_id long, offset long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("id", F.col("seq").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int | None = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Columns: ``key``, piece int, start, length, ids_crc32, sequence_id, offset (long). A null text is an empty one (its
    only id is ``end_id``); rows with the same key are packed as documents of their own; other columns are ignored.
    """
    pieces = materialize(token_pieces(docs, vocabulary, end_id, capacity, key, text), "pack-pieces")
    # Only a document's first piece can be short, so its row number names it.
    short = pieces.filter((F.col("length") < capacity) & (F.col("piece") == 0))
    packed = pack_lengths(short.select(F.col("rid").alias("id"), "length"), capacity)
    full = pieces.filter((F.col("length") >= capacity) | (F.col("piece") > 0))
    full = full.withColumn("sequence_id", F.xxhash64(F.lit("full"), "rid", "piece")).withColumn("offset", F.lit(0).cast("long"))
    first = short.join(packed, short["rid"] == packed["id"]).drop("id")
    both = first.unionByName(full)
    return both.select(F.col("doc").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))
