"""Exact n-gram Jaccard join with a prefix tree over globally ordered n-gram sets.

The global order puts n-grams that many documents share last and all others by hash. Two sets that are similar enough share an n-gram
among their first few (the prefix), so the first level of the tree is dealt over the cluster by those n-grams. Below it, the
sets that may match one probe form a tree in a task: it is walked depth first, sets with a common beginning share the overlap counted
so far, and a subtree ends as soon as the n-grams left cannot reach the needed overlap.

* Equal sets are one class from the start, named by the hash of the set, so copies add no work.
* No n-gram gives all pairs at once: each class is tried against one class of each of its prefix n-grams, of a frequent one the class with the
  fewest n-grams of its own, which links most of a group of near copies. Where an n-gram has many classes, some drawn from it are then
  tried against those of other components. Only classes that are still in different components after that are tried
  against each other, and those of an n-gram's main component not among themselves. So no link between components is lost.
* Before a set travels, a pair must pass an exact bound: every class has a parity bitmap of about one to two bits an n-gram, and two
  sets differ in at least as many n-grams as their bitmaps differ in bits.

The order only steers work: counts of part of the hash space over all documents, and a bounded table of the most frequent n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import discard, materialize

COMMON = 16  # documents from which on an n-gram can be one of the frequent ones
FREQUENT_KEPT = 1 << 18  # most frequent n-grams that are moved to the end of the order; 4 MB
COUNTED_BELOW = -(1 << 62)  # the lowest quarter of the hashes, from which prefixes are made
BLOCK = 256  # sets in one tree
DEALT = 512  # classes of one n-gram that a task pairs with all others of it
LARGE = 64  # classes of one n-gram from which on some are drawn and tried against the others
TURNS = 2  # of drawing
MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]  # odd numbers


def gram_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's runs of ``n`` words, A-Z lower-cased; a shorter text is one run, none without words."""
    import xxhash

    digest, out = xxhash.xxh3_64_intdigest, []
    for t in texts:
        # On UTF-8 bytes, lower() touches A-Z only and split() cuts at blank, tab, LF, VT, FF and CR.
        words = (t or "").encode().lower().split()
        k = len(words)
        if k < n:
            out.append(np.array([digest(b"\0".join(words), seed=k)], dtype=np.uint64).view(np.int64) if k else np.zeros(0, dtype=np.int64))
            continue
        h = np.fromiter(map(digest, words), dtype=np.uint64, count=k)
        with np.errstate(over="ignore"):
            g = np.zeros(k - n + 1, dtype=np.uint64)
            for j in range(n):
                g = (g ^ (g >> np.uint64(29))) * np.uint64(MIX[j % 4]) + h[j : k - n + 1 + j]
            g = (g ^ (g >> np.uint64(32))) * np.uint64(MIX[0])
            g ^= g >> np.uint64(29)
        out.append(np.unique(g.view(np.int64)))
    return out


def _needed(a: int, b: int, percent: int) -> int:
    """Least intersection of sets of these sizes with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def _prefix(n: int, percent: int) -> int:
    """Grams of a set of ``n`` of which any similar enough set has one among its own."""
    return n - -(-percent * n // 100) + 1


def parity_bits(grams: np.ndarray) -> np.ndarray:
    """Parity of the number of n-grams on each bit, as longs; the number of bits is the least power of two from 64 on that is not below the set's size."""
    width = max(64, 1 << (len(grams) - 1).bit_length()) if len(grams) else 64
    on = np.bincount(grams & (width - 1), minlength=width) & 1
    return np.packbits(on.astype(np.uint8), bitorder="little").view("<i8")


def may_link(a: Column, b: Column, percent: int) -> Column:
    """False only for classes (n, bits) whose sets cannot be similar enough, by size or by the bits they differ in."""
    sizes = 100 * F.least(a["n"], b["n"]) >= percent * F.greatest(a["n"], b["n"])
    # Sets of such sizes have bitmaps of the same width, or one of twice the width, whose halves add up to the narrow one.
    x, y = (F.when(F.size(v["bits"]) <= F.size(w["bits"]), v["bits"]).otherwise(
        F.zip_with(F.slice(v["bits"], 1, F.size(w["bits"])), F.slice(v["bits"], F.size(w["bits"]) + 1, F.size(w["bits"])), lambda p, q: p.bitwiseXOR(q))) for v, w in ((a, b), (b, a)))
    differ = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, v: t + v)
    differ = F.coalesce(differ, F.lit(0))  # below 50 percent widths may be further apart, and only sizes tell
    return sizes & ((100 + percent) * (a["n"] + b["n"] - differ) >= 2 * percent * (a["n"] + b["n"]))


def _set_rows(n: int, percent: int):
    """Task code: size, name, bitmap and lowest hashes of every text's set, as many as its prefix may need."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.iloc[k : k + 512]
                sets = gram_sets(part["t"].tolist(), n)
                low = [s[: max(int(np.searchsorted(s, COUNTED_BELOW)), _prefix(len(s), percent))] if len(s) else s for s in sets]
                sig = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
                yield pd.DataFrame({"_rid": part["_rid"].to_numpy(), "k": part["k"].to_numpy(), "n": [len(s) for s in sets], "sig": sig, "low": low, "bits": [parity_bits(s) for s in sets]})

    return run


def _prefix_rows(frequent, percent: int, hot: bool):
    """Task code: the prefix grams of every distinct set of the task, the frequent and uncounted ones (with ``own``, how many counted grams of the set are not frequent) or the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, rank = frequent.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            parts = []
            for sig, n, low in zip(batch["sig"].tolist(), batch["n"].tolist(), batch["low"]):
                if not n or (sig, n) in seen:
                    continue
                seen.add((sig, n))
                low = np.asarray(low, dtype=np.int64)
                counted = low < COUNTED_BELOW
                common = np.zeros(len(low), dtype=bool)
                if len(table):
                    at = np.minimum(np.searchsorted(table, low), len(table) - 1)
                    common = table[at] == low
                    # Rare counted grams, frequent ones by their frequency, then the uncounted; each by hash.
                    order = np.lexsort((low, np.where(common, rank[at], -1), ~counted))
                    low, common, counted = low[order], common[order], counted[order]
                p = _prefix(n, percent)
                special = (common | ~counted)[:p]
                picked = np.nonzero(special if hot else ~special)[0]
                if len(picked):
                    parts.append((low[picked], picked, sig, int(np.count_nonzero(counted & ~common))))
            if parts:
                sizes = [len(x[0]) for x in parts]
                out = {"gram": np.concatenate([x[0] for x in parts]), "pos": np.concatenate([x[1] for x in parts]), "sig": np.repeat([x[2] for x in parts], sizes)}
                yield pd.DataFrame(out | {"own": np.repeat([x[3] for x in parts], sizes)} if hot else out)

    return run


def walk_tree(probe: np.ndarray, sets: list[np.ndarray], percent: int, step: int = 32) -> list[int]:
    """Indexes of the ``sets`` (sorted arrays) whose Jaccard with ``probe`` reaches the threshold.

    The sorted list of sets is the tree in depth-first order. ``path`` holds, for the current branch, the overlap with the probe after
    every n-gram; a following set keeps what it shares with it. A set is left as soon as its overlap and the n-grams left on
    either side cannot reach what it needs, and so are all sets that share its branch to that depth and need as much.
    """
    order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">i8").tobytes())
    found: list[int] = []
    last: np.ndarray | None = None
    path = np.zeros(1, dtype=np.int64)
    for k in order:
        s = sets[k]
        shared = 0
        if last is not None:
            m = min(len(path) - 1, len(s), len(last))
            differ = np.nonzero(s[:m] != last[:m])[0]
            shared = int(differ[0]) if len(differ) else m
        need = _needed(len(probe), len(s), percent)
        path, last = path[: shared + 1], s
        depth, alive = shared, True
        while True:
            left_probe = len(probe) - (int(np.searchsorted(probe, s[depth - 1], side="right")) if depth else 0)
            if path[-1] + min(len(s) - depth, left_probe) < need:
                alive = False
                break
            if depth >= len(s):
                break
            piece = s[depth : depth + step]
            at = np.minimum(np.searchsorted(probe, piece), len(probe) - 1)
            path = np.concatenate([path, path[-1] + np.cumsum(probe[at] == piece)])
            depth += len(piece)
        if alive and path[-1] >= need:
            found.append(k)
    return found


def _verify_rows(percent: int):
    """Task code over rows sorted by (probe, chunk, role): the probe's row comes first, then its candidates."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, probe, names, sets = None, None, [], []

        def flush():
            hits = walk_tree(probe, sets, percent) if probe is not None and sets else []
            return [(key[0], names[k]) for k in hits]

        for batch in batches:
            out = []
            for a, chunk, role, sig, grams in zip(batch["a"], batch["chunk"], batch["role"], batch["sig"], batch["set"]):
                if (a, chunk) != key:
                    out += flush()
                    key, probe, names, sets = (a, chunk), None, [], []
                grams = np.frombuffer(grams, dtype=np.int64)
                if role == 0:
                    probe = grams
                else:
                    names.append(sig)
                    sets.append(grams)
            yield pd.DataFrame(out, columns=["a", "b"])
        yield pd.DataFrame(flush(), columns=["a", "b"])

    return run


def _role_rows(n: int):
    """Task code: the set of a text, once for each of its roles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.iloc[k : k + 512]
                rows = [(r["a"], r["chunk"], r["role"], sig, s.tobytes()) for sig, roles, s in zip(part["sig"], part["roles"], gram_sets(part["t"].tolist(), n)) for r in roles]
                yield pd.DataFrame(rows, columns=["a", "chunk", "role", "sig", "set"])

    return run


def verified(texts: DataFrame, where: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough. ``pairs`` is a written table, ``where`` names one row (_rid) of each class (sig) in ``texts`` (_rid, t)."""
    spark = texts.sparkSession
    chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
    dealt = pairs.join(chunks, "a").select("a", "b", F.pmod(F.hash("b"), F.col("chunks")).alias("chunk"))
    # A class plays the probe in its own trees and a candidate in others.
    roles = dealt.select(F.col("b").alias("sig"), F.struct("a", "chunk", F.lit(1).alias("role")).alias("x"))
    roles = roles.unionByName(dealt.select(F.col("a").alias("sig"), F.struct("a", "chunk", F.lit(0).alias("role")).alias("x")).distinct())
    # Written, so that its true size decides how the texts are joined.
    wanted = materialize(roles.join(where, "sig").groupBy("_rid").agg(F.first("sig").alias("sig"), F.collect_list("x").alias("roles")), "roles")
    rows = texts.join(wanted, "_rid").select("sig", "roles", "t").mapInPandas(_role_rows(n), "a long, chunk int, role int, sig long, set binary")
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a", "chunk").sortWithinPartitions("a", "chunk", "role")
    links = materialize(rows.mapInPandas(_verify_rows(percent), "a long, b long"), "links")
    discard(pairs, wanted)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of every linked node's component, by alternating large-star and small-star steps.

    ``links`` has (a, b). The state is a written table after each step; only a count and a checksum reach the driver.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        discard(last)
        state = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if state == before:
            found = materialize(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "roots")
            discard(edges)
            return found
        before = state


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id): set size and the least key reachable over links of Jaccard >= ``percent`` / 100.

    Texts without words have the empty set and are linked with nothing; a null text is one of them. Rows with the same key are rows of
    their own. Null keys take part but never name a component of others. The rows are numbered and written once, because
    a number made while reading may change when the table is planned again. Other columns are ignored.
    """
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("_rid"), F.col(key).alias("k"), F.col(text).alias("t")), "numbered")
    found = _of_rows(numbered, n, percent)
    discard(numbered)
    return found.select(F.col("k").alias(key), F.col("n").cast("long").alias("n_shingles"), "component_id")


def _split_grams(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The prefix rows with the component (root) of their class, and the n-grams whose classes are in several: (gram, main, size, main_size).

    Of n-grams with the same classes the first in the global order stays. The component with most of an n-gram's classes is its main one.
    """
    placed = rows.join(found.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    same = ["size", "lo", "hi", "mark"]
    roots = placed.groupBy("gram", "root").agg(
        F.sum("pos").alias("at"), F.count("*").alias("size"), F.min("sig").alias("lo"), F.max("sig").alias("hi"), F.expr("bit_xor(xxhash64(sig))").alias("mark"))
    groups = roots.groupBy("gram").agg(
        F.count("*").alias("roots"), F.max(F.struct("size", "root")).alias("main"), F.sum("at").alias("at"), F.sum("size").alias("size"), F.min("lo").alias("lo"),
        F.max("hi").alias("hi"), F.bit_xor("mark").alias("mark")).filter("roots > 1")
    groups = groups.groupBy(*same).agg(F.min(F.struct("at", "gram", "main")).alias("g"))
    return placed, groups.select("g.gram", F.col("g.main.root").alias("main"), "size", F.col("g.main.size").alias("main_size"))


def _room(a: Column, b: Column, percent: int) -> Column:
    """False only where the n-grams from the first shared one on are too few for what the two sets need."""
    return (100 + percent) * F.least(a["n"] - a["pos"], b["n"] - b["pos"]) >= percent * (a["n"] + b["n"])


def _nearer(rows: DataFrame, found: DataFrame, classes: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b) of classes in different components: a was drawn from an n-gram with ``LARGE`` classes or more, b is any other class of it.

    Two are drawn for each n-gram and turn, one from its main component and one from all its classes, so a class meets some dozens of others. The
    rows are at most twice the prefix rows, whatever the size of a group.
    """
    placed, groups = _split_grams(rows, found)
    still = materialize(placed.join(groups.filter(F.col("size") >= LARGE), "gram").join(classes.select("sig", "n", "bits"), "sig"), "large-apart")
    me = F.struct("pos", "n", "sig", "root", "bits")
    drawn = F.xxhash64("sig", "gram", F.lit(turn))
    leads = still.groupBy("gram").agg(F.array_distinct(F.array(F.min_by(me, drawn), F.min_by(me, F.when(F.col("root") == F.col("main"), drawn)))).alias("leads"))
    a, b = F.col("a"), F.col("b")
    pairs = still.select("gram", me.alias("b")).join(leads.select("gram", F.explode("leads").alias("a")), "gram")
    pairs = pairs.filter((a["root"] != b["root"]) & _room(a, b, percent) & may_link(a, b, percent))
    pairs = materialize(pairs.select(a["sig"].alias("a"), b["sig"].alias("b")).distinct(), "pairs-nearer")
    discard(still)
    return pairs


def _apart(rows: DataFrame, found: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that share a prefix n-gram, may be similar enough and are in different components of ``found``.

    Only n-grams whose classes are not all in one component take part. The classes outside an n-gram's main component are dealt out in parts of
    ``DEALT``, each met by all classes of the n-gram.
    """
    placed, groups = _split_grams(rows, found)
    groups = groups.select("gram", "main", F.ceil((F.col("size") - F.col("main_size")) / DEALT).cast("int").alias("parts"))
    still = materialize(placed.join(groups, "gram").join(classes.select("sig", "n", "bits"), "sig"), "apart")
    me = F.struct("pos", "n", "sig", "root", "bits")
    left = still.filter("root <> main").select("gram", F.pmod(F.hash("sig"), F.col("parts")).alias("part"), me.alias("a"))
    right = still.select("gram", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("root") == F.col("main"), me.alias("b")).toDF("gram", "part", "in_main", "b")
    a, b = F.col("a"), F.col("b")
    once = F.col("in_main") | (a["root"] < b["root"])
    pairs = left.join(right, ["gram", "part"]).filter(once & _room(a, b, percent) & may_link(a, b, percent))
    # An n-gram may have another main component than the next: the class of the lesser component goes first everywhere.
    first, second = (F.when(a["root"] < b["root"], x["sig"]).otherwise(y["sig"]) for x, y in ((a, b), (b, a)))
    pairs = materialize(pairs.select(first.alias("a"), second.alias("b")).distinct(), "pairs-apart")
    discard(still)
    return pairs


def _of_rows(numbered: DataFrame, n: int, percent: int) -> DataFrame:
    """(_rid, k, n, sig, root, component_id) of every row (_rid, k, t) of a written table; ``root`` is null where a text has no words."""
    spark = numbered.sparkSession
    kind = numbered.schema["k"].dataType.simpleString()
    texts = numbered.select("_rid", "t")
    sets = materialize(numbered.mapInPandas(_set_rows(n, percent), f"_rid long, k {kind}, n int, sig long, low array<long>, bits array<long>"), "sets")
    slim = materialize(sets.select("_rid", "k", "n", "sig"), "row-classes")
    classes = sets.filter("n > 0").groupBy("sig").agg(F.min("_rid").alias("_rid"), F.min("k").alias("least"), F.min("n").alias("n"), F.first("bits").alias("bits"))
    classes = materialize(classes, "classes")

    counted = sets.select(F.explode(F.filter("low", lambda g: g < F.lit(COUNTED_BELOW))).alias("gram")).groupBy("gram").agg(F.count("*").alias("docs"))
    top = counted.filter(F.col("docs") >= COMMON).orderBy(F.desc("docs"), "gram").limit(FREQUENT_KEPT)
    written = materialize(top, "frequent-grams")  # so that the shuffle of the counts goes
    top = written.toPandas()
    discard(written)
    top = top.sort_values(["docs", "gram"], kind="stable")
    rank = np.arange(len(top))
    table = top["gram"].to_numpy(dtype=np.int64)
    by_gram = np.argsort(table, kind="stable")
    frequent = spark.sparkContext.broadcast((table[by_gram], rank[by_gram]))

    def prefix(hot: bool) -> DataFrame:
        return sets.select("sig", "n", "low").mapInPandas(_prefix_rows(frequent, percent, hot), "gram long, pos int, sig long" + ", own int" * hot)

    # Most n-grams occur once: a window, which sorts and spills, leaves those with two classes or more. Frequent ones are combined map-side.
    one = Window.partitionBy("gram")
    rare = prefix(False).withColumns({"lo": F.min("sig").over(one), "hi": F.max("sig").over(one)}).filter("lo <> hi").drop("hi").distinct()
    often = materialize(prefix(True).distinct(), "frequent-rows")
    lead = often.groupBy("gram").agg(F.min(F.struct("own", "sig"))["sig"].alias("lead"), F.min("sig").alias("lo"), F.max("sig").alias("hi")).filter("lo <> hi").drop("lo", "hi")
    rows = materialize(rare.withColumnRenamed("lo", "lead").unionByName(often.drop("own").join(lead, "gram")), "shared-rows")
    # The hashes are the largest table and have no further use; texts and sets that travel next take their place on disk.
    discard(often, sets)

    first = rows.filter("sig <> lead").select(F.col("lead").alias("a"), F.col("sig").alias("b")).distinct()
    for side in "ab":
        first = first.join(classes.select(F.col("sig").alias(side), F.struct("n", "bits").alias("_" + side)), side)
    first = materialize(first.filter(may_link(F.col("_a"), F.col("_b"), percent)).select("a", "b"), "first-pairs")
    links = verified(texts, classes.select("sig", "_rid"), first, n, percent)
    found = components(links)
    # Large groups are tried against drawn members before what is still apart is listed.
    for turn in range(TURNS + 1):
        more = _nearer(rows, found, classes, percent, turn) if turn < TURNS else _apart(rows, found, classes, percent)
        if more.isEmpty():
            discard(more)
            continue
        again = verified(texts, classes.select("sig", "_rid"), more, n, percent)
        # A component's root stands for what linked it before.
        before, found = found, components(again.unionByName(found.toDF("a", "b")))
        discard(before, again)

    rooted = classes.join(found.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "least", F.coalesce("root", "sig").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    rooted = rooted.join(named, "root").select("sig", "root", "component_id")
    out = slim.select("_rid", "k", "n", "sig").join(rooted, "sig", "left")
    named = F.when(F.col("n") > 0, F.coalesce("component_id", "k")).otherwise(F.col("k"))
    out = materialize(out.select("_rid", "k", "n", "sig", F.when(F.col("n") > 0, F.col("root")).alias("root"), named.alias("component_id")), "row-components")
    discard(slim, classes, rows, links, found)
    return out


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, the one with the least key; columns are those of ``docs``.

    A row without words is a component of its own and stays. Rows are told apart by a number of their own, so a repeated key loses
    no row that is linked with nothing. Null keys come after all others; of rows of a component with the same key one stays, chosen by
    the hash of its set, then by its place.
    """
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("_rid"), F.struct("*").alias("doc")), "numbered")
    doc = F.col("doc")
    found = _of_rows(numbered.select("_rid", doc[key].alias("k"), doc[text].alias("t")), n, percent)
    first = found.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "sig", "_rid")).alias("x"), F.count("*").alias("rows"))
    # The rows that go are written: where they are few, their size is known before the join and the documents are not shuffled.
    gone = found.join(first.filter("rows > 1"), "root").filter(F.col("_rid") != F.col("x._rid"))
    gone = materialize(gone.select("_rid"), "gone")
    discard(found)
    return numbered.join(gone, "_rid", "left_anti").select("doc.*")
