"""K-d tree sharding: nodes split at weighted medians along their widest metadata dimension until the leaves reach the target bytes.

Rows are points; their dimensions are codes of metadata columns in 0..65535. A row's place along a dimension is one number: the dimension's code,
then bits of the text's hash, then bits of the row's hash. So equal texts with equal metadata lie together and ties are cut
exactly. The weighted medians of all nodes of a level are found at once, digit by digit: each pass sums bytes by (node, digit), at most
65,536 sums for a node, and the cut is exact or ends early when the sums on both sides are near enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import materialize

DIGIT = 16
CODES = 1 << DIGIT
NEAR = 1e-4  # share of a node's bytes by which a cut may miss the median


def text_columns(docs: DataFrame, text: str = "text") -> dict[str, Column]:
    """UTF-8 bytes plus 1, unsigned CRC-32 and hash of the text; a null text counts as an empty one."""
    t = F.coalesce(F.col(text), F.lit(""))
    return {"size": (F.octet_length(t) + 1).cast("long"), "text_crc32": F.crc32(t).cast("long"), "_hash": F.xxhash64(t)}


def dimension_codes(docs: DataFrame, dimensions: list[str], text: str) -> list[Column]:
    """A code in 0..65535 for each dimension: numbers by the logarithm of their size, anything else by hash. Null is 0."""
    codes = []
    for name in dimensions:
        kind = docs.schema[name].dataType.typeName()
        c = F.col(name)
        if kind in ("byte", "short", "integer", "long", "float", "double", "decimal"):
            code = F.log2(F.abs(c.cast("double")) + 1) * F.lit(1000.0)
        else:
            code = F.pmod(F.xxhash64(c.cast("string")), F.lit(CODES - 1)) + 1
        codes.append(F.coalesce(F.least(F.greatest(code.cast("int"), F.lit(0)), F.lit(CODES - 1)), F.lit(0)).cast("long"))
    return codes


def _pick(dims: int) -> Column:
    """The code of the node's dimension ``_dim``."""
    return F.element_at("_codes", F.col("_dim") + 1)


def _place() -> Column:
    """The row's place along the node's dimension: 16 bits of code, 32 of the text's hash, 15 of the row's hash (63 in all)."""
    low = F.shiftrightunsigned("_hash", 32)
    row = F.shiftrightunsigned("_row", 49)
    return F.shiftleft(_pick(0), 47).bitwiseOR(F.shiftleft(low, 15)).bitwiseOR(row)


def kd_shards(docs: DataFrame, target_bytes: int | None = None, shards: int | None = None, dimensions: tuple[str, ...] = ("source", "lang", "n_chars"), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard int, slot long): leaves of the tree, numbered from 0, and gapless places within them.

    Give ``shards``, or ``target_bytes`` from which their number follows. A node with n leaves is cut so that its sides' bytes stand as the
    leaves on either side. Dimensions that the table lacks are left out; with none the hashes alone decide. Rows with the same key are rows
    of their own. An empty table gives an empty result.
    """
    dims = [d for d in dimensions if d in docs.columns]
    codes = dimension_codes(docs, dims, text) or [F.lit(0).cast("long")]
    rows = docs.select(F.col(key), *[c.alias(n) for n, c in text_columns(docs, text).items()], F.array(*codes).alias("_codes"))
    rows = materialize(rows.withColumn("_row", F.xxhash64(F.col(key), "_hash", F.monotonically_increasing_id())), "shard-rows")
    if shards is None:
        total = rows.agg(F.sum("size")).first()[0] or 1
        shards = max(1, -(-int(total) // int(target_bytes or total)))
    spark = docs.sparkSession
    nodes = [(0, shards)]  # (first leaf, number of leaves); the first leaf names the node
    at = rows.withColumn("_node", F.lit(0))
    while any(n > 1 for _, n in nodes):
        cuts = _cut_level(at, [x for x in nodes if x[1] > 1], len(codes))
        table = spark.createDataFrame(cuts, "_node int, _dim int, _cut long, _right int") if cuts else None
        if table is not None:
            # One row for each node: as many as there are shards at most.
            joined = at.join(F.broadcast(table), "_node", "left")
            above = F.col("_cut").isNotNull() & (_place() >= F.col("_cut"))
            at = joined.withColumn("_node", F.when(above, F.col("_right")).otherwise(F.col("_node"))).drop("_dim", "_cut", "_right")
        nodes = [y for first, n in nodes for y in ([(first, n)] if n == 1 else [(first, n // 2), (first + n // 2, n - n // 2)])]
        at = materialize(at, "shard-nodes")
    return _slots(at, key)


def _cut_level(at: DataFrame, nodes: list[tuple[int, int]], dims: int) -> list[tuple[int, int, int, int]]:
    """(node, dimension, cut, right child) of each node of a level; rows at ``cut`` or above go right. Plain numbers, one row a node."""
    spark = at.sparkSession
    w = F.col("size").cast("double")
    moments = [m for d in range(dims) for m in (F.sum(w * F.col("_codes")[d]), F.sum(w * F.col("_codes")[d] * F.col("_codes")[d]))]
    stats = at.groupBy("_node").agg(F.sum("size").alias("bytes"), *[m.alias(f"m{k}") for k, m in enumerate(moments)]).collect()
    leaves = dict(nodes)
    state: dict[int, dict] = {}
    for r in stats:
        if r["_node"] not in leaves:
            continue
        total = float(r["bytes"])
        spread = [r[f"m{2 * d + 1}"] / total - (r[f"m{2 * d}"] / total) ** 2 for d in range(dims)]
        n = leaves[r["_node"]]
        state[r["_node"]] = {"dim": max(range(dims), key=lambda d: (spread[d], -d)), "total": total, "goal": total * (n // 2) / n, "below": 0.0, "prefix": 0, "cut": None, "right": r["_node"] + n // 2}
    if not state:
        return []
    for shift in (47, 31, 15, 0):
        open_nodes = {k: s for k, s in state.items() if s["cut"] is None}
        if not open_nodes:
            break
        table = spark.createDataFrame([(k, s["dim"], s["prefix"]) for k, s in open_nodes.items()], "_node int, _dim int, _prefix long")
        bits = 15 if shift == 0 else DIGIT
        placed = at.join(F.broadcast(table), "_node").select("_node", "_prefix", "size", _place().alias("p"))
        placed = placed.filter(F.shiftright("p", shift + bits) == F.col("_prefix")) if shift < 47 else placed
        sums = placed.groupBy("_node", F.shiftright("p", shift).alias("digit")).agg(F.sum("size").alias("b"))
        # The digit whose running sum passes what is still missing; at most 65,536 digits of a node are in one window.
        goals = spark.createDataFrame([(k, s["goal"] - s["below"]) for k, s in open_nodes.items()], "_node int, _goal double")
        along = Window.partitionBy("_node").orderBy("digit")
        run = sums.withColumn("upto", F.sum("b").over(along)).join(F.broadcast(goals), "_node")
        hit = run.filter(F.col("upto") >= F.col("_goal")).groupBy("_node").agg(F.min_by(F.struct("digit", "b", "upto"), "digit").alias("x")).collect()
        for r in hit:
            s, x = state[r["_node"]], r["x"]
            before = s["below"] + x["upto"] - x["b"]
            slack = NEAR * s["total"]
            if abs(before - s["goal"]) <= slack or (shift == 0 and s["goal"] - before < x["b"] / 2):
                s["cut"] = x["digit"] << shift
            elif abs(before + x["b"] - s["goal"]) <= slack or shift == 0:
                s["cut"] = (x["digit"] + 1) << shift
            else:
                s["below"], s["prefix"] = before, x["digit"]
    return [(k, s["dim"], s["cut"], s["right"]) for k, s in state.items() if s["cut"] is not None]


def _slots(at: DataFrame, key: str, chunk: int = 20_000) -> DataFrame:
    """Gapless places in each shard, numbered in chunks of bounded size and carried over by the chunks' counts."""
    largest = at.groupBy("_node").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    chunks = -(-int(largest) // chunk)
    cut = at.withColumn("_chunk", F.pmod("_row", F.lit(chunks)))
    counts = cut.groupBy("_node", "_chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("_node").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_node", "_chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_node", "_chunk").orderBy("_row", key))
    placed = cut.withColumn("_in", inside).join(base, ["_node", "_chunk"])
    return placed.select(key, "size", "text_crc32", F.col("_node").cast("int").alias("shard"), (F.col("_base") + F.col("_in") - 1).cast("long").alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write ``docs`` under ``path``, one folder ``shard=k`` for each shard, rows in slot order within each file. Keys must be unique."""
    rows = docs.join(placed.select(key, "shard", "slot"), key)
    rows.repartition("shard", F.floor(F.col("slot") / 50_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
