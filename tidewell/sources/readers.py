"""A1-A4: snapshot, dataset, information-document and dictionary readers.

Schemas are always given, never inferred. Every reader accepts JSON lines (splittable, the form to use at
scale) and, with ``lines=False``, one JSON document per file as small sources publish it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INVENTORY = "array<struct<VaccineId: string, VaccInventory: double, AppointmentPhone: string, AppointmentUrl: string>>"
# Days are read as text, so that a value of the wrong type is not taken for a missing one.
DAYS = "struct<Day1: string, Day2: string, Day3: string, Day4: string, Day5: string, Day6: string, Day7: string>"
RAW_FIELDS = {
    "Id": "long", "HospitalId": "string", "HospitalName": "string", "City": "string", "Dist": "string", "Address": "string", "Phone": "string",
    "Lat": "double", "Long": "double", "FluOperationTimeData": DAYS, "VaccData": INVENTORY, "Note": "string",
}
FACILITY = (
    "struct<id: long, code: string, name: string, city: string, dist: string, addr: string, tel: string, lat: double, lng: double, "
    "hours: array<int>, stock: map<string, int>>"
)
DATASET = (
    "meta struct<generatedAt: string, source: string, count: long, rawCount: long>, "
    "vaccines array<struct<id: string, `group`: string, name: string, short: string>>, groups array<struct<id: string, name: string>>, "
    f"hospitals array<{FACILITY}>"
)
BLOCK = (
    "struct<type: string, level: int, text: string, ordered: boolean, caption: string, runs: array<struct<text: string, href: string>>, "
    "items: array<string>, levels: array<int>, head: array<string>, rows: array<array<string>>>"
)
LINK = "struct<text: string, href: string, isNew: boolean, ext: string>"
INFO = (
    "meta struct<lang: string, sourceUrl: string, sourceTitle: string, title: string, fetchedAt: string, changedAt: string, translation: string, translatedAt: string>, "
    f"sections array<struct<id: string, key: string, hash: string, title: string, updated: string, translated: boolean, blocks: array<{BLOCK}>, "
    f"links: array<{LINK}>, files: array<{LINK}>>>"
)


def newest_snapshot(spark: SparkSession, root: str, pattern: str = r"[^/]*\.json(?:\.gz)?") -> str:
    """Path of the snapshot with the greatest name under ``root``; a snapshot is a file or a folder of part files.

    Only the file listing is read: the path column of the binary source needs no file content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    name = F.regexp_extract(F.col("path"), rf"/({pattern})(?:/[^/]*)?$", 1)
    best = files.filter(name != "").agg(F.max_by(F.regexp_extract("path", rf"^(.*/{pattern})(?:/[^/]*)?$", 1), name).alias("p")).first()["p"]
    if best is None:
        raise FileNotFoundError(f"no snapshot under {root}")
    return best


def read_raw(spark: SparkSession, root: str, lines: bool = True) -> DataFrame:
    """A1: facilities of the newest raw snapshot, plain or gzip."""
    path = newest_snapshot(spark, root)
    if lines:
        return spark.read.schema(", ".join(f"`{n}` {t}" for n, t in RAW_FIELDS.items())).json(path)
    row = ", ".join(f"`{n}`: {t}" for n, t in RAW_FIELDS.items())
    doc = spark.read.schema(f"harvestedAt string, source string, hospitals array<struct<{row}>>").option("multiLine", "true").json(path)
    return doc.select("harvestedAt", F.explode("hospitals").alias("h")).select("harvestedAt", "h.*")


def raw_columns(raw: DataFrame) -> DataFrame:
    """Source field names to the names the conformance jobs use."""
    inventory = F.transform("VaccData", lambda v: F.struct(
        v["VaccineId"].alias("product"), v["VaccInventory"].alias("quantity"), v["AppointmentPhone"].alias("phone"), v["AppointmentUrl"].alias("url")
    ))
    return raw.select(
        F.col("Id").alias("id"), F.col("HospitalId").alias("code"), F.col("HospitalName").alias("name"), F.col("City").alias("city"), F.col("Dist").alias("dist"),
        F.col("Address").alias("addr"), F.col("Phone").alias("tel"), F.col("Lat").alias("lat"), F.col("Long").alias("lng"),
        F.col("FluOperationTimeData").alias("days"), F.coalesce(inventory, F.array()).alias("inventory"), F.col("Note").alias("note"),
    )


def _typed(fields: list[str]) -> Column:
    """True where every field kept its type (a value of another type reads as NULL)."""
    return reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in fields])


def read_dataset(spark: SparkSession, path: str, lines: bool = True) -> dict[str, DataFrame]:
    """A2: meta, product, product_group, facility and offering tables of dataset documents.

    Facilities whose required fields are missing or of another type are dropped. Every table keeps the document's
    generation time, so that many documents may be read at once.
    """
    doc = spark.read.schema(DATASET).option("multiLine", str(not lines).lower()).json(path)
    at = F.col("meta.generatedAt").alias("generated_at")
    facility = doc.select(at, F.explode("hospitals").alias("h")).select("generated_at", "h.*")
    facility = facility.filter(_typed(["id", "name", "city", "dist", "addr", "lat", "lng", "hours", "stock"]) & (F.size("hours") == 7))
    return {
        "meta": doc.select("meta.*"),
        "product": doc.select(at, F.posexplode("vaccines").alias("ord", "v")).select("generated_at", "ord", "v.*"),
        "product_group": doc.select(at, F.posexplode("groups").alias("ord", "g")).select("generated_at", "ord", "g.*"),
        "facility": facility.drop("stock"),
        "offering": facility.select("generated_at", F.col("id").alias("facility_id"), F.explode("stock").alias("product_id", "in_stock")),
    }


def read_info(spark: SparkSession, path: str, lines: bool = True) -> dict[str, DataFrame]:
    """A3: doc_meta, section, block, run, item, cell, link and file tables of information documents, positions kept."""
    doc = spark.read.schema(INFO).option("multiLine", str(not lines).lower()).json(path)
    doc_key = [F.col("meta.lang").alias("lang"), F.col("meta.sourceUrl").alias("source_url")]
    sec = doc.select(*doc_key, F.posexplode("sections").alias("section_pos", "s")).withColumn("section_id", F.col("s.id"))
    skey = ["lang", "source_url", "section_id"]
    block = sec.select(*skey, F.posexplode("s.blocks").alias("block_pos", "b"))
    bkey = [*skey, "block_pos"]
    head = F.when(F.col("b.head").isNotNull(), F.array(F.col("b.head"))).otherwise(F.array().cast("array<array<string>>"))
    rows = block.select(*bkey, F.size(head).alias("_heads"), F.posexplode(F.concat(head, F.coalesce("b.rows", F.array().cast("array<array<string>>")))).alias("row", "r"))
    return {
        "doc_meta": doc.select("meta.*"),
        "section": sec.select(*skey, F.col("section_pos").alias("pos"), "s.key", "s.hash", "s.title", F.col("s.updated").try_cast("date").alias("updated"), F.coalesce("s.translated", F.lit(False)).alias("translated")),
        "block": block.select(*skey, F.col("block_pos").alias("pos"), "b.type", "b.level", "b.text", "b.ordered", "b.caption"),
        "run": block.select(*bkey, F.posexplode("b.runs").alias("pos", "x")).select(*bkey, "pos", "x.text", "x.href"),
        "item": block.select(*bkey, "b.levels", F.posexplode("b.items").alias("pos", "text")).select(*bkey, "pos", F.coalesce(F.get("levels", F.col("pos")), F.lit(0)).alias("level"), "text"),
        "cell": rows.select(*bkey, "row", (F.col("row") < F.col("_heads")).alias("is_head"), F.posexplode("r").alias("col", "text")),
        "link": sec.select(*skey, F.posexplode("s.links").alias("pos", "x")).select(*skey, "pos", "x.text", "x.href", F.coalesce("x.isNew", F.lit(False)).alias("is_new")),
        "file": sec.select(*skey, F.posexplode("s.files").alias("pos", "x")).select(*skey, "pos", "x.text", "x.href", F.coalesce("x.isNew", F.lit(False)).alias("is_new"), "x.ext"),
    }


def read_dictionary(spark: SparkSession, path: str, kind: str = "labels", lines: bool = True) -> DataFrame:
    """A4: a key-to-text JSON object as rows. ``places`` documents hold cities, and districts keyed "city|district"."""
    text = {"multiLine": str(not lines).lower()}
    if kind == "places":
        doc = spark.read.schema("cities map<string, string>, districts map<string, string>").options(**text).json(path)
        parts = F.split("k", r"\|", 2)
        city = doc.select(F.explode("cities").alias("city", "text")).select("city", F.lit("").alias("dist"), "text")
        dist = doc.select(F.explode("districts").alias("k", "text")).select(F.get(parts, 0).alias("city"), F.get(parts, 1).alias("dist"), "text")
        return city.unionByName(dist)
    lang = F.regexp_extract(F.col("_metadata.file_path"), r"/([A-Za-z-]+)(?:\.json|/[^/]*$)", 1)
    rows = spark.read.text(path, wholetext=not lines).select(lang.alias("lang"), F.from_json("value", "map<string, string>").alias("m"))
    return rows.select("lang", F.explode("m").alias("key", "text"))
