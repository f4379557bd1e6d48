"""The thin queries of the operators over the given tables, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import toxicity
from tidewell.llm.alignment import align_tokenizers
from tidewell.llm.idfiles import read_ids, write_ids
from tidewell.llm.jaccard import jaccard_components
from tidewell.llm.licenses import with_licenses
from tidewell.llm.lines import line_verdicts
from tidewell.llm.packing import pack_documents
from tidewell.llm.pieces import decode_pieces
from tidewell.llm.quality import judge
from tidewell.llm.secrets import train, with_secrets
from tidewell.llm.sharding import kd_shards
from tidewell.llm.simhash import edited_fingerprints
from tidewell.llm.tokens import vocabulary_path
from tidewell.llm.whitening import whitened_components

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return pack_documents(documents(spark, sf_dir), vocabulary_path(), capacity=1024, end_id=2)


@query
def op3_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all token ids as bit-packed files and read them back."""
    manifest = write_ids(documents(spark, sf_dir), vocabulary_path(), end_id=0)
    return read_ids(manifest).select("doc_id", "start", "n_tokens", F.col("ids_crc32").cast("long"))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the verdict of cross-document line frequency for every document."""
    judged = judge(documents(spark, sf_dir), keep=["doc_id"])
    return judged.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_removed")


@query
def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness."""
    return edited_fingerprints(documents(spark, sf_dir))


ORACLES["op5_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), ws AS (
  SELECT rid, list_filter(string_split_regex(t, '[ \t-\r]+'), lambda x: x <> '') AS w FROM d
), w AS (
  SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS n FROM ws
), win AS (
  SELECT rid, i, n, x AS a, lead(x, 1) OVER o AS b, lead(x, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM win WHERE i <= n - 2) WHERE k > 1
), covered AS (
  SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY rid
), l AS (
  SELECT rid, host, line, lower(trim(regexp_replace(line, '[ \t-\r]+', ' ', 'g'))) AS norm
  FROM (SELECT rid, host, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ \t-\r]')
), dups AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY rid
), u AS (
  SELECT rid, host, norm, sum(len(norm) - len(replace(norm, ' ', '')) + 1) AS words FROM l GROUP BY ALL
), sig AS (
  SELECT rid, string_agg(norm, chr(10) ORDER BY norm) AS whole FROM u GROUP BY rid
), above AS (
  SELECT host, norm FROM u JOIN sig USING (rid) GROUP BY host, norm HAVING count(DISTINCT whole) > 100
), lost AS (
  SELECT rid, sum(words) AS words_removed FROM u JOIN above USING (host, norm) GROUP BY rid
), base AS (
  SELECT d.rid, doc_id, len(ws.w) AS n_words, length(regexp_replace(t, '[ \t-\r]+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(words_removed, 0) AS words_removed
  FROM d JOIN ws USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN lost USING (rid)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (n_words - words_removed > 0.2 * n_words) AS kept,
  words_removed::BIGINT AS words_removed
FROM base
"""


@query
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by four-word shingles at a Jaccard similarity of 0.85."""
    return jaccard_components(documents(spark, sf_dir), n=4, percent=85)


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of every document stay after equal lines and lines one word apart were reduced to the earliest."""
    found = line_verdicts(documents(spark, sf_dir))
    places = F.array_join(F.transform("kept", lambda x: x.cast("string")), ",")
    return found.select("doc_id", "n_lines", "n_exact", "n_near", places.alias("kept_lines"))


ORACLES["op10_line_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, coalesce(text, '') AS t FROM documents
), l AS (
  SELECT rid, line_no, ws, array_to_string(ws, ' ') AS line, len(ws) AS n FROM (
    SELECT rid, i - 1 AS line_no, list_filter(string_split_regex(ls[i], '[ \t-\r]+'), lambda x: x <> '') AS ws
    FROM (SELECT rid, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT rid, string_split(t, chr(10)) AS ls FROM d))
  ) WHERE len(ws) > 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY line ORDER BY rid, line_no) AS k FROM l
), f AS (
  SELECT row_number() OVER (ORDER BY rid, line_no) AS ord, * FROM ranked WHERE k = 1
), v AS (
  SELECT ord, n, i, md5(array_to_string(list_concat(ws[1 : i - 1], ws[i + 1 :]), ' ')) AS m
  FROM (SELECT ord, n, ws, unnest(range(1, n + 1)) AS i FROM f WHERE n >= 8)
), sub AS (
  SELECT a.ord FROM v a JOIN v b ON a.m = b.m AND a.n = b.n AND a.i = b.i AND b.ord < a.ord
), whole AS (
  SELECT ord, n, md5(line) AS m FROM f WHERE n >= 8
), gap AS (
  SELECT v.ord AS longer, w.ord AS shorter FROM v JOIN whole w ON v.m = w.m AND v.n = w.n + 1
), near AS (
  SELECT ord FROM sub UNION SELECT longer FROM gap WHERE shorter < longer UNION SELECT shorter FROM gap WHERE longer < shorter
), stays AS (
  SELECT rid, count(*) AS n_first, count(near.ord) AS n_near, string_agg(CASE WHEN near.ord IS NULL THEN line_no::VARCHAR END, ',' ORDER BY line_no) AS kept_lines
  FROM f LEFT JOIN near USING (ord) GROUP BY rid
), counts AS (
  SELECT rid, count(*) AS n_lines FROM l GROUP BY rid
)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, (coalesce(n_lines, 0) - coalesce(n_first, 0))::BIGINT AS n_exact,
  coalesce(n_near, 0)::BIGINT AS n_near, coalesce(kept_lines, '') AS kept_lines
FROM d LEFT JOIN counts USING (rid) LEFT JOIN stays USING (rid)
"""


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every text: base kinds, and formats learned from them."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = with_secrets(docs, train(docs)).drop("text")
    named = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("secrets", lambda x: x["kind"] != "format")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.array_join(F.transform(base, named), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("secrets", named), ",").alias("spans"),
    )


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of nearly equal bytes by a k-d tree over metadata."""
    placed = kd_shards(documents(spark, sf_dir), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every text."""
    found = with_licenses(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    names = F.array_sort(F.array_distinct(F.col("licenses.matches.license")))
    spans = F.transform("licenses.matches", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string")))
    ids = F.array_join(F.transform("licenses.ids", lambda x: x.cast("string")), ",")
    known = F.size(F.filter("licenses.ids", lambda x: x > 0)).cast("long")
    return found.select("doc_id", known.alias("n_known"), ids.alias("sentence_ids"), F.array_join(names, ",").alias("licenses"), F.array_join(spans, ",").alias("spans"))


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text under the piece vocabulary, and the hash of what they decode to."""
    found = decode_pieces(documents(spark, sf_dir), vocabulary_path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_tokens", "ids_crc32", "n_chunks", F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding projected on 32 whitened principal components."""
    return whitened_components(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"), components=32)


@query
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of a byte-level and a piece vocabulary in every text, with corpus-wide link counts."""
    return align_tokenizers(documents(spark, sf_dir), vocabulary_path(), vocabulary_path("piece_bpe_32k.model"))


@query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text by a field that has never seen the labels of a fifth of the ids."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = toxicity.train(docs.where(~toxicity.held_out()), labels)
    found = toxicity.score(docs, model)
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"))
