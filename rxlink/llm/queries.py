"""Queries of the corpus operators over whole tables, and their SQL.

Each query takes its rows from its operator with production parameters and
derives the contract's digest columns from them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxlink.llm import decontam, embed_dedup, license_scan, line_dedup, near_dedup, packing, secrets_scan, tokens, toxicity, warc

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"
TOKEN_LIMIT = 4096


def tokenizer_file(name: str) -> str:
    """Where this machine keeps the public tokenizer file of that name."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table's columns (all if none is named). A table that comes in fewer
    pieces than there are cores, as a file of one row group, is dealt to all of
    them; larger ones are read as they lie, without a shuffle."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    score = F.col("__tx_score")
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(spark, table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return out.filter("gap_start IS NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets_scan.scan_secrets(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.col("__ss_base")
    counts = [secrets_scan.counted(base, i).alias(f"n_{k}") for i, k in enumerate(secrets_scan.KINDS[:3])]
    return out.select("doc_id", *counts, F.sha2(secrets_scan.spelled(base), 256).alias("base_sha256"), secrets_scan.spelled(F.col("__ss_spans")).alias("spans"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))
    best = F.col("__ls_best")
    return out.select("doc_id", best["license"].alias("license"), F.round(F.coalesce(best["dice"], F.lit(0.0)), 6).alias("dice"), F.coalesce(best["unit"], F.lit(-1)).cast("long").alias("unit"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.scan_benchmark(table(spark, sf_dir, "documents", "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.col("__bd_items")
    return out.select(
        "doc_id", F.col("__bd_words").alias("n_words"), F.col("__bd_hit").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("__bd_hit") > 0).alias("contaminated"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file(PIECE_MODEL))
    n = F.col("__tc_tokens")
    return out.select("doc_id", F.col("__tc_bytes").alias("n_bytes"), n.alias("n_tokens"), (n > TOKEN_LIMIT).alias("over_limit"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file(BYTE_MODEL))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_toxicity, op3_near_dedup, op4_warc, op5_secrets, op6_licenses, op7_embedding_dedup, op8_decontamination, op9_token_counts, op10_packing)
}

_OP1 = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT doc_id, line, i, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, (f.keeper IS NOT NULL AND f.keeper <> k.doc_id) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

_OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
g AS (SELECT a AS u, b AS v FROM k UNION ALL SELECT b, a FROM k),
r(u, v) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.u, g.v FROM r JOIN g ON r.v = g.u)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT u, min(v) AS component_id FROM r GROUP BY u) c ON c.u = n.doc_id
"""

_OP7 = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
k AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95),
r(u, v) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, k.v FROM r JOIN k ON r.v = k.u),
c AS (SELECT u, min(v) AS component_id FROM r GROUP BY u),
n AS (SELECT u, count(*) AS n FROM k GROUP BY u)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""

_OP8 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
m AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, unnest(list_transform(range(1, greatest(2, len(ws) - 8)), lambda i: array_to_string(ws[i:i+9], ' '))) AS g FROM b WHERE len(ws) > 0),
s AS (SELECT DISTINCT n FROM m),
g AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i+n-1], ' '))) AS g FROM d, s WHERE len(ws) >= n),
h AS (SELECT g.doc_id, g.i, g.n, m.item_id FROM g JOIN m ON g.g = m.g AND g.n = m.n),
c AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

_OP4 = r"""
WITH d AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
b AS (SELECT page_id, h, array_to_string(list_transform(range(0, 8), lambda k: array_to_string(list_transform([15, 10, 5, 0],
        lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST(concat('0x', substr(x, 5 * k + 1, 5)) AS BIGINT) >> s) & 31) + 1 AS BIGINT), 1)), '')), '') AS payload_digest FROM d),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM b)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM m
"""


def _op6() -> str:
    rows = ", ".join("('{}', [{}])".format(k, ", ".join(f"'{g}'" for g in license_scan.template_bigrams(v))) for k, v in license_scan.TEMPLATES.items())
    return rf"""
WITH t(name, tg) AS (VALUES {rows}),
u AS (SELECT doc_id, 0 AS unit, coalesce(text, '') AS s FROM documents UNION ALL
      SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS unit, unnest(string_split(coalesce(text, ''), chr(10))) AS s FROM documents),
w AS (SELECT doc_id, unit, regexp_extract_all(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS ws FROM u),
g AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1]))) AS gs FROM w WHERE len(ws) >= 2),
m AS (SELECT doc_id, unit, name, 2.0 * len(list_intersect(gs, tg)) / (len(gs) + len(tg)) AS d FROM g, t),
k AS (SELECT * FROM m WHERE d >= {license_scan.DICE} - 1e-12 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d DESC, unit, name) = 1)
SELECT x.doc_id, k.name AS license, round(coalesce(k.d, 0.0), 6)::DOUBLE AS dice, coalesce(k.unit, -1)::BIGINT AS unit FROM documents x LEFT JOIN k ON x.doc_id = k.doc_id
"""


ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": _OP1, "op3_near_dedup": _OP3, "op4_warc": _OP4, "op6_licenses": _op6(), "op7_embedding_dedup": _OP7, "op8_decontamination": _OP8,
}
