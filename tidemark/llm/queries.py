"""The registered queries of the corpus operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom_lm, common, decontaminate, embeddings, html_main, jaccard, langid, packing, quality_fm, spelling, token_files, tokens, url_filters, vector_codes, warc_zip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(common.table(spark, sf_dir, "documents"), tokens.tokenizer_path("word_bpe_49k.json"), end_id=1, length=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length")


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "token-files")
    token_files.write_token_files(common.table(spark, sf_dir, "documents"), path, tokens.tokenizer_path("byte_bpe_50k.json"), end_id=0)
    files = token_files.read_token_files(spark, path)
    return token_files.with_global_start(token_files.with_crc32(files), files).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_links(common.table(spark, sf_dir, "documents"), width=3, percent=90)


ORACLES["op2_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reached AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a),
parts AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, p.component_id FROM sets s JOIN parts p ON s.doc_id = p.doc_id
"""


@query
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(common.table(spark, sf_dir, "embeddings"), threshold=0.95)


ORACLES["op5_embedding_near_dedup"] = """
WITH RECURSIVE vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
usable AS (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM vectors
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95),
reached AS (SELECT vec_id, vec_id AS other FROM vectors UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON r.other = l.a),
parts AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT p.vec_id, coalesce(c.n_links, 0) AS n_links, p.component_id, p.vec_id = p.component_id AS kept
FROM parts p LEFT JOIN counts c ON p.vec_id = c.vec_id
"""


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = langid.train(docs.where(common.fold("doc_id", 4) != 2))
    told = langid.predict(docs.select("doc_id", "text"), model)
    return told.select("doc_id", (common.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


@query
def op9_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    labels = common.table(spark, sf_dir, "labels").where(common.fold("doc_id", 3) != 1)
    scored = quality_fm.score(docs.select("doc_id", "text", "n_chars"), quality_fm.train(docs, labels))
    return scored.select("doc_id", (common.fold("doc_id", 3) == 1).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


@query
def op7_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = bloom_lm.train(docs.where(common.fold("doc_id", 10) != 0))
    scored = bloom_lm.score(docs, model)
    return scored.select("doc_id", (common.fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query
def op10_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_pages(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query
def op4_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_zip.archive_pages(common.table(spark, sf_dir, "pages"), common.scratch_path(spark, "wacz"))
    return warc_zip.with_payloads(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op4_warc_zip"] = """
WITH told AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS head
  FROM pages)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> head THEN head END AS refers_to
FROM told
"""


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


@query
def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
    rules = [*[url_filters.host_rule(*r) for r in hosts], *url_filters.PATTERNS]
    judged = url_filters.judge(common.table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", *[F.col(f"url_{c}").alias(c) for c in ("host", "path", "rule", "verdict")])


# the host rules by comparing hosts and paths, the method's patterns as plain regular expressions
ORACLES["op11_url_filters"] = r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS name, rest FROM cut),
told AS (SELECT page_id, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(name) + 1) AS tail FROM named),
urls AS (SELECT page_id, host, regexp_extract(tail, '^[^?#]*') AS path, tail FROM told),
rules AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) t(h, p, verdict)),
fits AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, CASE
  WHEN regexp_matches(host || tail, '/robots\.txt$', 'i') THEN 'allow'
  WHEN regexp_matches(host, '(^|\.)(adult-|adult\.|casino-|casino\.|ads\.|adserver\.|track\.|tracker\.)', 'i') THEN 'block'
  WHEN regexp_matches(tail, '/casino/|/wp-login\.php|/wp-admin/|/(login|signin|cart|checkout)([^A-Za-z0-9_.%-]|$)', 'i') THEN 'block'
  ELSE 'allow' END) AS verdict
FROM urls u LEFT JOIN fits f ON f.page_id = u.page_id
"""


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), parts=8, entries=16, rounds=6, scale=4096)


def _codes_sql(rounds: int = 6) -> str:
    """All rounds one after the other, every part against every entry."""
    near = """near{0} AS MATERIALIZED (SELECT vec_id, p, any_value(q) AS q, min(struct_pack(d := d, e := e)) AS m FROM (
  SELECT a.vec_id, a.p, a.q, b.e, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: (a.q[i] - b.q[i]) * (a.q[i] - b.q[i]))) AS d FROM parts a JOIN book{0} b ON a.p = b.p) GROUP BY vec_id, p)"""
    book = """book{1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.q, b.q) AS q FROM book{0} b LEFT JOIN (
  SELECT p, e, list(CAST(floor(s / c) AS BIGINT) ORDER BY i) AS q FROM (
    SELECT p, m.e AS e, i, sum(q[i]) AS s, count(*) AS c FROM near{0}, range(1, 9) t(i) GROUP BY ALL) GROUP BY p, e) n ON n.p = b.p AND n.e = b.e)"""
    steps = [x.format(k, k + 1) for k in range(rounds) for x in (near, book)] + [near.format(rounds)]
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, v[p * 8 + 1 : p * 8 + 8] AS q FROM kept, range(8) t(p)),
book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, q FROM parts QUALIFY e < 16),
{", ".join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', CAST(m.e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)
SELECT k.vec_id, k.label, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM kept k JOIN coded c ON k.vec_id = c.vec_id"""


ORACLES["op12_vector_codes"] = _codes_sql()


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.runs(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    # of every 97th word of a document, by hash, one code point is deleted
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    spelt = F.when(h % 97 == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return spelling.variants(spelling.vocabulary(found.select(spelt.alias("word"))))
