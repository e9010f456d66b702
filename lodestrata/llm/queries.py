"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, htmltext, langid, neardup, secrets, suffixes, toxicity, warc, winnowing
from .common import is_held_out, table

TOXIC_FROM = 0.7


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", secrets.findings(F.col("text")).alias("found"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["base"] & (x["kind"] == kind))).cast("long")
    base = secrets.as_text(F.filter("found", lambda x: x["base"]))
    return docs.select("doc_id", *(count(k).alias(f"n_{k}") for k in secrets.KINDS), F.sha2(base, 256).alias("base_sha256"), secrets.as_text(F.col("found")).alias("spans"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.captured(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "timestamp", "place")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    """Learnt from the labelled rows outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~is_held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    return toxicity.fit(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity_model(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), toxicity.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", htmltext.main_text(htmltext.trained(), F.col("html")).alias("r"))
    return pages.select("page_id", "url", "r.text", "r.n_chars")


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compared_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, spec=neardup.Spec(words=4))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~is_held_out(F.col("doc_id"))))
    found = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), langid.identify(model, F.col("text")).alias("r"))
    return found.select("doc_id", "held_out", F.col("r.lang").alias("lang_pred"), "r.score", "r.margin", "r.rejected")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", bpe.digests(tokenizer_file(), F.col("text")).alias("r"))
    return docs.select("doc_id", "r.*")


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = suffixes.with_ranges(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", suffixes.digests(F.col("text"), F.col("ranges")).alias("r")).select("doc_id", "r.*")


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_warc, op3_toxicity, op4_decontaminate, op5_html_text, op6_winnowing, op7_minhash, op8_language, op9_bpe, op10_suffixes)}

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {at}, 5))::INT >> {shift}) & 31), 1)"
_BASE32 = " || ".join(_DIGIT.format(at=i, shift=s) for i in range(1, 41, 5) for s in (15, 10, 5, 0))
_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '')"
_SHINGLES = "list_transform(range({first}, {last}), lambda k: array_to_string({w}[k + 1:k + 5], ' '))"

ORACLE_SQL: dict[str, str] = {
    "op2_warc": rf"""
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY b) AS last, regexp_extract(url, '^[a-z]+://([^/?#]*)([^?#]*)(\?[^#]*)?', ['host', 'path', 'query']) AS u FROM p),
c AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to, array_to_string(list_reverse(string_split(lower(u.host), '.')), ',') || ')' || CASE WHEN u.path = '' THEN '/' ELSE u.path END || u.query AS urlkey,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y%m%d%H%M%S') AS timestamp
FROM q)
SELECT *, row_number() OVER (ORDER BY urlkey, timestamp, page_id) - 1 AS place FROM c""",
    "op4_decontaminate": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS v FROM benchmark),
ds AS (SELECT doc_id, k, array_to_string(w[k + 1:k + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS k FROM d)),
s AS (SELECT item_id, k, array_to_string(v[k + 1:k + 5], ' ') AS g FROM (SELECT item_id, v, unnest(range(0, len(v) - 4)) AS k FROM i)),
hits AS (SELECT DISTINCT ds.doc_id, s.item_id, greatest(least(ds.k - s.k, len(d.w) - len(i.v)), 0) AS start FROM ds JOIN s ON s.g = ds.g JOIN d ON d.doc_id = ds.doc_id JOIN i ON i.item_id = s.item_id),
t AS (SELECT h.*, {_SHINGLES.format(first="start", last="least(start + len(i.v), len(d.w)) - 4", w="d.w")} AS a, {_SHINGLES.format(first="0", last="len(i.v) - 4", w="i.v")} AS b FROM hits h JOIN d ON d.doc_id = h.doc_id JOIN i ON i.item_id = h.item_id),
m AS (SELECT doc_id, item_id, start, len(a) AS na, len(b) AS nb, list_sum(list_transform(list_distinct(b), lambda g: least(len(list_filter(a, lambda x: x = g)), len(list_filter(b, lambda x: x = g))))) AS n FROM t),
r AS (SELECT doc_id, item_id, start, n / (na + nb - n)::DOUBLE AS similarity FROM m)
SELECT doc_id, item_id, start::INT AS start, similarity FROM r WHERE similarity >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1""",
    "op7_minhash": r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 3, 1))) AS k FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r(d, m) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.d, e.b FROM r JOIN e ON e.a = r.m)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id, c.m = t.doc_id AS kept FROM t LEFT JOIN n ON n.doc_id = t.doc_id JOIN (SELECT d, min(m) AS m FROM r GROUP BY d) c ON c.d = t.doc_id""",
}
