"""The operators over the given tables, with what they return where a contract fixes it, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.llm import decontaminate, exact_dedup, language_id, line_dedup, link_graph
from almagest.llm import conversations, lbl_scoring, mixing, near_dedup, secrets, token_counts, toxicity
from almagest.llm.common import remainder, table


# A public vocabulary of byte pairs.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.sections(table(spark, sf_dir, "documents"), VOCABULARY)


def substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeats(table(spark, sf_dir, "documents")).drop("row_key")


def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents"))


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select(
        "doc_id", F.col("found.words").alias("n_words"), hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SPACED = f"regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+')"

DECONTAMINATION_SQL = f"""
WITH b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
g AS (
  SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS gram
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)
),
d AS (SELECT doc_id, {WORDS} AS w FROM documents),
o AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)
),
m AS (SELECT doc_id, k, n, item FROM o JOIN g USING (n, gram)),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS at FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""


def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


MIX_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(length(text), 0) AS chars, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
k AS (
  SELECT *, -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5e0) / 281474976710656e0)
    / (1e0 / (1e0 + abs(chars / greatest(size, 1) - 6e0))) AS sample_key FROM d
),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM z),
q AS (SELECT *, CAST([5, 2, 1][place % 3 + 1] AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap FROM p),
e AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS stopped, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open,
    CAST(sum(source_size) OVER () AS DOUBLE) AS whole
  FROM q WINDOW before AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
v AS (SELECT (whole - stopped) / open AS level FROM e WHERE (whole - stopped) / open * weight <= cap ORDER BY cap / weight, place LIMIT 1),
t AS (SELECT source, source_size, least(cap, level * weight) AS target FROM e, v),
f AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
    CAST(round(target) AS BIGINT) AS budget FROM t
),
o AS (
  SELECT k.doc_id, k.size, f.source_size, f.target, f.epochs, f.budget - f.epochs * f.source_size
    - (sum(k.size) OVER (PARTITION BY k.source ORDER BY sample_key, doc_id ROWS UNBOUNDED PRECEDING) - k.size) AS remains
  FROM k JOIN f ON k.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(epochs * size + greatest(0, least(size, remains)) AS BIGINT) AS taken FROM o
"""


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("secrets")).alias("spans"),
    )


# Fixed rules: verdict, host, path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_graph.judge(table(spark, sf_dir, "pages"), URL_RULES)


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    scored = toxicity.score(docs, toxicity.learn(docs, known))
    return scored.select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.CUTOFF).cast("int").alias("predicted"),
    )


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = language_id.profiles(docs.where(remainder("doc_id", 3) != 1))
    found = language_id.identify(docs.select("doc_id", "text"), learned)
    return found.select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score")
    )


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.components_of(table(spark, sf_dir, "documents"), shingle=3, similarity=0.85)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


NEAR_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {SPACED} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + least(3, len(w)) - 1], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM w WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * shared >= 85 * (a.size + b.size - shared)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS low FROM r GROUP BY x)
SELECT doc_id, coalesce(size, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
       least(doc_id, coalesce(low, doc_id)) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON x = doc_id
"""


def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts, model = lbl_scoring.learn(docs.where(remainder("doc_id", 10) != 0))
    found = lbl_scoring.score(docs, counts, model)
    return found.select(
        "doc_id", F.coalesce(remainder("doc_id", 10) == 0, F.lit(True)).alias("held_out"), F.col("lm.tokens").alias("n_tokens"), F.col("lm.known").alias("n_known"),
        F.lit(model.known.total).cast("long").alias("train_tokens"), F.col("lm.base").alias("base_score"), F.col("lm.score").alias("score"),
    )


# name -> (query, SQL or None)
QUERIES = {
    "op1_token_counts": (tokens, None),
    "op2_substring_dedup": (substrings, None),
    "op3_secrets": (secret_scan, None),
    "op4_exact_dedup": (exact, EXACT_SQL),
    "op5_decontamination": (decontamination, DECONTAMINATION_SQL),
    "op6_url_filter": (url_filter, None),
    "op7_toxicity": (toxic, None),
    "op8_language": (language, None),
    "op9_near_dedup": (near, NEAR_SQL),
    "op10_mixing": (mix, MIX_SQL),
    "op11_lm_scoring": (language_model, None),
    **conversations.QUERIES,
}
