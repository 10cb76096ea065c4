"""The registered queries of the training-data operators, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, hard_negatives, html_text, importance, language_id, media, near_duplicates, packing, sharding, token_counts, toxicity, url_filter
from .common import table

RULES = [
    url_filter.Rule("net/", url_filter.BLOCK),
    url_filter.Rule("example.net/en/", url_filter.ALLOW),
    url_filter.Rule("example.com/de/", url_filter.BLOCK),
    url_filter.Rule("org/fr/", url_filter.ALLOW),
]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.histogram(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.digest(near_duplicates.group(table(spark, sf_dir, "documents")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.media_columns(table(spark, sf_dir, "documents")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.screen(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shard(table(spark, sf_dir, "documents")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", noisy), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_url_filter,
        op3_toxicity,
        op4_token_counts,
        op5_language_id,
        op6_near_duplicates,
        op7_packing,
        op8_media,
        op9_decontamination,
        op10_sharding,
        op11_importance_resampling,
        op12_bpe,
        op13_hard_negatives,
    )
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_FITS = " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}'" for r in sorted(RULES, key=lambda r: -len(r.text))
)
_STEM, _END = (f"regexp_extract(s, '(?s)^(.*?)(\\.[A-Za-z]{{1,5}}[0-9]?)?$', {i})" for i in (1, 2))
_SHAPE = f"""CASE WHEN regexp_matches({_STEM}, '^[0-9]+$') THEN '{{n}}' || {_END}
WHEN regexp_matches({_STEM}, '^[0-9]{{4}}-[0-9]{{2}}(-[0-9]{{2}})?$') THEN '{{date}}' || {_END}
WHEN regexp_matches({_STEM}, '^[0-9a-fA-F-]{{8,}}$') AND regexp_matches({_STEM}, '[0-9]') THEN '{{hex}}' || {_END}
WHEN regexp_matches({_STEM}, '[0-9]') THEN '{{mixed}}' || {_END} ELSE s END"""


def _level(d: int) -> str:
    """Tree level d of the URL templates from level d - 1."""
    return f""",
child{d} AS (SELECT *, segments[{d + 1}] AS child FROM tree{d}),
taken{d} AS (SELECT host, template, child, sum(n) AS taken FROM child{d} WHERE child IS NOT NULL GROUP BY ALL),
parent{d} AS (SELECT host, template, sum(taken) AS every, count(*) AS children FROM taken{d} GROUP BY ALL),
tree{d + 1} AS (
  SELECT c.key, c.host, c.segments, c.n, c.bad, c.good,
    CASE WHEN c.child IS NULL THEN c.template WHEN p.children > 24 AND t.taken < p.every * 0.02 THEN list_append(c.template, '*') ELSE list_append(c.template, c.child) END AS template
  FROM child{d} c LEFT JOIN taken{d} t USING (host, template, child) LEFT JOIN parent{d} p USING (host, template)
)"""


SQL: dict[str, str] = {
    "op2_url_filter": f"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT r, page_id, translate(regexp_extract(coalesce(rest, ''), '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u
),
j AS (SELECT *, CASE {_FITS} END AS rule, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {_SHAPE}) AS segments FROM h),
k AS (
  SELECT *, host || '/' || array_to_string(segments, '/') AS key, coalesce(rule IN ('net/', 'example.com/de/'), FALSE) AS bad, coalesce(rule IN ('example.net/en/', 'org/fr/'), FALSE) AS good FROM j
),
tree0 AS (SELECT key, host, segments, count(*) AS n, count(*) FILTER (bad) AS bad, count(*) FILTER (good) AS good, CAST([] AS VARCHAR[]) AS template FROM k GROUP BY key, host, segments)"""
    + "".join(_level(d) for d in range(4))
    + """,
tree AS (SELECT key, host, n, bad, good, CASE WHEN len(segments) > 4 THEN list_append(template, '**') ELSE template END AS template FROM tree4),
t AS (SELECT *, coalesce(template[1], '') AS top, array_to_string(template[2:], '/') AS below FROM tree),
shapes AS (SELECT host, top, below, sum(n) AS n, sum(bad) AS bad, sum(good) AS good FROM t GROUP BY ALL),
tops AS (SELECT host, top, arg_max(below, (n, below)) AS most, max(n) AS most_n, sum(n) AS n, sum(bad) AS bad, sum(bad) + sum(good) AS labelled FROM shapes GROUP BY ALL),
w AS (
  SELECT *, bad / greatest(labelled, 1) + 1.96 * 1.96 / (2 * greatest(labelled, 1)) AS middle,
    1.96 * sqrt(bad / greatest(labelled, 1) * (1 - bad / greatest(labelled, 1)) / greatest(labelled, 1) + 1.96 * 1.96 / (4 * greatest(labelled, 1) ** 2)) AS half,
    1 + 1.96 * 1.96 / greatest(labelled, 1) AS scale FROM tops
),
b AS (
  SELECT host, top, concat_ws(' ', '~', CASE WHEN labelled = 0 THEN 'open' WHEN (middle - half) / scale > 0.5 THEN 'bad' WHEN (middle + half) / scale < 0.5 THEN 'good' ELSE 'open' END,
    CASE WHEN labelled = 0 THEN 'unlabelled' ELSE 'labelled' END, CAST(CAST(round(most_n / n * 4) AS INT) AS VARCHAR), most) AS branch FROM w
),
m AS (SELECT t.*, branch FROM t JOIN b USING (host, top)),
pooled AS (SELECT host, branch, below, sum(bad) AS bad, sum(good) AS good FROM m GROUP BY ALL),
v AS (
  SELECT m.key, '/' || array_to_string(m.template, '/') AS template, CAST((p.bad + 1.0::DOUBLE) / (p.bad + p.good + 4.0::DOUBLE) AS DOUBLE) AS purity
  FROM m JOIN pooled p USING (host, branch, below)
)
SELECT page_id, host, path, rule, CASE WHEN bad THEN 'block' WHEN good THEN 'allow' WHEN purity > 0.5 THEN 'block' ELSE 'allow' END AS verdict, template, purity FROM k JOIN v USING (key)
""",
    "op9_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT k FROM windows),
runs AS (
  SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)
),
hits AS (SELECT r, i, k, item_id FROM runs JOIN windows USING (k, g)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
""",
    "op11_importance_resampling": f"""
WITH bits AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)
),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT r, unnest(w) AS word FROM d),
bw AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
spelt AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)),
digits AS (SELECT word, list_transform(range(1, length(h), 2), lambda k: CAST(16 * (strpos('0123456789ABCDEF', substring(h, k, 1)) - 1) + strpos('0123456789ABCDEF', substring(h, k + 1, 1)) - 1 AS BIGINT)) AS bytes FROM spelt),
crcs AS (SELECT word, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295) % 10000 AS bucket FROM digits, bits),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN crcs USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN crcs USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM dw) AS all_s, (SELECT count(*) FROM bw) AS all_t),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (all_s + 10000.0::DOUBLE) / ((coalesce(s, 0) + 1.0::DOUBLE) * (all_t + 10000.0::DOUBLE)))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket), sums
),
weights AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN crcs USING (word) JOIN gains USING (bucket) GROUP BY r),
noise AS (
  SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features,
    list_reduce(list_transform(range(1, 9), lambda k: CAST(strpos('0123456789abcdef', substring(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), k, 1)) - 1 AS BIGINT)), lambda a, b: 16 * a + b) AS h FROM d
),
scored AS (
  SELECT doc_id, n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM noise LEFT JOIN weights USING (r)
),
places AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM places
""",
    "op13_hard_negatives": """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INT) AS rank, s.b AS negative_id,
  p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3
""",
}
