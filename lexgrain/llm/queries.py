"""The opN queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import stored
from . import byte_bpe, embedding_neardup, html_extract, importance, language_id, ngram_jaccard, packing, piece_codec, point_in_time, quality_rules, suffix_dedup
from .token_counts import Vocabulary, token_counts
from .url_filters import filter_urls

#: Fixed by the contract of op3: host, path, verdict.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_vocabulary() -> Vocabulary:
    import public_tokenizers as p

    return Vocabulary(p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_report(table(spark, sf_dir, "documents"), length=400)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), bpe_vocabulary(), limit=1024)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    return piece_codec.digest(table(spark, sf_dir, "documents"), piece_codec.PieceModel(p.path("piece_bpe_32k.model")))


def op6_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_neardup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    featured = stored(quality_rules.with_features(docs, carry=["doc_id"]).select("__row.doc_id", *quality_rules.COUNTS), "features")
    judged = quality_rules.judge(featured, quality_rules.fit(featured, labels))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that op7 judges by, without the learned verdict: these can be said in SQL."""
    judged = quality_rules.judge(quality_rules.with_features(table(spark, sf_dir, "documents"), carry=["doc_id"]), [])
    return judged.select("__row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.components(table(spark, sf_dir, "documents"))


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out()))
    return language_id.identify(docs, model).withColumn("held_out", held_out())


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), bpe_vocabulary())


def op11_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return point_in_time.feature_table(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sales"), table(spark, sf_dir, "sale_lines"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    return byte_bpe.digests(table(spark, sf_dir, "documents"), byte_bpe.RankFile(p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


OP3_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(rhost, rpath, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
             ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.verdict,
             row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
      FROM p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


OP6_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a, u b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9),
r(id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.y FROM r JOIN l ON l.x = r.other),
n AS (SELECT x, count(*) AS n FROM l GROUP BY 1)
SELECT r.id AS vec_id, coalesce(max(n.n), 0) AS n_links, min(r.other) AS component_id, r.id = min(r.other) AS kept FROM r LEFT JOIN n ON n.x = r.id GROUP BY r.id
"""
OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
r(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.y FROM r JOIN l ON l.x = r.other)
SELECT r.id AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.other) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY r.id
"""


#: CRC-32 in SQL: the table of the reversed polynomial, and a fold over the bytes ``b`` of a value.
SQL_CRC_TABLE = "crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, i)) AS tab)"
SQL_CRC = "xor(4294967295::BIGINT, list_reduce(b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295::BIGINT))"

#: Every probe joined to what it may count, before any grouping.
OP11_SQL = rf"""
WITH {SQL_CRC_TABLE},
s AS (SELECT sale_id, client_id, epoch_us(sold_at) AS sold, epoch_us(arrived_at) + 14400000000 AS known, CAST(floor(100 * coalesce(total, 0) + 0.5) AS BIGINT) AS cents, list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b
      FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
p AS (SELECT sale_id, client_id, sold + ({SQL_CRC} % 259200) * 1000000 AS t FROM s, crc),
pd AS (SELECT p.*, d, d * 86400000000 AS w FROM p, (VALUES (2), (14)) v(d)),
c AS (SELECT click_id, client_id, kind, epoch_us(ts) AS ts, epoch_us(arrived_at) + 14400000000 AS known, CAST(floor(100 * coalesce(value, 0) + 0.5) AS BIGINT) AS cents FROM (SELECT DISTINCT * FROM clicks)),
fc AS (SELECT pd.sale_id, d, count(*) AS n_clicks, count(*) FILTER (WHERE kind = 'purchase') AS n_purchases, sum(cents) AS click_cents, nullif(max({{'ts': ts, 'id': coalesce(click_id, -9223372036854775807 - 1)}}).id, -9223372036854775807 - 1) AS last_click_id
      FROM pd JOIN c ON c.client_id = pd.client_id AND c.ts > t - w AND c.ts <= t AND c.known <= t GROUP BY 1, 2),
fs AS (SELECT pd.sale_id, d, count(*) AS n_sales, sum(s.cents) AS sale_cents FROM pd JOIN s ON s.client_id = pd.client_id AND s.sold > t - w AND s.sold <= t AND s.known <= t GROUP BY 1, 2),
l AS (SELECT s.client_id, s.sold, s.known, item_id, epoch_us(shipped_at) AS shipped, CAST(floor(100 * coalesce(amount, 0) + 0.5) AS BIGINT) AS cents FROM sale_lines JOIN s USING (sale_id)),
fl AS (SELECT pd.sale_id, d, count(*) AS n_lines, count(DISTINCT item_id) AS n_items, sum(l.cents) AS line_cents FROM pd JOIN l ON l.client_id = pd.client_id AND l.sold > t - w AND l.sold <= t AND l.known <= t AND l.shipped <= t GROUP BY 1, 2),
y AS (SELECT DISTINCT p.sale_id FROM p JOIN s ON s.client_id = p.client_id AND s.sold > t AND s.sold <= t + 604800000000)
SELECT pd.sale_id, CAST(d AS INTEGER) AS d, t AS t_us, y.sale_id IS NOT NULL AS label, coalesce(n_clicks, 0) AS n_clicks, coalesce(n_purchases, 0) AS n_purchases, CAST(coalesce(click_cents, 0) AS BIGINT) AS click_cents, last_click_id,
  coalesce(n_sales, 0) AS n_sales, CAST(coalesce(sale_cents, 0) AS BIGINT) AS sale_cents, coalesce(n_lines, 0) AS n_lines, coalesce(n_items, 0) AS n_items, CAST(coalesce(line_cents, 0) AS BIGINT) AS line_cents
FROM pd LEFT JOIN fc USING (sale_id, d) LEFT JOIN fs USING (sale_id, d) LEFT JOIN fl USING (sale_id, d) LEFT JOIN y ON y.sale_id = pd.sale_id
"""

OP13_SQL = rf"""
WITH {SQL_CRC_TABLE},
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
words AS (SELECT DISTINCT unnest(ws) AS word FROM (SELECT ws FROM w UNION ALL SELECT ws FROM bw)),
bytes AS (SELECT word, list_transform(range(octet_length(encode(word))), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)) AS b FROM words),
bucket AS MATERIALIZED (SELECT word, {SQL_CRC} % 10000 AS k FROM bytes, crc),
dk AS (SELECT k, count(*) AS s FROM (SELECT unnest(ws) AS word FROM w) JOIN bucket USING (word) GROUP BY 1),
tk AS (SELECT k, count(*) AS t FROM (SELECT unnest(ws) AS word FROM bw) JOIN bucket USING (word) GROUP BY 1),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM dk)::DOUBLE AS s_all, (SELECT coalesce(sum(t), 0) FROM tk)::DOUBLE AS t_all),
gain AS (SELECT word, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)))) AS BIGINT) AS g FROM bucket LEFT JOIN dk USING (k) LEFT JOIN tk USING (k), n),
d AS (SELECT row_number() OVER () AS r, doc_id, ws FROM w),
weight AS (SELECT r, sum(g) AS weight FROM (SELECT r, unnest(ws) AS word FROM d) JOIN gain USING (word) GROUP BY 1),
sc AS (SELECT r, doc_id, len(ws) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN weight USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM sc WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, k AS rank FROM sc LEFT JOIN (SELECT r, k FROM ranked WHERE k <= 10 * n // 100) USING (r)
"""


QUALITY_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY 1),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
c AS (SELECT w.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN again USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
"""


OPERATORS = (
    op1_suffix_array_dedup,
    op2_token_counts,
    op3_url_filters,
    op4_html_extraction,
    op5_sentencepiece,
    op6_embedding_neardup,
    op7_quality_rules,
    op8_ngram_jaccard,
    op9_language_id,
    op10_best_fit_packing,
    op11_point_in_time,
    op12_byte_bpe,
    op13_importance_resampling,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*OPERATORS, quality_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filters": OP3_SQL, "op6_embedding_neardup": OP6_SQL, "op8_ngram_jaccard": OP8_SQL, "op11_point_in_time": OP11_SQL, "op13_importance_resampling": OP13_SQL, "quality_counts": QUALITY_SQL}
