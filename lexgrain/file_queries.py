"""Queries that go through files and arrays: imports, gold sets, caches, replaced tables, sections of pages, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import celex, text
from .operators import documents, evaluation, reports, retrieval
from .plans.lineage import scratch
from .plans.order import partitions
from .queries import SQL_EDGES, _plain, docs, edges, query
from .sources import readers, writers
from .sources.readers import table

# ---- imports and gold sets -----------------------------------------------------------------------------------------


@query(f"WITH {SQL_EDGES} SELECT 'c' || src AS citing_celex, 'c' || dst AS cited_celex, count(*) AS n FROM raw WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2")
def edge_list_import(spark: SparkSession, d: str) -> DataFrame:
    """A list of citations in a file with other columns: only the two ends are read."""
    path = f"{scratch(spark, 'import')}/edges"
    name = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
    edges(spark, d).select(name("src").alias("citing_celex"), name("dst").alias("cited_celex"), "source", "rel").write.parquet(path)
    return readers.edge_list(spark, path).groupBy("citing_celex", "cited_celex").agg(F.count("*").alias("n"))


SQL_GOLD = """g AS (SELECT 'q' || o_orderkey AS qid, o_orderstatus = 'P' AS gap, 'c' || l_partkey AS case_id, l_linenumber, l_suppkey % 9 AS other FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)"""


@query(f"""WITH {SQL_GOLD} SELECT 'case' AS kind, qid, case_id, CAST(NULL AS INTEGER) AS paragraph FROM g WHERE case_id IS NOT NULL
UNION ALL SELECT 'paragraph', qid, case_id, CAST(unnest([l_linenumber, other]) AS INTEGER) FROM g WHERE case_id IS NOT NULL
UNION ALL SELECT DISTINCT 'gap', qid, CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER) FROM g WHERE gap""")
def gold_from_files(spark: SparkSession, d: str) -> DataFrame:
    """Gold sets as JSON arrays in files of some entries each, read and taken apart: cases, paragraphs, and questions the corpus cannot answer."""
    path = f"{scratch(spark, 'gold')}/sets"
    line = table(spark, d, "lineitem").select("l_orderkey", F.struct(F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("celex"), F.lit("A v B").alias("name"), F.array(F.col("l_linenumber").cast("int"), (F.col("l_suppkey") % 9).cast("int")).alias("paragraphs")).alias("e"))
    expected = line.groupBy("l_orderkey").agg(F.collect_list("e").alias("expected"))
    o = table(spark, d, "orders").join(expected, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    entry = F.struct(F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("Which?").alias("question"), F.coalesce("expected", F.array().cast("array<struct<celex:string,name:string,paragraphs:array<int>>>")).alias("expected"), F.when(F.col("o_orderstatus") == "P", True).alias("corpus_gap"))
    some = o.groupBy(F.expr("o_orderkey div 500").alias("file")).agg(F.to_json(F.collect_list(entry)).alias("value"))  # 500 entries a file
    some.write.partitionBy("file").text(path)
    cases, paragraphs, gaps = evaluation.explode_gold(readers.gold(spark, path))
    parts = [cases.select(F.lit("case").alias("kind"), "qid", "case_id"), paragraphs.select(F.lit("paragraph").alias("kind"), "qid", "case_id", "paragraph"), gaps.select(F.lit("gap").alias("kind"), "qid")]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


@query("""SELECT page_id AS key, CASE WHEN page_id % 7 IN (0, 1) AND page_id % 5 <> 0 THEN 'second' WHEN page_id % 7 IN (0, 1) THEN 'none' ELSE 'first' END AS found,
page_id % 7 = 0 AND page_id % 5 = 0 AS pending FROM pages""")
def cache_prefer_pending(spark: SparkSession, d: str) -> DataFrame:
    """Pages of two caches: some are missing in the first or known to be empty there, some are missing in the second; what neither has seen is pending."""
    own = table(spark, d, "pages").select(F.col("page_id").alias("key"))
    one = own.where("key % 7 != 0").select("key", F.when(F.col("key") % 7 == 1, "").otherwise("first").alias("content"))
    two = own.where("key % 5 != 0").select("key", F.lit("second").alias("content"))
    pending = readers.pending(own, one.select("key").unionByName(two.select("key"))).withColumn("pending", F.lit(True))
    both = own.join(readers.prefer(one, two), "key", "left").join(pending, "key", "left")
    return both.select("key", F.coalesce(F.nullif("content", F.lit("")), F.lit("none")).alias("found"), F.coalesce("pending", F.lit(False)).alias("pending"))


# ---- written tables ------------------------------------------------------------------------------------------------


@query("""SELECT event_type, user_id, CASE WHEN event_type = 'view' THEN 2 * count(*) ELSE count(*) END AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2""")
def replaced_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Counts by kind as a table, of which one kind is replaced afterwards; the others stay as they were written."""
    path = f"{scratch(spark, 'replaced')}/counts"
    counts = table(spark, d, "events").where("event_type IS NOT NULL").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    writers.replace_partitions(counts, path, "event_type")
    writers.replace_partitions(counts.where("event_type = 'view'").withColumn("n", F.col("n") * 2), path, "event_type")
    return spark.read.parquet(path).select("event_type", "user_id", "n")


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 2 = 0")
def appended_rows(spark: SparkSession, d: str) -> DataFrame:
    """A table appended to three times; rows whose key is there already are left out, and the last time adds none."""
    path = f"{scratch(spark, 'appended')}/rows"
    own = docs(spark, d).select("doc_id", "lang")
    for part in ("doc_id % 3 = 0", "doc_id % 2 = 0", "doc_id % 6 = 0"):
        writers.append_new(own.where(part), path, "doc_id")
    return spark.read.parquet(path)


def by_bucket(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Mentions by what they cite, and parts as decisions, in buckets of the same keys."""
    path = scratch(spark, "bucketed")
    name = f"lexgrain_{path.rpartition('-')[2]}"
    own = edges(spark, d).select(F.col("dst").alias("celex"), "src", "source")
    mentions = writers.bucketed(own, f"{name}_mentions", f"{path}/mentions", partitions(spark), "celex")
    decisions = writers.bucketed(table(spark, d, "part").select(F.col("p_partkey").alias("celex"), "p_brand"), f"{name}_decisions", f"{path}/decisions", partitions(spark), "celex")
    return mentions, decisions


@query(f"WITH {SQL_EDGES} SELECT p_partkey AS celex, p_brand, count(*) AS mentions, count(*) FILTER (WHERE source = 'text') AS from_text FROM raw JOIN part ON p_partkey = dst WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2")
def bucketed_join(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of each decision: joined and grouped where the buckets lie."""
    mentions, decisions = by_bucket(spark, d)
    both = mentions.join(decisions.hint("merge"), "celex")
    return both.groupBy("celex", "p_brand").agg(F.count("*").alias("mentions"), F.count_if(F.col("source") == "text").alias("from_text"))


@query("SELECT lang, count(*) AS n_rows, true AS near_texts, true AS near_sizes FROM documents GROUP BY lang")
def sketched_report(spark: SparkSession, d: str) -> DataFrame:
    """Distinct texts and lengths by language from sketches that were kept per source in two parts, held against exact counts: within 4 %."""
    path, own = f"{scratch(spark, 'sketches')}/kept", docs(spark, d).withColumn("size", F.length("text"))
    for part in ("doc_id % 2 = 0", "doc_id % 2 <> 0 OR doc_id IS NULL"):
        reports.sketches(own.where(part), ["lang", "source"], "text", "size").write.mode("append").parquet(path)
    near = reports.merged_sketches(spark.read.parquet(path), ["lang"], "text", "size")
    exact = own.groupBy("lang").agg(F.countDistinct("text").alias("texts"), F.countDistinct("size").alias("sizes"))
    both = near.join(exact.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")))
    within = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(0.04 * F.col(b), F.lit(1.0))
    return both.select("lang", "n_rows", within("text", "texts").alias("near_texts"), within("size", "sizes").alias("near_sizes"))


# ---- arrays and suffixes -------------------------------------------------------------------------------------------


@query("""WITH u AS (SELECT user_id, list(DISTINCT event_type) AS kinds, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1)
SELECT user_id, n FROM u WHERE list_has_any(kinds, ['error', 'purchase']) AND n BETWEEN 3 AND 1000000""")
def facet_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Users with any of two kinds of events: a facet on an array, with one on a range; an empty facet does nothing."""
    own = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"), F.count("event_type").alias("n")).where("size(kinds) > 0")
    condition = retrieval.facet(overlap={"kinds": ["error", "purchase"], "user_id": []}, between={"n": (3, 1_000_000)})
    return own.where(condition).select("user_id", "n")


@query("""SELECT o_orderkey, '62000CJ' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') || CASE o_orderkey % 5 WHEN 1 THEN '_SUM' WHEN 2 THEN '_RES' WHEN 3 THEN '_INF' ELSE '' END AS celex FROM orders WHERE o_orderkey % 5 IN (0, 4)""")
def judgment_texts(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of judgments alone: summaries, abstracts and notes go by their suffix."""
    suffix = F.element_at(F.array(*map(F.lit, ("", "_SUM", "_RES", "_INF", ""))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    own = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("62000CJ"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0"), suffix).alias("celex"))
    return own.where(celex.is_judgment_text(F.col("celex")))


@query(r"""WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, len(ps) AS n, unnest(ps) AS raw, generate_subscripts(ps, 1) - 1 AS i FROM a),
t AS (SELECT doc_id, n, i, substr(regexp_replace(raw, '^[ \t\r\f\v]+|[ \t\r\f\v]+$', '', 'g'), 1, 6000) AS text FROM e)
SELECT 'd' || doc_id || '_p_' || i AS id, CAST(CASE WHEN i < n // 2 THEN CASE WHEN i % 4 = 3 THEN NULL ELSE 10 * i END ELSE i + 1 END AS INTEGER) AS paragraph_number, md5(text) AS text_md5 FROM t WHERE length(text) >= 80""")
def paired_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the documents paired with numbers that stop half way and have gaps."""
    own = docs(spark, d).where("text IS NOT NULL").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("celex"), F.split("text", "\n").alias("paragraphs"))
    half = F.expr("int(size(paragraphs) div 2)")
    nums = F.when(half > 0, F.transform(F.sequence(F.lit(0), half - 1), lambda i: F.when(i % 4 != 3, 10 * i).cast("int"))).otherwise(F.array().cast("array<int>"))
    return text.paragraphs(own.withColumn("paragraph_nums", nums)).select("id", "paragraph_number", F.md5("text").alias("text_md5"))


# ---- sections of pages ---------------------------------------------------------------------------------------------

ENDING = "The action is dismissed, and the applicant is ordered to pay the costs."
#: Markers before the summary, the grounds and the operative part: named anchors, headings and classes, none.
MARKS = (
    ('<a name="SM"></a>', '<a name="mo"></a>', '<a name="CO"></a>'),
    ("<h2> Summary </h2>", "<h2>Grounds</h2>", '<div class="C41DispositifIntroduction"></div>'),
    ("", "", ""),
)


def marked_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a summary before and an operative part behind their article, each third with another family of markers; the first
    family's pages have a heading of the second as well, which does not count beside anchors."""
    mark = lambda k: F.element_at(F.array(*[F.lit(m[k]) for m in MARKS]), (F.col("page_id") % 3 + 1).cast("int"))
    lead = F.concat(mark(0), F.lit("<p>A summary of what was decided, in as many words as it takes.</p>"), mark(1), F.when(F.col("page_id") % 3 == 0, "<h2>Operative part</h2>").otherwise(""))
    tail = F.concat(F.lit("</p>"), mark(2), F.lit(f"<p>{ENDING}</p>"))
    page = F.split("html", "</h1>", 2)
    head, body = page[0], F.regexp_replace(F.coalesce(F.try_element_at(page, F.lit(2)), F.lit("")), "(?s)</article>.*", "")
    return table(spark, d, "pages").where("html LIKE '%</h1>%'").select("page_id", F.concat(head, F.lit("</h1>"), lead, body, tail).alias("html"))


SQL_MARKED = f"""pg AS (SELECT page_id, regexp_replace(substr(html, strpos(html, '</h1>') + 5), '(?s)</article>.*', '') || '</p>' AS body, left(html, strpos(html, '</h1>') - 1) AS head FROM pages WHERE html LIKE '%</h1>%'),
seg AS (SELECT page_id, 0 AS part, head || '</h1>' AS x FROM pg UNION ALL SELECT page_id, 1, '<p>A summary of what was decided, in as many words as it takes.</p>' FROM pg UNION ALL SELECT page_id, 2, body FROM pg UNION ALL SELECT page_id, 3, '<p>{ENDING}</p>' FROM pg),
named AS (SELECT *, CASE WHEN page_id % 3 = 2 OR part = 2 THEN 'grounds' WHEN part = 3 THEN 'operative' ELSE 'summary' END AS section FROM seg),
pr AS (SELECT page_id, part, section, unnest(xs) AS raw, generate_subscripts(xs, 1) AS pos FROM (SELECT *, regexp_extract_all(x, '(?is)<p\\b[^>]*>(.*?)</p>', 1) AS xs FROM named)),
inl AS (SELECT page_id, part, section, unnest(xs) AS raw, generate_subscripts(xs, 1) AS pos FROM (SELECT *, regexp_extract_all(x, '(?s)<p[^>]*>\\s*\\d{{1,3}}\\s*\\.?\\s*[A-Z(].*?</p>') AS xs FROM named)),
pt AS (SELECT page_id, part, section, pos, {_plain("raw")} AS text FROM pr),
nt AS (SELECT page_id, part, section, pos, CAST(regexp_extract(raw, '^<p[^>]*>\\s*(\\d{{1,3}})', 1) AS INTEGER) AS number, {_plain("regexp_extract(raw, '(?s)^<p[^>]*>\\s*\\d{1,3}\\s*\\.?\\s*(.*)</p>$', 1)")} AS text FROM inl),
pk AS (SELECT *, row_number() OVER (PARTITION BY page_id, section ORDER BY part, pos) AS number FROM pt WHERE length(text) >= 40), nk AS (SELECT * FROM nt WHERE length(text) >= 20),
sizes AS (SELECT p.page_id, (SELECT count(*) FROM pk WHERE pk.page_id = p.page_id AND section = 'grounds') AS np, (SELECT count(*) FROM nk WHERE nk.page_id = p.page_id AND section = 'grounds') AS nn FROM pg p),
every AS (SELECT pk.page_id, number, section, part, pos, text FROM pk JOIN sizes s USING (page_id) WHERE np >= nn + 3 UNION ALL SELECT nk.page_id, number, section, part, pos, text FROM nk JOIN sizes s USING (page_id) WHERE np < nn + 3)"""


@query(f"WITH {SQL_MARKED} SELECT page_id, number, section, row_number() OVER (PARTITION BY page_id ORDER BY part, pos) AS seq, md5(text) AS text_md5 FROM every")
def sections_of_pages(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of pages with markers of each family, numbered per section, each in the section of the last marker before it."""
    return documents.parse_html(marked_pages(spark, d), "page_id", "html").select("page_id", "number", "section", "seq", F.md5("text").alias("text_md5"))


@query(f"WITH {SQL_MARKED} SELECT section, page_id % 3 AS family, count(*) AS n, count(DISTINCT page_id) AS pages FROM every GROUP BY 1, 2")
def section_counts(spark: SparkSession, d: str) -> DataFrame:
    """What each family of markers gives: paragraphs and pages by section."""
    found = documents.parse_html(marked_pages(spark, d), "page_id", "html")
    return found.groupBy("section", (F.col("page_id") % 3).alias("family")).agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))
