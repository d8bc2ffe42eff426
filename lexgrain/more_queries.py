"""Queries over services, ingestion and whole answers, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import ports
from .functions import fulltext
from .operators import documents, evaluation, graph, kept_ranks, metadata, retrieval
from .plans.lineage import scratch, shared_dir, stored
from .plans.sizes import broadcast_if_small
from .queries import (
    SQL_ARMS,
    SQL_COS,
    SQL_EDGES,
    SQL_GRAPH,
    SQL_HITS_20,
    SQL_MERGED,
    SQL_POOL,
    SQL_VECTOR,
    arms,
    corpus,
    docs,
    injected,
    label_gold,
    merged,
    query,
    questions,
    r6,
    retrieved,
)
from .sources import readers, writers
from .sources.readers import table
from .streaming import stateful
from .streaming.incremental import windowed_counts

# ---- retrieval from end to end -------------------------------------------------------------------------------------


@query(f"""WITH c AS (SELECT * FROM embeddings WHERE label % 3 IN (1, 2)), s AS (SELECT b.vec_id AS qid, a.vec_id AS id, {SQL_COS} AS raw FROM c a, embeddings b WHERE b.vec_id % 50 = 0)
SELECT qid, id, score, rank FROM (SELECT qid, id, round(raw, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, id) AS rank FROM s) WHERE rank <= 10""")
def vector_topk_sections(spark: SparkSession, d: str) -> DataFrame:
    """Only paragraphs of the grounds and the operative part answer; labels stand in for sections."""
    section = F.element_at(F.array(*map(F.lit, ("summary", "grounds", "operative"))), (F.pmod("label", F.lit(3)) + 1).cast("int"))
    own = corpus(spark, d).withColumn("section", section).where(retrieval.facet(equal={"section": ["grounds", "operative"]}))
    return retrieval.vector_arm(own, questions(spark, d), 10).select("qid", "id", r6("score").alias("score"), "rank")


WEB_QUERIES = (["with", "from"], ["the", "of"])


def web_arms(spark: SparkSession, d: str) -> DataFrame:
    """Vector arm, and a keyword arm by web query and cover density; two word pairs are dealt to the questions in turn."""
    asked = questions(spark, d)
    vector = retrieval.vector_arm(corpus(spark, d), asked).withColumn("score", r6("score"))
    post = fulltext.postings(docs(spark, d), "doc_id", "text")
    scored = None
    for turn, words in enumerate(WEB_QUERIES):
        hits = docs(spark, d).where(fulltext.matches(" ".join(words), fulltext.tokens(F.col("text")))).select("doc_id")
        one = fulltext.cover_density(post.join(hits, "doc_id", "left_semi"), "doc_id", words).select(F.lit(turn).alias("qid"), F.col("doc_id").alias("id"), r6("rank").alias("score"))
        scored = one if scored is None else scored.unionByName(one)
    turn = broadcast_if_small(asked.select(F.col("qid").alias("asked"), F.expr("cast(qid div 50 % 2 as int)").alias("qid")))
    keyword = retrieval.keyword_arm(scored).join(turn, "qid").select(F.col("asked").alias("qid"), "id", "score", "rank")
    return retrieval.merge_arms(vector, keyword)


@query(f"""WITH {SQL_VECTOR}, t AS (SELECT doc_id, unnest(ts) AS lexeme, generate_subscripts(ts, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS ts FROM documents)),
pairs(turn, lexeme) AS (VALUES (0, 'with'), (0, 'from'), (1, 'the'), (1, 'of')),
o AS (SELECT turn, doc_id, lexeme, lag(lexeme) OVER w AS before, pos - lag(pos) OVER w AS gap FROM t JOIN pairs USING (lexeme) WINDOW w AS (PARTITION BY turn, doc_id ORDER BY pos)),
kw AS (SELECT turn, doc_id AS id, round(sum(0.1 / gap), 6) AS score FROM o WHERE before <> lexeme GROUP BY 1, 2),
kq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY score DESC, id) AS rank FROM kw) WHERE rank <= 40),
k AS (SELECT b.vec_id AS qid, kq.id, kq.score, kq.rank FROM kq JOIN embeddings b ON b.vec_id % 50 = 0 AND b.vec_id // 50 % 2 = kq.turn),
{SQL_MERGED[len(SQL_ARMS) + 2 :]} SELECT qid, id, source, vector_rank, keyword_rank, round(rrf, 6) AS hybrid_score, pool_rank FROM f WHERE pool_rank <= 8""")
def hybrid_web_query(spark: SparkSession, d: str) -> DataFrame:
    fused = retrieval.fuse_rrf(web_arms(spark, d), pool=8)
    return fused.select("qid", "id", "source", "vector_rank", "keyword_rank", r6("hybrid_score").alias("hybrid_score"), "pool_rank")


@query(f"""WITH {SQL_MERGED}, r AS (SELECT f.qid, f.id, f.pool_rank, f.rrf, coalesce(l.quality, 0) AS score FROM f LEFT JOIN labels l ON l.doc_id = f.id)
SELECT qid, id, pool_rank, CAST(score AS DOUBLE) AS rerank_score, final_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rrf DESC, pool_rank) AS final_rank FROM r) WHERE final_rank <= 8""")
def rerank_without_authority(spark: SparkSession, d: str) -> DataFrame:
    pool, scores, _ = injected(spark, d)
    return retrieval.rerank(pool, scores).select("qid", "id", "pool_rank", "rerank_score", "final_rank")


@query(f"""WITH {SQL_MERGED} SELECT qid, to_json(list({{'id': pool_rank, 'celex': 'c' || f.id, 'retrieval_source': f.source, 'hybrid_score': printf('%.4f', rrf), 'text': substr(d.text, 1, 2000)}} ORDER BY pool_rank)) AS candidates
FROM f JOIN documents d ON d.doc_id = f.id GROUP BY qid""")
def rerank_candidates_json(spark: SparkSession, d: str) -> DataFrame:
    pool = retrieval.fuse_rrf(arms(spark, d)).join(docs(spark, d).select(F.col("doc_id").alias("id"), "text"), "id")
    own = pool.withColumns({"celex": F.concat(F.lit("c"), F.col("id").cast("string")), "retrieval_source": F.col("source"), "hybrid_score": F.format_string("%.4f", "hybrid_score")})
    return retrieval.candidates_json(own, "celex", "retrieval_source", "hybrid_score")


ANSWER = "Answer from these sources alone, or say that they do not suffice. Name the decision and paragraph of every statement.\n\nConversation:\n{conversation}\n\nQuestion: {question}\n\nSources:\n{sources}\n"
SQL_LAST = """SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY k DESC) AS context FROM
(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS k FROM conversations) WHERE k <= 10 GROUP BY conv_id"""


@query(f"""WITH {SQL_MERGED}, c AS (SELECT qid, string_agg('[' || pool_rank || ']' || chr(10) || 'id: ' || id || chr(10) || 'text: ' || d.text, chr(10) || chr(10) ORDER BY pool_rank) AS context FROM f JOIN documents d ON d.doc_id = f.id WHERE pool_rank <= 8 GROUP BY qid),
w AS ({SQL_LAST}), q AS (SELECT vec_id AS qid, 'Question ' || vec_id AS question FROM embeddings WHERE vec_id % 50 = 0)
SELECT q.qid, md5('{ANSWER.partition("{conversation}")[0]}' || coalesce(w.context, '') || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || 'Sources:' || chr(10) || coalesce(c.context, '') || chr(10)) AS prompt_md5
FROM q LEFT JOIN c ON c.qid = q.qid LEFT JOIN w ON w.conv_id = q.qid""")
def answer_prompt(spark: SparkSession, d: str) -> DataFrame:
    """The prompts of all questions, whole; compared by a digest."""
    top = retrieval.fuse_rrf(arms(spark, d), pool=8).join(docs(spark, d).select(F.col("doc_id").alias("id"), "text"), "id")
    context = retrieval.context_blocks(top, ("id", "id"), ("text", "text"), rank="pool_rank")
    talk = retrieval.last_messages(table(spark, d, "conversations"), 10).select(F.col("conv_id").alias("qid"), F.col("context").alias("conversation"))
    asked = questions(spark, d).select("qid", F.concat(F.lit("Question "), F.col("qid").cast("string")).alias("question")).join(talk, "qid", "left")
    return retrieval.answer_prompt(context, asked, ANSWER).select("qid", F.md5("prompt").alias("prompt_md5"))


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS k FROM conversations WHERE role = 'user'),
q AS (SELECT conv_id, turn, text AS question FROM m WHERE k = 1),
b AS (SELECT c.conv_id, c.role || ': ' || c.text AS line, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn DESC, c.role, c.text) AS k FROM conversations c JOIN q USING (conv_id) WHERE c.turn < q.turn)
SELECT q.conv_id, md5(trim(CASE WHEN line IS NULL THEN '' ELSE regexp_extract(line, '[^\\n]*$') || ' | ' END || question)) AS question_md5 FROM q LEFT JOIN b ON b.conv_id = q.conv_id AND b.k = 1""")
def rewrite_questions(spark: SparkSession, d: str) -> DataFrame:
    """The last question of every conversation with what was said before it, through a stand-in for the rewriting service."""
    talk = table(spark, d, "conversations")
    asked = retrieval.ranked(talk.where("role = 'user'"), "conv_id", F.col("turn").desc(), F.col("role"), F.col("text"), name="_k", top=1).select("conv_id", F.col("turn").alias("_turn"), F.col("text").alias("question"))
    before = talk.join(asked.select("conv_id", "_turn"), "conv_id").where(F.col("turn") < F.col("_turn"))
    context = retrieval.last_messages(before.select("conv_id", "turn", "role", "text"), 10)
    out = ports.rewrite(asked.join(context, "conv_id", "left"), ports.LastLineRewriter())
    return out.select("conv_id", F.md5("question").alias("question_md5"))


@query("""SELECT vec_id - vec_id % 150 AS question, 'variant ' || vec_id AS variant FROM embeddings WHERE vec_id % 50 = 0 AND vec_id % 150 <> 0
UNION ALL SELECT q.vec_id, 'question ' || q.vec_id FROM embeddings q WHERE q.vec_id % 150 = 0 AND NOT EXISTS (SELECT 1 FROM embeddings v WHERE v.vec_id % 50 = 0 AND v.vec_id > q.vec_id AND v.vec_id < q.vec_id + 150)""")
def expand_questions(spark: SparkSession, d: str) -> DataFrame:
    """Variants of the questions; a question without any stands for itself."""
    q = questions(spark, d).select("qid")
    own = q.where("qid % 150 = 0").select("qid", F.concat(F.lit("question "), F.col("qid").cast("string")).alias("text"))
    variants = q.where("qid % 150 != 0").select(F.expr("qid - qid % 150").alias("question"), F.concat(F.lit("variant "), F.col("qid").cast("string")).alias("variant"))
    return ports.expand(own, variants)


@query(f"""WITH {SQL_HITS_20}, g AS (SELECT qid, case_id FROM gold WHERE qid % 150 = 0),
multi AS (SELECT qid // 150 * 150 AS qid, paragraph, round(sum(1.0 / (60.0 + rank)), 12) AS s FROM ret GROUP BY 1, 2),
mr AS (SELECT qid, paragraph // 3 AS case_id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, paragraph) AS rank FROM multi),
mk AS (SELECT qid, case_id, row_number() OVER (PARTITION BY qid ORDER BY min(rank), case_id) AS rank FROM mr WHERE rank <= 50 GROUP BY 1, 2),
a AS (SELECT g.qid, count(*) FILTER (WHERE rank <= 10) / count(*) AS r FROM g LEFT JOIN rk ON rk.qid = g.qid AND rk.case_id = g.case_id GROUP BY 1),
b AS (SELECT g.qid, count(*) FILTER (WHERE rank <= 10) / count(*) AS r FROM g LEFT JOIN mk ON mk.qid = g.qid AND mk.case_id = g.case_id GROUP BY 1)
SELECT a.qid, round(a.r, 6) AS old, round(b.r, 6) AS new, CASE WHEN b.r > a.r THEN 'improved' WHEN b.r < a.r THEN 'REGRESSED' ELSE '' END AS flag FROM a JOIN b USING (qid)""")
def eval_multi_query(spark: SparkSession, d: str) -> DataFrame:
    """Case recall of a question alone against it and its variants fused; three questions in turn are variants of the first."""
    hits = stored(retrieved(spark, d), "hits")
    gold = label_gold(spark, d).where("qid % 150 = 0").select("qid", "case_id").distinct()
    base = evaluation.score_cases(evaluation.case_ranking(hits.where("qid % 150 = 0")), gold)
    variant = broadcast_if_small(questions(spark, d).select("qid", F.expr("qid div 150 * 150").alias("question")))
    fused = retrieval.fuse_queries(hits.select("qid", F.col("paragraph").alias("id"), retrieval.reciprocal("rank").alias("hybrid_score")), variant)
    several = fused.select(F.col("question").alias("qid"), F.floor(F.col("id") / 3).alias("case_id"), F.col("pool_rank").alias("rank"))
    out = evaluation.compare(base, evaluation.score_cases(evaluation.case_ranking(several), gold), "recall", ("improved", "REGRESSED", ""))
    return out.select("qid", r6("old").alias("old"), r6("new").alias("new"), "flag")


@query(f"""WITH {SQL_EDGES}, {SQL_POOL}, deg AS (SELECT dst AS id, count(*) AS in_degree FROM edges GROUP BY 1),
c AS (SELECT e.dst AS id, deg.in_degree, count(DISTINCT e.src) AS support FROM edges e JOIN deg ON deg.id = e.dst WHERE e.src IN (SELECT id FROM pool) AND e.dst NOT IN (SELECT id FROM pool) GROUP BY 1, 2 HAVING count(DISTINCT e.src) >= 2),
t AS (SELECT id FROM (SELECT id FROM c ORDER BY support DESC, in_degree DESC NULLS LAST, id LIMIT 5) UNION SELECT id FROM pool)
SELECT dst AS id, count(*) AS n FROM edges WHERE dominant_relation_type = 'R' AND dst IN (SELECT id FROM t) GROUP BY 1""")
def later_treatment_of_foundations(spark: SparkSession, d: str) -> DataFrame:
    """Later treatment of the decisions shown and of what they rest on, together."""
    e = merged(spark, d)
    pool = table(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("id"))
    return graph.later_treatment(graph.treatment_targets(pool, graph.foundational(pool, e, graph.degrees(e))), e, "R")


# ---- fetching and parsing ------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, 'm' || lpad(CAST(min(l_suppkey) AS VARCHAR), 6, '0') || '/DOC_1' AS url FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def manifestation_urls(spark: SparkSession, d: str) -> DataFrame:
    """Orders stand in for works, their lines for manifestations of several kinds."""
    place = F.concat(F.lit("m"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0"))
    rows = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", "fmx4").otherwise("xhtml").alias("kind"), place.alias("place"))
    return metadata.manifestation(rows, "l_orderkey", "kind", "place")


@query("SELECT 's' || s_nationkey AS entity, min(s_name) AS title FROM supplier GROUP BY 1")
def first_titles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("entity"), F.col("s_name").alias("title"))
    return metadata.first_value(rows, "entity", "title")


class NumberedFetcher:
    """A stand-in for the publisher: keys divisible by 3 have no XHTML, by 7 an empty one, by 5 no HTML."""

    def get(self, key: str, accept: str) -> tuple[int, str]:
        n, xhtml = int(key), accept == ports.ACCEPT[0]
        status = (404 if n % 3 == 0 else 200) if xhtml else (406 if n % 5 == 0 else 200)
        return status, "" if xhtml and n % 7 == 0 else f"{'xhtml' if xhtml else 'html'} of {key}"


@query("SELECT page_id, CASE WHEN page_id % 3 <> 0 AND page_id % 7 <> 0 THEN 'xhtml of ' || page_id WHEN page_id % 5 <> 0 THEN 'html of ' || page_id ELSE '' END AS content FROM pages")
def fetch_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    return ports.fetch(table(spark, d, "pages"), NumberedFetcher(), "page_id")


SQL_FORMEX = """l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem),
h AS (SELECT l_orderkey, l_suppkey % 20 AS number, pos AS seq, 'html ' || l_partkey || CASE WHEN pos < count(*) OVER (PARTITION BY l_orderkey) THEN ' <a' ELSE '' END AS text FROM l WHERE l_orderkey % 4 <> 0),
falls AS (SELECT l_orderkey, bool_or(coalesce(number < b, false)) AS bad FROM (SELECT *, lag(number) OVER (PARTITION BY l_orderkey ORDER BY seq) AS b FROM h) GROUP BY 1),
x AS (SELECT l_orderkey, l_linenumber AS number, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS seq, 'formex ' || l_partkey AS text FROM l WHERE l_orderkey % 5 <> 0 AND l_returnflag <> 'R'),
pick AS (SELECT DISTINCT l_orderkey FROM x WHERE l_orderkey NOT IN (SELECT l_orderkey FROM falls WHERE NOT bad))"""


@query(f"""WITH {SQL_FORMEX} SELECT l_orderkey, number, 'grounds' AS section, seq, text FROM h WHERE l_orderkey NOT IN (SELECT l_orderkey FROM pick)
UNION ALL SELECT l_orderkey, number, 'grounds', seq, text FROM x WHERE l_orderkey IN (SELECT l_orderkey FROM pick)""")
def formex_choice(spark: SparkSession, d: str) -> DataFrame:
    """Orders as decisions: pages with point anchors, Formex with quotations, and the choice between their parses.

    A point's text ends where the next anchor's attribute begins, so the start of its tag stays.
    """
    one = lambda mark, c: F.struct("l_linenumber", "l_partkey", "l_suppkey", c.alias(mark))
    point = F.concat(F.lit('<a name="point'), F.pmod("l_suppkey", F.lit(20)).cast("string"), F.lit('"></a><p>html '), F.col("l_partkey").cast("string"), F.lit("</p>"))
    np = F.concat(F.lit("<NP><NO.P>"), F.col("l_linenumber").cast("string"), F.lit("</NO.P><TXT>formex <B>"), F.col("l_partkey").cast("string"), F.lit("</B></TXT></NP>"))
    quoted = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("<QUOT.S>"), np, F.lit("</QUOT.S>"))).otherwise(np)
    own = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one("h", point))).alias("hs"), F.array_sort(F.collect_list(one("x", quoted))).alias("xs"))
    page = F.when(F.col("l_orderkey") % 4 != 0, F.array_join(F.transform("hs", lambda x: x["h"]), ""))
    formex = F.when(F.col("l_orderkey") % 5 != 0, F.concat(F.lit("<J>"), F.array_join(F.transform("xs", lambda x: x["x"]), ""), F.lit("</J>"))).otherwise(F.lit("<J><NP>broken"))
    both = own.select("l_orderkey", page.alias("html"), formex.alias("xml"))
    return documents.choose(documents.parse_html(both, "l_orderkey"), documents.parse_formex(both, "l_orderkey"), "l_orderkey")


# ---- files and streams ---------------------------------------------------------------------------------------------


@query("""SELECT 'd' || doc_id AS celex, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS language, '' AS url, md5(text) AS text_md5, 0 AS n_paragraphs FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 7 <> 0
UNION ALL SELECT 'unknown', CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END, '', md5(text), 0 FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 7 = 0""")
def jsonl_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as JSON lines, some keys missing and some lines broken, and read again."""
    name = F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    line = F.to_json(F.struct(name.alias("celex"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("language"), "text"))
    path = f"{shared_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    docs(spark, d).select(F.when(F.col("doc_id") % 11 == 0, F.lit("{broken")).otherwise(line).alias("value")).write.text(path)
    return readers.jsonl(spark, path).select("celex", "language", "url", F.md5("text").alias("text_md5"), F.size("paragraphs").alias("n_paragraphs"))


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1")
def published_versions(spark: SparkSession, d: str) -> DataFrame:
    """A table published twice; readers see the last version."""
    path = f"{shared_dir(spark)}/published-{uuid.uuid4().hex}"
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    writers.publish(counts, path)
    writers.publish(readers.published(spark, path).where("event_type = 'view'").select("user_id", "n"), path)
    return readers.published(spark, path)


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts of the events as a stream that reads all files once; every result replaces the one before."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = stateful.files(spark, *_files(spark, d, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = windowed_counts(source, "ts", "event_type", "1 day", "365 days")
    put = lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/counts")
    counts.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/counts")


#: Files of a batch: each batch costs a round of every partition's state.
FILES = 64


def _files(spark: SparkSession, d: str, name: str) -> tuple[str, StructType, str]:
    """Folder, schema and pattern of the files of a table."""
    folder, pattern = readers.table_files(spark, d, name)
    return folder, table(spark, d, name).schema, pattern


def _source(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream, in batches of FILES files where it has more."""
    return stateful.files(spark, *_files(spark, d, name), FILES)


@query("SELECT click_id, min(client_id) AS client_id, min(arrived_at) AS arrived_at FROM clicks WHERE arrived_at IS NOT NULL GROUP BY click_id")
def stream_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """Clicks indexed once each by a stream that remembers keys for a while and never reads its target; run twice on one checkpoint."""
    base = scratch(spark, "stream")
    for _ in range(2):
        own = stateful.deduplicated(_source(spark, d, "clicks").select("click_id", "client_id", "arrived_at"), "arrived_at", "60 days", "click_id")
        stateful.append(own, f"{base}/index", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/index").withColumn("arrived_at", F.col("arrived_at").cast("timestamp_ntz"))


@query("""WITH f AS (SELECT sale_id, flag, shipped_at, row_number() OVER (PARTITION BY sale_id ORDER BY shipped_at DESC, flag) AS k, count(*) OVER (PARTITION BY sale_id) AS n FROM sales s JOIN sale_lines l USING (sale_id) WHERE l.shipped_at >= s.sold_at AND l.shipped_at <= s.sold_at + INTERVAL 30 DAY)
SELECT sale_id, flag AS feedback, n FROM f WHERE k = 1""")
def stream_log_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Sales as a log and the flags of their lines as feedback, joined as streams; then the latest feedback of each."""
    base = scratch(spark, "stream")
    log, feedback = _source(spark, d, "sales").select("sale_id", "sold_at"), _source(spark, d, "sale_lines").select("sale_id", "flag", "shipped_at")
    stateful.append(stateful.with_feedback(log, feedback, "sale_id", "sold_at", "shipped_at", "30 days", "60 days"), f"{base}/log", f"{base}/state").awaitTermination()
    latest = F.min(F.struct((-F.unix_micros("shipped_at")).alias("t"), "flag"))
    return spark.read.parquet(f"{base}/log").groupBy("sale_id").agg(latest["flag"].alias("feedback"), F.count("*").alias("n"))


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)")
def stream_closed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts of events, appended once each when their day is closed: all but the last days."""
    base = scratch(spark, "stream")
    stateful.append(stateful.closed_windows(_source(spark, d, "events").select("ts", "event_type"), "ts", "event_type", "1 day", "2 days"), f"{base}/counts", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/counts")


# ---- kept ranks ----------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {SQL_GRAPH}, s AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM w),
x AS (SELECT id, 0 AS t, 1.0::DOUBLE AS v FROM n UNION ALL SELECT id, max(t) + 1, sum(v) FROM
  (SELECT s.dst AS id, x.t, 0.85 * s.share * x.v AS v FROM x JOIN s ON s.src = x.id UNION ALL SELECT id, t, 1.0 FROM x) WHERE t < 200 GROUP BY id),
last AS (SELECT id, v FROM x WHERE t = 200) SELECT id, round(1000 * v / (SELECT sum(v) FROM last), 6) AS pagerank FROM last""")
def pagerank_refreshed(spark: SparkSession, d: str) -> DataFrame:
    """Ranks kept of the lines shipped until 30 days before the last one, refreshed by what the later lines change. The SQL ranks all lines afresh."""
    line = table(spark, d, "lineitem")
    last = line.agg(F.max("l_shipdate")).first()[0]
    early = line.where(F.col("l_shipdate") <= F.date_sub(F.lit(last), 30)) if last is not None else line
    before, after = (stored(graph.weighted(merged(spark, d, lines)), "graph") for lines in (early, line))
    kept = kept_ranks.refresh(kept_ranks.solve(before, tolerance=1e-11), kept_ranks.changes(before, after), tolerance=1e-11)
    return kept.ranks().select("id", r6(F.col("pagerank") * 1000).alias("pagerank"))
