"""Schemas of the tables and inputs."""

from __future__ import annotations

DECISIONS = (
    "celex string, ecli string, cellar_uri string, case_number string, case_year int, doc_type string, decision_date date, procedure_type string, court_formation string, "
    "subject_matters array<string>, advocate_general string, judge_rapporteur string, country_origin string, procedure_language string, title string, parties array<string>, "
    "cites array<string>, interprets_legislation array<string>, source_fetch_status string, ingested_at timestamp"
)
PARAGRAPHS = "id string, celex string, paragraph_number int, section string, seq int, text string, embedding array<float>"
MENTIONS = (
    "citing_celex string, citing_paragraph_number int, cited_celex string, cited_paragraph_number int, relation_type string, signal_phrase string, raw_reference string, "
    "source string, confidence float, created_at timestamp"
)
EDGES = "citing_celex string, cited_celex string, mention_count int, dominant_relation_type string, from_text boolean, from_cellar boolean, updated_at timestamp"
METRICS = "celex string, in_degree int, out_degree int, pagerank double, authority double, hub double, community_id int, computed_at timestamp"
PARAGRAPH_META = "id string, base_celex string, doc_kind string"
JSONL = "celex string, url string, language string, text string, paragraphs array<string>, paragraph_nums array<int>"
GOLD = (
    "id string, question string, topic string, expected array<struct<celex:string,name:string,paragraphs:array<int>>>, gold_answer string, source string, notes string, corpus_gap boolean"
)
#: Columns that an upsert of a decision changes; identity and ingestion columns stay as first written.
DECISION_UPDATES = (
    "ecli decision_date procedure_type court_formation subject_matters advocate_general judge_rapporteur country_origin title parties cites interprets_legislation source_fetch_status"
).split()
