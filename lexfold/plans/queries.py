"""Queries over whole driver tables, one an operator or a small chain, with the SQL that DuckDB runs for each.

The driver tables hold no contracts, so their shapes are mapped: documents are
texts of lines, labels give clauses two parties' risks (see ``annotations``),
conversations are chats and embeddings are a knowledge base.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import prompts as P
from ..functions import text as X
from ..operators import chat, compare, curate, evaluate, pruned, reshape, retrieve, segment
from ..sources import readers, writers
from ..storage import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
RISKS = ("Low", "Medium", "High")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.lines_of(table(spark, sf_dir, "documents").select("doc_id", "text"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as annotations: Licensor by toxicity and length, Licensee by quality and language."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars"), table(spark, sf_dir, "labels")
    a = F.when(F.col("toxic") == 1, "High").when(F.col("n_chars") > 2000, "Medium").otherwise("Low")
    b = F.when(F.col("quality") == 0, "High").when(F.col("lang") == "de", "Medium").otherwise("Low")
    df = labels.join(docs, "doc_id").withColumn("__a", a).withColumn("__b", b)
    start = F.substring("text", 1, 30)
    why_a = F.when(F.col("lang") == "en", F.concat(F.lit("Risk is "), F.lower("__a"), F.lit(" here"))).otherwise(F.concat(F.lit("No label: "), start))
    party = lambda risk, why: F.struct(F.col(risk).alias("risk"), why.alias("explanation"), F.lit(None).cast("string").alias("trigger_quote"), F.lit(None).cast("string").alias("evidence_quote"))
    parties = F.create_map(F.lit("Licensor"), party("__a", why_a), F.lit("Licensee"), party("__b", F.concat(F.lit("Exposure of "), start)))
    status = F.when(F.col("lang") == "es", "json_error").when((F.col("lang") == "fr") & (F.col("quality") == 0), "api_error").otherwise("success")
    return df.select(F.col("doc_id").alias("clause_index"), F.col("text").alias("clause_text"), status.alias("status"), parties.alias("parties"), "lang", "quality", "toxic")


ANN = """WITH ann AS (SELECT d.doc_id AS clause_index, d.text AS clause_text, d.lang, l.quality, l.toxic,
 CASE WHEN d.lang = 'es' THEN 'json_error' WHEN d.lang = 'fr' AND l.quality = 0 THEN 'api_error' ELSE 'success' END AS status,
 CASE WHEN l.toxic = 1 THEN 'High' WHEN d.n_chars > 2000 THEN 'Medium' ELSE 'Low' END AS a,
 CASE WHEN l.quality = 0 THEN 'High' WHEN d.lang = 'de' THEN 'Medium' ELSE 'Low' END AS b
 FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
party AS (SELECT clause_index, clause_text, status, 'Licensor' AS party, a AS risk,
  CASE WHEN lang = 'en' THEN 'Risk is ' || lower(a) || ' here' ELSE 'No label: ' || substr(clause_text, 1, 30) END AS explanation FROM ann
 UNION ALL SELECT clause_index, clause_text, status, 'Licensee', b, 'Exposure of ' || substr(clause_text, 1, 30) FROM ann)
"""
LINES = r"""WITH ln AS (SELECT * FROM (SELECT CAST(doc_id AS VARCHAR) AS source_file, lang, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents)
 WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''),
"""


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


FLAGS = (
    LINES
    + rf"""fl AS (SELECT *, regexp_matches(regexp_replace(text, '^\s+|\s+$', '', 'g'), '{_re2(segment.HEADER)}') AS is_header,
 regexp_matches(text, '(?i){_re2(segment.SUBPART)}') AS is_subpart,
 regexp_matches(text, '{_re2(segment.TOP_LEVEL)}') AS is_top,
 (regexp_matches(text, '{_re2(segment.DECIMAL)}') OR regexp_matches(text, '(?i){_re2(segment.SECTION_DECIMAL)}')) AND NOT regexp_matches(text, '{_re2(segment.TOP_LEVEL)}') AS is_decimal FROM ln)"""
)
BLOCKS = (
    FLAGS
    + """, br AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR is_header OR coalesce(lag(is_header) OVER w, false) OR is_subpart OR is_decimal OR is_top THEN 1 ELSE 0 END AS brk
 FROM fl WINDOW w AS (PARTITION BY source_file ORDER BY line_no)),
bn AS (SELECT *, sum(brk) OVER (PARTITION BY source_file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS block_no FROM br),
bl AS (SELECT source_file, CAST(block_no AS INT) AS block_no, string_agg(text, ' ' ORDER BY line_no) AS text, arg_min(is_header, line_no) AS is_header, arg_min(is_subpart, line_no) AS is_subpart, arg_min(is_decimal, line_no) AS is_decimal
 FROM bn GROUP BY source_file, block_no)"""
)
MERGED = (
    BLOCKS
    + rf""", mo AS (SELECT *, is_header OR is_subpart OR is_decimal OR regexp_matches(text, '{_re2(segment.NUMBERED)}') OR regexp_matches(text, '{_re2(segment.TOP_LEVEL)}') AS own,
 is_header OR is_subpart OR is_decimal OR regexp_matches(text, '[.;:]\s*$') AS closed FROM bl),
mg AS (SELECT *, sum(CASE WHEN own OR coalesce(pc, true) THEN 1 ELSE 0 END) OVER (PARTITION BY source_file ORDER BY block_no ROWS UNBOUNDED PRECEDING) AS g
 FROM (SELECT *, lag(closed) OVER (PARTITION BY source_file ORDER BY block_no) AS pc FROM mo)),
me AS (SELECT source_file, min(block_no) AS block_no, string_agg(text, ' ' ORDER BY block_no) AS text, arg_min(is_header, block_no) AS is_header, arg_min(is_subpart, block_no) AS is_subpart, arg_min(is_decimal, block_no) AS is_decimal
 FROM mg GROUP BY source_file, g)"""
)
_BOILER = " OR ".join(f"regexp_matches(text, '{'' if case else '(?i)'}{_re2(p)}')" for p, case in segment.BOILERPLATE)
ENRICHED = (
    MERGED
    + rf""", se AS (SELECT *, coalesce(last_value(CASE WHEN is_header THEN trim(text) END IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY block_no ROWS UNBOUNDED PRECEDING), 'PREAMBLE') AS section_header,
 count(*) FILTER (WHERE NOT is_header) OVER (PARTITION BY source_file) AS total FROM me),
ke AS (SELECT source_file, block_no, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, section_header, total, is_subpart, is_decimal FROM se WHERE NOT is_header AND NOT ({_BOILER})),
tk AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS token_count FROM ke),
cl AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY block_no) AS clause_id FROM tk WHERE token_count >= 10),
en AS (SELECT source_file, clause_id, text, section_header, token_count, is_subpart, is_decimal AS is_decimal_section,
 CASE WHEN clause_id / greatest(total, 1) < 0.25 THEN 'early' WHEN clause_id / greatest(total, 1) >= 0.75 THEN 'late' ELSE 'middle' END AS position,
 CASE WHEN is_subpart OR is_decimal THEN last_value(CASE WHEN NOT (is_subpart OR is_decimal) THEN clause_id END IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent_clause_id FROM cl)"""
)


# segmentation


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.merged(segment.blocks(lines(spark, sf_dir)))


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.enriched(_merged(spark, sf_dir).withColumn("part_no", F.lit(0)))


@query(LINES.rstrip().rstrip(",") + " SELECT source_file, line_no, text FROM ln")
def clause_lines(spark, sf_dir):
    return lines(spark, sf_dir).select("source_file", F.col("line_no").cast("long").alias("line_no"), "text")


@query(FLAGS + " SELECT source_file, line_no, is_header, is_subpart, is_top, is_decimal FROM fl")
def line_flags(spark, sf_dir):
    return segment.flagged(lines(spark, sf_dir)).select("source_file", F.col("line_no").cast("long").alias("line_no"), "is_header", "is_subpart", "is_top", "is_decimal")


@query(BLOCKS + " SELECT source_file, block_no, text, is_header, is_subpart, is_decimal FROM bl")
def clause_blocks(spark, sf_dir):
    return segment.blocks(lines(spark, sf_dir)).select("source_file", "block_no", "text", "is_header", "is_subpart", "is_decimal")


@query(MERGED + " SELECT source_file, block_no, text, is_header, is_subpart, is_decimal FROM me")
def clause_merge(spark, sf_dir):
    return _merged(spark, sf_dir).select("source_file", "block_no", "text", "is_header", "is_subpart", "is_decimal")


@query(ENRICHED + " SELECT source_file, CAST(clause_id AS INT) AS clause_id, text, section_header, CAST(token_count AS INT) AS token_count, is_subpart, is_decimal_section, position, CAST(parent_clause_id AS INT) AS parent_clause_id FROM en")
def clause_enrich(spark, sf_dir):
    return _clauses(spark, sf_dir).select("source_file", "clause_id", "text", "section_header", "token_count", "is_subpart", "is_decimal_section", "position", "parent_clause_id")


@query(ENRICHED + " SELECT d.lang, position, count(*) AS clauses, CAST(sum(token_count) AS BIGINT) AS tokens FROM en JOIN documents d ON CAST(d.doc_id AS VARCHAR) = en.source_file GROUP BY 1, 2")
def clause_positions(spark, sf_dir):
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_file"), "lang")
    return _clauses(spark, sf_dir).join(langs, "source_file").groupBy("lang", "position").agg(F.count("*").alias("clauses"), F.sum("token_count").alias("tokens"))


@query(ENRICHED + " SELECT source_file, count(*) AS clauses, CAST(1 AS BIGINT) AS pages FROM en GROUP BY 1 UNION ALL SELECT NULL, count(*), count(DISTINCT source_file) FROM en")
def file_totals(spark, sf_dir):
    return compare.totals(_clauses(spark, sf_dir))


@query(ENRICHED + " SELECT source_file, string_agg(text, chr(10) || chr(10) ORDER BY clause_id) AS value FROM en GROUP BY 1")
def joined_texts(spark, sf_dir):
    return writers.joined_text(_clauses(spark, sf_dir))


@query(LINES.rstrip().rstrip(",") + f" SELECT source_file, count(*) AS n, count(*) FILTER (WHERE {_BOILER}) AS boilerplate FROM ln GROUP BY 1")
def boilerplate_filter(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("source_file").agg(F.count("*").alias("n"), F.count_if(segment.is_boilerplate(F.col("text"))).alias("boilerplate"))


@query(LINES.rstrip().rstrip(",") + r" SELECT source_file, line_no FROM ln WHERE NOT (length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 30 OR regexp_matches(text, '^\s*[-–]?\s*\d+\s*[-–]?\s*$') OR regexp_matches(text, '(?i)^\s*((By|Name|Its|Title|Date)\s*:|/s/|_{3,}|Source\s*:)'))")
def noise_filter(spark, sf_dir):
    return lines(spark, sf_dir).where(~segment.is_noise(F.col("text"))).select("source_file", F.col("line_no").cast("long").alias("line_no"))


@query(LINES.rstrip().rstrip(",") + r", t AS (SELECT source_file, line_no, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS tokens FROM ln) SELECT source_file, line_no, CAST(tokens AS INT) AS tokens FROM t WHERE tokens >= 10")
def token_filter(spark, sf_dir):
    return lines(spark, sf_dir).select("source_file", F.col("line_no").cast("long").alias("line_no"), X.token_count(F.col("text")).alias("tokens")).where("tokens >= 10")


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(regexp_replace(text, '[^\pL\pN_]', '\0\0', 'g'), '(?i)(?:^|[^\pL\pN_])(the|that|with|for|and|this)(?:$|[^\pL\pN_])', 1), lambda x: lower(x)))), ',') AS refs FROM documents")
def party_refs(spark, sf_dir):
    """References to parties; the driver texts have none, so common words stand for them."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.party_refs(F.col("text"), r"\b(the|that|with|for|and|this)\b"), ",").alias("refs"))


@query(r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\n\n+'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g') <> '')) AS BIGINT) AS paragraphs FROM documents")
def paragraph_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id").join(segment.paragraphs(docs).groupBy("doc_id").agg(F.count("*").alias("paragraphs")), "doc_id", "left").select("doc_id", F.coalesce("paragraphs", F.lit(0)).alias("paragraphs"))


@query(r"WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10) || chr(10)), lambda x: replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), chr(10), ' ')), lambda x: length(x) > 20) AS c FROM documents) SELECT doc_id, unnest(c) AS clause_text, CAST(unnest(generate_series(1, len(c))) AS INT) AS clause_index FROM p")
def blank_line_scan(spark, sf_dir):
    return readers.blank_line_clauses(table(spark, sf_dir, "documents").select("doc_id", "text"))


# annotations


@query(ANN + "SELECT clause_index, party, risk, explanation FROM party WHERE status = 'success'")
def explode_parties(spark, sf_dir):
    return reshape.party_rows(curate.successful(annotations(spark, sf_dir))).select("clause_index", "party", "risk", "explanation")


@query(ANN + "SELECT clause_index, status <> 'api_error' AS clean FROM ann")
def error_partition(spark, sf_dir):
    good, bad = curate.without_status(annotations(spark, sf_dir))
    return good.select("clause_index", F.lit(True).alias("clean")).unionByName(bad.select("clause_index", F.lit(False).alias("clean")))


@query(ANN + r"SELECT clause_index, count(*) FILTER (WHERE regexp_matches(explanation, '(?i)\b(low|medium|high)\b')) > 0 AS leaky FROM party GROUP BY 1")
def leaky_split(spark, sf_dir):
    leaky, clean = curate.by_leak(annotations(spark, sf_dir))
    return leaky.select("clause_index", F.lit(True).alias("leaky")).unionByName(clean.select("clause_index", F.lit(False).alias("leaky")))


@query(ANN + "SELECT clause_index FROM ann WHERE a = 'High' OR b = 'High'")
def any_party_high(spark, sf_dir):
    return curate.any_party(annotations(spark, sf_dir)).select("clause_index")


@query(ANN + "SELECT clause_index FROM ann WHERE a = 'Low' AND b = 'Low'")
def both_parties_low(spark, sf_dir):
    return curate.both_parties(annotations(spark, sf_dir)).select("clause_index")


@query(ANN + "SELECT clause_index, CASE WHEN 'High' IN (a, b) THEN 'High' WHEN 'Medium' IN (a, b) THEN 'Medium' ELSE 'Low' END AS class, a || '|' || b AS combined FROM ann")
def severity_class(spark, sf_dir):
    return annotations(spark, sf_dir).select("clause_index", L.clause_class(F.col("parties")).alias("class"), L.combined(F.col("parties")).alias("combined"))


@query(ANN + "SELECT clause_index, party, CASE WHEN risk = 'Medium' THEN 'High' ELSE risk END AS risk FROM party")
def merge_labels(spark, sf_dir):
    return reshape.party_rows(reshape.merged_labels(annotations(spark, sf_dir))).select("clause_index", "party", "risk")


@query(ANN + "SELECT party, count(*) FILTER (WHERE risk = 'Medium') AS converted FROM party GROUP BY 1")
def label_conversions(spark, sf_dir):
    return reshape.conversions(annotations(spark, sf_dir))


@query(ANN + "SELECT party, risk, count(*) AS n FROM party GROUP BY 1, 2")
def party_risk_dist(spark, sf_dir):
    return compare.risk_counts(reshape.party_rows(annotations(spark, sf_dir)), "party", "risk")


@query(ANN + "SELECT party, risk, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY party) AS BIGINT) AS total, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY party), 1) AS percent FROM party GROUP BY 1, 2")
def party_risk_share(spark, sf_dir):
    return compare.risk_shares(reshape.party_rows(annotations(spark, sf_dir)))


@query(ANN + "SELECT party, count(*) FILTER (WHERE risk = 'Low') AS Low, count(*) FILTER (WHERE risk = 'Medium') AS Medium, count(*) FILTER (WHERE risk = 'High') AS High, CAST(0 AS BIGINT) AS other FROM party GROUP BY 1")
def risk_pivot(spark, sf_dir):
    return compare.risk_table(reshape.party_rows(annotations(spark, sf_dir)))


@query(ANN + "SELECT party, round(avg(length(explanation)), 4) AS mean_length, CAST(0 AS BIGINT) AS quoted FROM party GROUP BY 1")
def explanation_stats(spark, sf_dir):
    return compare.explanation_stats(annotations(spark, sf_dir))


@query(ANN + "SELECT count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status <> 'success') AS errors FROM ann")
def status_counts(spark, sf_dir):
    return compare.status_counts(annotations(spark, sf_dir))


@query(ANN + "SELECT 'clause_' || clause_index AS chunk_id, a AS licensor_risk, b AS licensee_risk, 'Licensor Risk: ' || a || '. Licensee Risk: ' || b || '. Clause: ' || clause_text AS enriched_text FROM ann WHERE status = 'success'")
def retrieval_chunks(spark, sf_dir):
    return reshape.chunks(annotations(spark, sf_dir)).select("chunk_id", "licensor_risk", "licensee_risk", "enriched_text")


@query(ANN + "SELECT clause_index, b AS risk, 'Exposure of ' || substr(clause_text, 1, 30) AS explanation FROM ann WHERE status = 'success'")
def role_projection(spark, sf_dir):
    return reshape.for_role(reshape.chunks(annotations(spark, sf_dir)), F.lit("Licensee")).select("clause_index", "risk", "explanation")


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reshape.party_rows(curate.successful(annotations(spark, sf_dir)))
    return reshape.flat(reshape.examples(rows)).withColumn("row_no", F.col("clause_index") * 2 + (F.col("party") == "Licensee").cast("int"))


_HEAD = "'<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || '" + P.ANALYST.replace("'", "''") + "' || '<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || 'Analyze the following contract clause from the perspective of the **' || party || '**.' || chr(10) || chr(10) || 'Clause:' || chr(10) || '\"\"\"' || chr(10) || clause_text || chr(10) || '\"\"\"' || chr(10) || chr(10) || 'Provide:' || chr(10) || '1. Risk Level' || chr(10) || '2. Explanation<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)"
EXAMPLES = ANN.rstrip() + f", ex AS (SELECT {_HEAD} || 'Risk Level: ' || risk || chr(10) || 'Explanation: ' || explanation || '<|eot_id|>' AS text, {_HEAD} AS prompt, CAST(clause_index AS INT) AS clause_index, clause_text, party, risk, explanation, CAST(clause_index * 2 + CASE WHEN party = 'Licensee' THEN 1 ELSE 0 END AS INT) AS row_no FROM party WHERE status = 'success') "


@query(EXAMPLES + "SELECT row_no, text, clause_index, party, risk FROM ex")
def training_examples(spark, sf_dir):
    return _examples(spark, sf_dir).select("row_no", "text", "clause_index", "party", "risk")


@query(EXAMPLES + "SELECT row_no, prompt, 'Risk Level: ' || risk || chr(10) || 'Explanation: ' || explanation || '<|eot_id|>' AS response FROM ex")
def prompt_cut(spark, sf_dir):
    return _examples(spark, sf_dir).select("row_no", X.prompt_only(F.col("text")).alias("prompt"), X.response_only(F.col("text")).alias("response"))


@query(EXAMPLES + r"SELECT row_no, regexp_replace(split_part(clause_text, '\"\"\"', 1), '^\s+|\s+$', '', 'g') AS body FROM ex".replace('\\"', '"'))
def clause_bodies(spark, sf_dir):
    return _examples(spark, sf_dir).select("row_no", X.clause_body(F.col("text")).alias("body"))


@query(EXAMPLES + "SELECT row_no, explanation FROM ex")
def explanation_extract(spark, sf_dir):
    return _examples(spark, sf_dir).select("row_no", X.explanation(F.col("text")).alias("explanation"))


@query(EXAMPLES + "SELECT row_no, prompt || 'Risk Level: ' || risk || chr(10) || 'Explanation: none given<|eot_id|>' AS text FROM ex")
def explanation_inject(spark, sf_dir):
    return _examples(spark, sf_dir).select("row_no", X.with_explanation(F.col("text"), F.lit("none given")).alias("text"))


@query(EXAMPLES + "SELECT row_no, prompt || 'Risk Level: ' || risk || chr(10) || 'Explanation: ' || replace(replace(replace(explanation, 'is high here', 'is significant here'), 'is medium here', 'is moderate here'), 'is low here', 'is minimal here') || '<|eot_id|>' AS text FROM ex")
def leak_clean(spark, sf_dir):
    return _examples(spark, sf_dir).select("row_no", X.unleaked(F.col("text")).alias("text"))


@query(EXAMPLES + "SELECT count(*) AS n, count(*) FILTER (WHERE risk = 'Medium') AS malformed FROM ex")
def label_validity(spark, sf_dir):
    return _examples(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(L.malformed_answer(F.col("text"))).alias("malformed"))


@query(EXAMPLES + "SELECT row_no, risk AS marked, CASE WHEN risk IN ('Low', 'High') THEN risk ELSE 'Unknown' END AS terminal, CASE WHEN risk IN ('Low', 'High') THEN upper(risk) ELSE 'UNKNOWN' END AS upper_binary, risk AS word, lower(risk) AS priority FROM ex")
def label_parsers(spark, sf_dir):
    """Five conventions on answers of one line, where they all can be told."""
    line = F.concat(F.lit("Risk Level: "), F.col("risk"))
    return _examples(spark, sf_dir).select("row_no", L.marked_or_first(line).alias("marked"), L.terminal_or_last(line).alias("terminal"), L.upper_binary(line).alias("upper_binary"), L.word_or_part(line).alias("word"), L.by_priority(line).alias("priority"))


@query(EXAMPLES + "SELECT row_no, CASE WHEN risk = 'Low' THEN 'Low' ELSE 'High' END AS risk, CASE WHEN contains(explanation, chr(10)) THEN rtrim(split_part(explanation, chr(10), 1)) ELSE rtrim(explanation) END AS explanation FROM ex")
def serving_parse(spark, sf_dir):
    got = L.served(F.concat(F.lit("Risk Level: "), F.col("risk"), F.lit("\nExplanation: "), F.col("explanation")))
    rows = reshape.party_rows(curate.successful(annotations(spark, sf_dir))).withColumn("row_no", (F.col("clause_index") * 2 + (F.col("party") == "Licensee").cast("int")).cast("int"))
    return rows.withColumn("a", got).select("row_no", "a.risk", "a.explanation")


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'idiot|scum') THEN 'High' WHEN regexp_matches(lower(text), 'ing|ung') THEN 'Medium' ELSE 'Low' END AS risk FROM documents")
def placeholder_classify(spark, sf_dir):
    """The stand-in classifier; the driver texts have none of its words, so others are given."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", L.stand_in(F.col("text"), F.lit("Licensee"), ("idiot", "scum"), ("ing", "ung"))["risk"].alias("risk"))


@query("SELECT doc_id, replace(substr(text, 1, 80), chr(10), ' ') AS short, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS long FROM documents")
def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text"), 80).alias("short"), X.snippet(F.col("text"), 300, dots=True).alias("long"))


@query("SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>') AS html FROM documents")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.html_escaped(F.col("text")).alias("html"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN '[Section: ' || source || ']' || chr(10) || text ELSE text END AS prompt FROM documents")
def section_prefix(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.in_section(F.col("text"), F.when(F.col("lang") == "en", F.col("source"))).alias("prompt"))


@query("SELECT event_id, props AS object FROM events")
def json_from_text(spark, sf_dir):
    """The last balanced object of a text that goes on after it."""
    return table(spark, sf_dir, "events").select("event_id", X.last_object(F.concat(F.lit("Sure. "), F.col("props"), F.lit(" Done."))).alias("object"))


# duplicates, audits and joins


@query("SELECT times, count(*) AS keys FROM (SELECT count(*) AS times FROM documents GROUP BY text) GROUP BY 1")
def freq_of_freq(spark, sf_dir):
    return compare.frequencies_of_frequencies(table(spark, sf_dir, "documents"), "text")


@query("SELECT count(*) AS n, min(doc_id) AS first, md5(text) AS key FROM documents GROUP BY text HAVING count(*) > 1")
def dup_texts(spark, sf_dir):
    got = compare.duplicates(table(spark, sf_dir, "documents"), "text", order="doc_id")
    return got.select("n", "first", F.md5("text").alias("key"))


@query("SELECT count(*) AS n, min(doc_id) AS first, md5(text) AS key FROM documents GROUP BY text HAVING count(*) > 1 ORDER BY n DESC, first LIMIT 10")
def dup_texts_top(spark, sf_dir):
    got = compare.duplicates(table(spark, sf_dir, "documents"), "text", top=10, order="doc_id")
    return got.select("n", "first", F.md5("text").alias("key"))


@query("SELECT count(*) AS total, count(DISTINCT text) AS \"unique\", round(count(*) / count(DISTINCT text), 4) AS per_key FROM documents")
def unique_clauses(spark, sf_dir):
    return compare.uniqueness(table(spark, sf_dir, "documents"), "text")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_first(spark, sf_dir):
    return curate.dedup_first(table(spark, sf_dir, "documents"), "text", order="doc_id").select("doc_id")


@query("SELECT max(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_last(spark, sf_dir):
    return curate.dedup_last(table(spark, sf_dir, "documents"), "text", order="doc_id").select("doc_id")


@query(EXAMPLES + "SELECT min(row_no) AS row_no FROM ex GROUP BY clause_text, party")
def dedup_body_party(spark, sf_dir):
    rows = _examples(spark, sf_dir).withColumn("body", X.clause_body(F.col("text")))
    return curate.dedup_first(rows, "body", "party").select(F.col("row_no").cast("int").alias("row_no"))


@query(ANN + "SELECT clause_index FROM ann WHERE clause_index NOT IN (SELECT clause_index FROM ann WHERE status <> 'success')")
def resume_anti(spark, sf_dir):
    ann = annotations(spark, sf_dir)
    return compare.remaining(ann, ann.where("status <> 'success'")).select("clause_index")


@query("SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 2)")
def oversampled_semi(spark, sf_dir):
    return compare.repeated(table(spark, sf_dir, "documents"), "text").select("doc_id")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = annotations(spark, sf_dir).withColumn("row_no", F.col("clause_index"))
    return compare.versions(old, reshape.merged_labels(old).where("quality = 1"))


VERSIONS = ANN.rstrip() + ", ver AS (SELECT p.clause_index, p.party, p.risk AS old_risk, CASE WHEN p.risk = 'Medium' THEN 'High' ELSE p.risk END AS new_risk FROM party p JOIN ann USING (clause_index) WHERE p.status = 'success' AND ann.quality = 1) "


@query(VERSIONS + "SELECT clause_index, party, old_risk, new_risk FROM ver WHERE old_risk IS DISTINCT FROM new_risk")
def version_diff(spark, sf_dir):
    return compare.mismatches(_versions(spark, sf_dir))


@query(VERSIONS + "SELECT party, old_risk, new_risk, count(*) AS n FROM ver WHERE old_risk <> new_risk GROUP BY 1, 2, 3")
def transitions(spark, sf_dir):
    return compare.transitions(_versions(spark, sf_dir))


@query(VERSIONS + "SELECT * FROM ver WHERE old_risk = 'Medium' AND new_risk = 'High' ORDER BY clause_index, party LIMIT 1")
def transition_example(spark, sf_dir):
    return compare.transition_example(_versions(spark, sf_dir), "Medium", "High")


# samples and splits


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    ann = annotations(spark, sf_dir)
    return ann.select(F.col("clause_index").alias("row_no"), L.clause_class(F.col("parties")).alias("risk"), "clause_text")


CLASSES = ANN.rstrip() + ", cls AS (SELECT clause_index AS row_no, CASE WHEN 'High' IN (a, b) THEN 'High' WHEN 'Medium' IN (a, b) THEN 'Medium' ELSE 'Low' END AS risk, clause_text FROM ann), rk AS (SELECT *, row_number() OVER (PARTITION BY risk ORDER BY md5('42|' || row_no), row_no) AS rn, count(*) OVER (PARTITION BY risk) AS size FROM cls) "


@query(CLASSES + "SELECT risk, count(*) AS n FROM cls GROUP BY 1")
def class_sizes(spark, sf_dir):
    return curate.class_sizes(_labelled(spark, sf_dir))


@query(CLASSES + "SELECT row_no, risk FROM rk WHERE rn <= (SELECT min(size) FROM rk)")
def undersample(spark, sf_dir):
    return curate.undersampled(_labelled(spark, sf_dir)).select("row_no", "risk")


@query(CLASSES + ", m AS (SELECT max(size) AS n FROM rk) SELECT row_no, risk, CAST(unnest(generate_series(0, (n - size) // size + CASE WHEN rn <= (n - size) % size THEN 1 ELSE 0 END)) AS INT) AS copy_no FROM rk, m")
def oversample_even(spark, sf_dir):
    return curate.oversampled(_labelled(spark, sf_dir)).select("row_no", "risk", "copy_no")


@query(CLASSES + "SELECT risk, CASE WHEN risk = 'High' THEN greatest(size, CAST(round_even((SELECT count(*) FROM cls WHERE risk = 'Low') / 1.5, 0) AS BIGINT)) ELSE size END AS n FROM (SELECT DISTINCT risk, size FROM rk)")
def oversample_ratio(spark, sf_dir):
    return curate.oversampled_to_ratio(_labelled(spark, sf_dir).select("row_no", "risk")).groupBy("risk").agg(F.count("*").alias("n"))


#: Draws from the High rows, as places in the order of row_no.
DRAWS = """, hi AS (SELECT row_no, row_number() OVER (ORDER BY row_no) - 1 AS place, count(*) OVER () AS n FROM cls WHERE risk = 'High'),
dr AS (SELECT i AS draw, CAST('0x' || substr(md5('42|' || i), 1, 12) AS BIGINT) % (SELECT max(n) FROM hi) AS place FROM (SELECT unnest(generate_series(1, {0})) AS i)) """


@query(CLASSES + DRAWS.format(100) + "SELECT draw, row_no FROM dr JOIN hi USING (place)")
def drawn_rows(spark, sf_dir):
    """One hundred draws from the High rows, each with the row that it took."""
    return curate.drawn(_labelled(spark, sf_dir).where("risk = 'High'").select("row_no"), 100).select("draw", "row_no")


_EXTRA = "greatest(0, CAST(round_even((SELECT count(*) FROM cls WHERE risk = 'Low') / 1.5, 0) AS BIGINT) - (SELECT count(*) FROM cls WHERE risk = 'High'))"


@query(CLASSES + DRAWS.format(_EXTRA) + "SELECT row_no, risk, CAST(NULL AS BIGINT) AS draw FROM cls UNION ALL SELECT row_no, 'High', draw FROM dr JOIN hi USING (place)")
def oversampled_rows(spark, sf_dir):
    """All rows, and the High ones that were drawn again until the ratio."""
    return curate.oversampled_to_ratio(_labelled(spark, sf_dir).select("row_no", "risk"))


@query(CLASSES + "SELECT row_no, risk FROM rk WHERE rn <= 66")
def stratified_sample(spark, sf_dir):
    return curate.per_class(_labelled(spark, sf_dir), 66).select("row_no", "risk")


@query(CLASSES + "SELECT row_no, risk, rn <= CASE risk WHEN 'High' THEN 25 ELSE 50 END AS held FROM rk")
def quota_holdout(spark, sf_dir):
    held, rest = curate.quotas(_labelled(spark, sf_dir), {"High": 25, "Medium": 50, "Low": 50})
    return held.withColumn("held", F.lit(True)).unionByName(rest.withColumn("held", F.lit(False))).select("row_no", "risk", "held")


SPLIT = CLASSES.rstrip() + ", gr AS (SELECT clause_text, bool_or(risk = 'High') AS high FROM cls GROUP BY 1), sp AS (SELECT clause_text, CASE WHEN row_number() OVER (PARTITION BY high ORDER BY md5('42|' || clause_text), clause_text) <= greatest(1, CAST(round_even(count(*) OVER (PARTITION BY high) * 0.2, 0) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM gr) "


@query(SPLIT + "SELECT row_no, split FROM cls JOIN sp USING (clause_text)")
def grouped_split(spark, sf_dir):
    return curate.grouped_split(_labelled(spark, sf_dir), "clause_text").select("row_no", "split")


@query(SPLIT + "SELECT count(*) AS leaks FROM (SELECT clause_text FROM cls JOIN sp USING (clause_text) GROUP BY 1 HAVING count(DISTINCT split) > 1)")
def split_leak_check(spark, sf_dir):
    return curate.split_overlap(curate.grouped_split(_labelled(spark, sf_dir), "clause_text"), "clause_text").agg(F.count("*").alias("leaks"))


@query(SPLIT + "SELECT split, risk, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY split) AS BIGINT) AS total, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY split), 1) AS percent FROM cls JOIN sp USING (clause_text) GROUP BY 1, 2")
def split_risk_share(spark, sf_dir):
    return compare.risk_shares(curate.grouped_split(_labelled(spark, sf_dir), "clause_text"), "split")


@query(CLASSES + ", g AS (SELECT DISTINCT clause_text AS g FROM cls), o AS (SELECT g, row_number() OVER (ORDER BY md5('42|' || g), g) <= CAST(floor((SELECT count(*) FROM g) * 0.1) AS BIGINT) AS val FROM g) SELECT row_no, CASE WHEN val THEN 'val' ELSE 'train' END AS split FROM cls JOIN o ON g = clause_text")
def plain_split(spark, sf_dir):
    return curate.plain_split(_labelled(spark, sf_dir), "clause_text").select("row_no", "split")


@query(CLASSES + ", n AS (SELECT 3 * (SELECT count(*) FROM cls WHERE risk = 'High') + (SELECT count(*) FROM cls WHERE risk = 'Medium') AS n) SELECT risk, count(*) * CASE WHEN risk = 'High' THEN 3 ELSE 1 END AS n FROM cls WHERE risk <> 'Low' GROUP BY 1")
def composition(spark, sf_dir):
    """High three times and all Medium: the target at which Low is not yet needed."""
    rows = _labelled(spark, sf_dir)
    n = {r["risk"]: r["n"] for r in curate.class_sizes(rows).collect()}
    return curate.composed(rows, 3 * n.get("High", 0) + n.get("Medium", 0)).groupBy("risk").agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 2 AS pair_no FROM documents) SELECT doc_id, pair_no FROM p WHERE pair_no IN (SELECT pair_no FROM p GROUP BY 1 HAVING count(*) = 2)")
def pairing(spark, sf_dir):
    return curate.pairs(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "pair_no")


# evaluation


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licensor's risk as truth, Licensee's as prediction; by language."""
    p = F.col("parties")
    return annotations(spark, sf_dir).select(F.col("clause_index").alias("row_no"), F.col("lang").alias("party"), p["Licensor"]["risk"].alias("y_true"), p["Licensee"]["risk"].alias("y_pred"))


PRED = ANN.rstrip() + ", pr AS (SELECT clause_index AS row_no, lang AS party, a AS y_true, b AS y_pred FROM ann), lb AS (SELECT unnest(['Low', 'Medium', 'High']) AS label), "
PRF = PRED + """pl AS (SELECT label, coalesce(tp / nullif(predicted, 0), 0) AS "precision", coalesce(tp / nullif(support, 0), 0) AS recall, support FROM (SELECT label, count(*) FILTER (WHERE y_true = label AND y_pred = label) AS tp, count(*) FILTER (WHERE y_pred = label) AS predicted, count(*) FILTER (WHERE y_true = label) AS support FROM pr, lb GROUP BY 1)),
pf AS (SELECT label, "precision", recall, coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0) AS f1, support FROM pl) """
_round = lambda df, *cols: df.withColumns({c: F.round(c, 9) for c in cols})


@query(PRED.rstrip(", ") + " SELECT party, count(*) AS n, round(avg(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END), 9) AS accuracy FROM pr GROUP BY 1")
def eval_by_party(spark, sf_dir):
    return _round(evaluate.accuracy(_predictions(spark, sf_dir), ("party",)), "accuracy")


@query(PRED.rstrip(", ") + " SELECT round(avg(r), 9) AS balanced_accuracy FROM (SELECT avg(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) AS r FROM pr GROUP BY y_true)")
def balanced_acc(spark, sf_dir):
    return _round(evaluate.balanced_accuracy(_predictions(spark, sf_dir)), "balanced_accuracy")


@query(PRF + 'SELECT label, round("precision", 9) AS "precision", round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM pf')
def prf_report(spark, sf_dir):
    return _round(evaluate.per_label(_predictions(spark, sf_dir), RISKS), "precision", "recall", "f1")


@query(PRF + 'SELECT \'macro\' AS average, round(avg("precision"), 9) AS "precision", round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1, CAST(sum(support) AS BIGINT) AS support FROM pf UNION ALL SELECT \'weighted\', round(sum("precision" * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM pf')
def prf_averages(spark, sf_dir):
    return _round(evaluate.averages(_predictions(spark, sf_dir), RISKS), "precision", "recall", "f1")


CONF = PRED + "cf AS (SELECT label AS y_true, count(*) FILTER (WHERE y_true = label AND y_pred = 'Low') AS Low, count(*) FILTER (WHERE y_true = label AND y_pred = 'Medium') AS Medium, count(*) FILTER (WHERE y_true = label AND y_pred = 'High') AS High FROM pr, lb GROUP BY label) "


@query(CONF + "SELECT * FROM cf")
def confusion(spark, sf_dir):
    return evaluate.confusion(_predictions(spark, sf_dir), RISKS)


@query(CONF + "SELECT y_true, round(Low / greatest(Low + Medium + High, 1), 9) AS Low, round(Medium / greatest(Low + Medium + High, 1), 9) AS Medium, round(High / greatest(Low + Medium + High, 1), 9) AS High FROM cf")
def confusion_normalised(spark, sf_dir):
    return _round(evaluate.normalised(evaluate.confusion(_predictions(spark, sf_dir), RISKS), RISKS), *RISKS)


@query(PRED.rstrip(", ") + " SELECT y_true, y_pred, count(*) AS n FROM pr WHERE y_true <> y_pred GROUP BY 1, 2")
def misclassified(spark, sf_dir):
    return evaluate.errors(_predictions(spark, sf_dir))


@query(PRED.rstrip(", ") + " SELECT party, count(*) AS n, count(*) FILTER (WHERE (y_true, y_pred) IN (('Low', 'High'), ('High', 'Low'))) AS flips, round(count(*) FILTER (WHERE (y_true, y_pred) IN (('Low', 'High'), ('High', 'Low'))) / count(*), 9) AS rate FROM pr GROUP BY 1")
def flips(spark, sf_dir):
    return _round(evaluate.flips(_predictions(spark, sf_dir), ("party",)), "rate")


@query(PRED.rstrip(", ") + " SELECT coalesce(t.label, p.label) AS label, coalesce(t.n, 0) AS n_true, coalesce(p.n, 0) AS n_pred FROM (SELECT y_true AS label, count(*) AS n FROM pr GROUP BY 1) t FULL JOIN (SELECT y_pred AS label, count(*) AS n FROM pr GROUP BY 1) p ON t.label = p.label")
def label_distributions(spark, sf_dir):
    return evaluate.distributions(_predictions(spark, sf_dir))


@query(PRED.rstrip(", ") + " SELECT round(avg(CASE WHEN y_pred = 'Medium' THEN 1 ELSE 0 END), 9) AS share, avg(CASE WHEN y_pred = 'Medium' THEN 1 ELSE 0 END) > 0.6 AS collapsed FROM pr")
def collapse_check(spark, sf_dir):
    return _round(evaluate.label_share(_predictions(spark, sf_dir)), "share")


@query(PRED.rstrip(", ") + " SELECT coalesce(min(row_no) FILTER (WHERE y_true = y_pred), 0) AS correct, coalesce(min(row_no) FILTER (WHERE y_true <> y_pred), 1) AS incorrect, coalesce(min(row_no) FILTER (WHERE y_true = 'High'), 2) AS high, coalesce(min(row_no) FILTER (WHERE y_true = 'Low'), 3) AS low FROM pr")
def exemplars(spark, sf_dir):
    return evaluate.exemplars(_predictions(spark, sf_dir))


@query(PRED.rstrip(", ") + ", c AS (SELECT party, count(*) OVER w AS done, avg(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) OVER w AS accuracy FROM pr WINDOW w AS (PARTITION BY party ORDER BY row_no ROWS UNBOUNDED PRECEDING)) SELECT party, done, round(accuracy, 9) AS accuracy FROM c WHERE done % 10 = 0")
def running_accuracy(spark, sf_dir):
    return _round(evaluate.running_accuracy(_predictions(spark, sf_dir), "party", "row_no"), "accuracy")


@query(PRED + """r AS (SELECT 'as is' AS model, y_true, y_pred FROM pr UNION ALL SELECT 'always low', y_true, 'Low' FROM pr), p AS (SELECT model, label, count(*) FILTER (WHERE y_true = label AND y_pred = label) AS tp, count(*) FILTER (WHERE y_pred = label) AS pp, count(*) FILTER (WHERE y_true = label) AS s FROM r, lb GROUP BY 1, 2),
m AS (SELECT model, avg(coalesce(2 * tp / nullif(pp + s, 0), 0)) AS f FROM p GROUP BY 1) SELECT model, count(*) AS n, round(avg(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END), 9) AS accuracy, round(any_value(f), 9) AS macro_f1 FROM r JOIN m USING (model) GROUP BY 1""")
def model_table(spark, sf_dir):
    rows = _predictions(spark, sf_dir)
    return _round(evaluate.model_table({"as is": rows, "always low": rows.withColumn("y_pred", F.lit("Low"))}, RISKS), "accuracy", "macro_f1")


# retrieval and chat


@query("WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), v), 6) AS score FROM embeddings, q ORDER BY list_dot_product(CAST(embedding AS DOUBLE[]), v) DESC, vec_id LIMIT 3")
def topk_cosine(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    q = vectors.where("vec_id = 0").first()
    if q is None:
        return retrieve.top_k(vectors.limit(0), [0.0]).withColumn("score", F.round("score", 6))
    return retrieve.top_k(vectors, q["embedding"]).withColumn("score", F.round("score", 6))


@query("WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3")
def topk_each(spark, sf_dir):
    """Queries are the rows whose id is divisible by 20, searched against all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieve.top_k_each(vectors, queries).withColumn("score", F.round("score", 6))


@query(ORACLE_SQL["topk_each"])
def topk_pruned(spark, sf_dir):
    """The same by a stored index of cells: exact, blocks that cannot hold a hit are not visited."""
    path = shared_path(spark, "pruned")
    vectors = table(spark, sf_dir, "embeddings")
    pruned.build(vectors, path)
    hits, _ = pruned.search(spark, path, vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")))
    return hits.withColumn("score", F.round("score", 6))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))


@query("WITH h AS (SELECT conv_id, turn, string_agg(role || ':' || length(text), ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM conversations) SELECT conv_id AS session_id, turn, coalesce(h, '') AS history FROM h")
def chat_history(spark, sf_dir):
    df = chat.histories(_turns(spark, sf_dir))
    return df.select("session_id", "turn", F.array_join(F.transform("history", lambda x: F.concat(x["role"], F.lit(":"), F.length(x["content"]).cast("string"))), ",").alias("history"))


@query("SELECT event_id, CAST(sum(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM events")
def chat_sessions(spark, sf_dir):
    """Sessions of events that one type of event resets."""
    events = table(spark, sf_dir, "events")
    reset = events.agg(F.min("event_type")).first()[0]
    df = events.withColumn("__o", F.struct("ts", "event_id"))
    return chat.sessions(df, "user_id", "__o", F.col("event_type") == reset).select("event_id", "session_no")


@query(ANN + "SELECT clause_index FROM party WHERE party = 'Licensor' AND (risk = 'High' OR contains(lower(explanation), 'high') OR clause_index IN (7, 12))")
def relevant_results(spark, sf_dir):
    rows = reshape.party_rows(annotations(spark, sf_dir)).where("party = 'Licensor'")
    rows = rows.withColumn("model_output", F.concat_ws("\n", F.concat(F.lit("Risk Level: "), F.col("risk")), F.concat(F.lit("Explanation: "), F.col("explanation"))))
    return chat.relevant(rows, F.lit("What do Clause 7 and clause12 say?")).select("clause_index")


@query(ANN + ", r AS (SELECT *, row_number() OVER (PARTITION BY risk ORDER BY clause_index, party) AS n FROM party) SELECT clause_index, party, risk FROM r WHERE n <= 5")
def first_five(spark, sf_dir):
    rows = reshape.party_rows(annotations(spark, sf_dir)).withColumn("__o", F.struct("clause_index", "party"))
    return chat.first_k(rows, "risk", "__o", 5).select("clause_index", "party", "risk")


@query("SELECT CAST(d.doc_id AS BIGINT) AS doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) UNION ALL SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents) AND lang = 'en'")
def set_operations(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id")
    both = labels.intersect(docs.select("doc_id"))
    return docs.join(labels, "doc_id", "left_semi").select("doc_id").unionByName(docs.where("lang = 'en'").join(both, "doc_id", "left_semi").select("doc_id"))


# further operators


@query(ANN + "SELECT clause_index, party, risk FROM party WHERE clause_index = (SELECT min(clause_index) FROM ann) AND party = 'Licensee'")
def point_lookup(spark, sf_dir):
    rows = reshape.party_rows(annotations(spark, sf_dir))
    return curate.lookup(rows, rows.agg(F.min("clause_index")).first()[0], "Licensee").select("clause_index", "party", "risk")


@query(PRED.rstrip(", ") + " SELECT row_no FROM pr WHERE party <> 'es'")
def known_predictions(spark, sf_dir):
    """Unparsed predictions, here those of one language, are left out."""
    rows = _predictions(spark, sf_dir).withColumn("predicted", F.when(F.col("party") == "es", "Unknown").otherwise(F.col("y_pred")))
    return curate.known_predictions(rows).select("row_no")


@query(PRED.rstrip(", ") + " SELECT row_no, CASE WHEN party = 'es' THEN 'Low' ELSE y_pred END AS y_pred, party = 'es' AS failed FROM pr")
def parse_fallback(spark, sf_dir):
    rows = _predictions(spark, sf_dir).withColumn("y_pred", F.when(F.col("party") != "es", F.col("y_pred")))
    filled, failed = evaluate.with_fallback(rows, "Low")
    return filled.join(failed.select("row_no", F.lit(True).alias("failed")), "row_no", "left").select("row_no", "y_pred", F.coalesce("failed", F.lit(False)).alias("failed"))


@query(CLASSES + "SELECT risk, count(*) + CASE WHEN risk = 'High' THEN 100 ELSE 0 END AS n FROM cls GROUP BY 1")
def append_sample(spark, sf_dir):
    """One hundred High rows drawn again and appended."""
    rows = _labelled(spark, sf_dir).select("row_no", "risk")
    return rows.unionByName(curate.drawn(rows.where("risk = 'High'"), 100).drop("draw")).groupBy("risk").agg(F.count("*").alias("n"))


@query(CLASSES + "SELECT risk, copy_no, count(*) AS n FROM (SELECT risk, 1 AS copy_no FROM cls WHERE risk <> 'Low' UNION ALL SELECT risk, 2 FROM cls WHERE risk = 'High') GROUP BY 1, 2")
def rephrased_composition(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    n = {r["risk"]: r["n"] for r in curate.class_sizes(rows).collect()}
    return curate.rephrased_composition(rows, 2 * n.get("High", 0) + n.get("Medium", 0), lambda df: df).groupBy("risk", "copy_no").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS clause_index, party, 'High' AS risk, 'This ' || lang || ' clause exposes the ' || party || ' to risk.' AS explanation FROM documents, (SELECT unnest(['Licensor', 'Licensee']) AS party)")
def constant_risk(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clause_index"), F.col("lang").alias("clause_type"))
    return reshape.constant_risk(rows).select("clause_index", "party", "risk", "explanation")


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE lang IN ('en', 'fr') AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 30 GROUP BY text")
def contract_rows(spark, sf_dir):
    """Rows of kept clause types and a risk, a text once; languages stand for types."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_no"), F.col("text").alias("clause_text"), F.col("lang").alias("clause_type"), F.lit("HIGH").alias("risk_level"))
    return curate.contract_rows(rows, ("en", "fr")).select(F.col("row_no").alias("doc_id"))


@query(ENRICHED + ", f AS (SELECT source_file AS file, CAST(1 AS INT) AS pages, CAST(count(*) AS INT) AS clauses FROM en GROUP BY 1) SELECT CAST(count(*) OVER () AS INT) AS total_pdfs, CAST(sum(clauses) OVER () AS BIGINT) AS total_clauses, file, pages, clauses FROM f")
def extraction_summary(spark, sf_dir):
    return writers.summary(_clauses(spark, sf_dir))


@query(ENRICHED + " SELECT source_file, CAST(count(*) AS INT) AS clause_count, CAST(1 AS INT) AS total_pages, string_agg(CAST(clause_id AS VARCHAR), ',' ORDER BY clause_id) AS ids FROM en GROUP BY 1")
def document_assembly(spark, sf_dir):
    return segment.documents(_clauses(spark, sf_dir)).select("source_file", "clause_count", "total_pages", F.array_join(F.transform("clauses", lambda c: c["clause_id"].cast("string")), ",").alias("ids"))


@query("SELECT doc_id, regexp_matches(lower(text), 'rate_limit|rate limit|ratelimit|429|too many requests') AS rate, regexp_matches(lower(text), 'context_length_exceeded|tokens_limit_reached|maximum context|too long') OR (contains(lower(text), 'context') AND contains(lower(text), 'length')) OR (contains(lower(text), 'reduce') AND contains(lower(text), 'token')) AS context FROM documents")
def error_classes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.is_rate_limit(F.col("text")).alias("rate"), X.is_context_length(F.col("text")).alias("context"))


@query(ANN + """SELECT clause_index, '  Clause ' || clause_index || ': Risk Level: ' || a || ' | "' || replace(substr(clause_text, 1, 80), chr(10), ' ') || '..."' AS line FROM ann""")
def summary_lines(spark, sf_dir):
    rows = reshape.party_rows(annotations(spark, sf_dir)).where("party = 'Licensor'")
    output = F.concat(F.lit("Risk Level: "), F.col("risk"), F.lit("\nExplanation: "), F.col("explanation"))
    return rows.select("clause_index", chat.summary_line(F.col("clause_index"), output, F.col("clause_text")).alias("line"))


@query(ANN + "SELECT clause_index, '[Reference 1]' || chr(10) || '  Risk for Licensee: ' || b || chr(10) || '  Why: Exposure of ' || substr(clause_text, 1, 30) || chr(10) || '  Clause text: ' || CASE WHEN length(clause_text) > 300 THEN substr(clause_text, 1, 300) || '...' ELSE clause_text END AS context FROM ann WHERE status = 'success'")
def retrieved_context(spark, sf_dir):
    rows = reshape.for_role(reshape.chunks(annotations(spark, sf_dir)), F.lit("Licensee"))
    return rows.select("clause_index", retrieve.context_text(F.col("risk"), F.col("explanation"), F.col("raw_clause"), F.lit(1), F.lit("Licensee")).alias("context"))


@query(ANN + "SELECT 'Licensee' AS role, clause_index, 'Party role: Licensee' || chr(10) || chr(10) || 'Contract clause:' || chr(10) || clause_text || chr(10) || chr(10) || 'What is the risk level of this clause for the above party?' AS prompt FROM ann")
def classification_prompts(spark, sf_dir):
    rows = annotations(spark, sf_dir)
    return rows.select(F.lit("Licensee").alias("role"), "clause_index", P.classification_request(F.col("clause_text"), F.lit("Licensee")).alias("prompt"))


@query("SELECT session_id, turn, n FROM (SELECT conv_id AS session_id, turn, role, CAST(1 + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS n FROM conversations) WHERE role = 'user'")
def chat_requests(spark, sf_dir):
    """The messages a model would be given at each user turn: a system message, the turns before, the question."""
    df = chat.histories(_turns(spark, sf_dir)).where("role = 'user'")
    asked = chat.question_with_context(F.col("content"), F.array().cast("array<string>"))
    return df.select("session_id", "turn", F.size(chat.messages(F.lit("Be brief."), F.col("history"), asked)).alias("n"))


@query("""WITH t AS (SELECT conv_id, turn, role, text, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
p AS (SELECT q.conv_id, q.turn, q.i, h.i AS hi, h.role AS role, h.text AS text, sum(h.n) OVER (PARTITION BY q.conv_id, q.turn ORDER BY h.i DESC ROWS UNBOUNDED PRECEDING) AS upto FROM t q JOIN t h ON h.conv_id = q.conv_id AND h.i BETWEEN q.i - 4 AND q.i - 1 WHERE q.role = 'user'),
g AS (SELECT conv_id, turn, md5(string_agg(role || ':' || text, '|' ORDER BY hi)) AS h FROM p WHERE upto <= 800 GROUP BY 1, 2)
SELECT conv_id AS session_id, turn, coalesce(h, md5('')) AS history FROM t LEFT JOIN g USING (conv_id, turn) WHERE role = 'user'""")
def chat_requests_bounded(spark, sf_dir):
    """The history that a model is shown at each user turn: of the last four turns as many as have 800 characters together."""
    df = chat.requests(_turns(spark, sf_dir), F.col("role") == "user", 4, 800)
    return df.select("session_id", "turn", F.md5(F.array_join(F.transform("history", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")).alias("history"))


@query(PRED.rstrip(", ") + " SELECT row_no, y_true, y_pred FROM pr WHERE (y_true, y_pred) IN (('Low', 'High'), ('High', 'Low'))")
def flip_rows(spark, sf_dir):
    return evaluate.flip_rows(_predictions(spark, sf_dir)).select("row_no", "y_true", "y_pred")


@query(ANN + "SELECT count(*) FILTER (WHERE lang <> 'en') AS rephrased, count(*) FILTER (WHERE lang = 'en') AS fallback FROM ann")
def rephrase_counts(spark, sf_dir):
    """Copies that a model rephrased, here all but the English ones."""
    rows = annotations(spark, sf_dir).select("lang", F.col("parties")["Licensor"]["explanation"].alias("explanation"))
    return compare.rephrase_counts(rows.withColumn("rephrased", F.when(F.col("lang") == "en", F.col("explanation")).otherwise(F.concat(F.col("explanation"), F.lit("!")))))


@query("SELECT count(*) AS chunks, count(DISTINCT label) AS labels FROM embeddings")
def index_health(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("chunks"), F.countDistinct("label").alias("labels"))


@query("SELECT window_start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, event_type FROM events) GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Tumbling windows, as the stream counts them."""
    from ..streaming import running_counts

    return running_counts(table(spark, sf_dir, "events")).select(F.col("window.start").alias("window_start"), "event_type", "n")
