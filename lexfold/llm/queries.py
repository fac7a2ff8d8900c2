"""The corpus operators' queries: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(table(spark, sf_dir, "documents"))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fitted, scored

    docs = table(spark, sf_dir, "documents")
    return scored(docs, fitted(docs, table(spark, sf_dir, "labels")))


@query
def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fitted, identified

    docs = table(spark, sf_dir, "documents")
    return identified(docs, fitted(docs))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judged

    return judged(table(spark, sf_dir, "documents"))


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest, found

    return digest(found(table(spark, sf_dir, "documents")))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h")


@query
def op6_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import stripped

    got = stripped(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return got.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


@query
def op7_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is its document's label, the number in its path being that document's id; bad: toxic or of quality 0."""
    from .urlrep import judged

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels")
    of = pages.select("page_id", F.regexp_extract("url", r"^[^?#]*?://[^/?#]*/[a-z]+/([0-9]{1,18})", 1).alias("doc_id")).where("doc_id <> ''")
    bad = labels.where("quality is not null or toxic is not null").select(F.col("doc_id").cast("string").alias("doc_id"), ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int").alias("bad"))
    return judged(pages, of.join(bad, "doc_id").select("page_id", "bad"))


@query
def op9_toolchat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toolchat import formatted

    return formatted(table(spark, sf_dir, "conversations"))


@query
def op11_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefixtrie import tried

    return tried(table(spark, sf_dir, "conversations")).drop("node", "parent")


@query
def op12_idfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..storage import shared_path
    from .idfiles import documents, written

    out = shared_path(spark, "idfiles")
    written(table(spark, sf_dir, "documents"), out)
    return documents(spark, out)


@query
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audited

    return audited(table(spark, sf_dir, "documents"))


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]"

ORACLE_SQL["op3_decontamination"] = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(13, len(w)) AS l, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS g
 FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS s FROM iw WHERE len(w) > 0)),
gr AS (SELECT doc_id, p, l, array_to_string(w[p:p + l - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM dw), (SELECT DISTINCT l FROM win) WHERE p + l - 1 <= len(w)),
hit AS (SELECT doc_id, p, gr.l, item FROM gr JOIN win ON gr.l = win.l AND gr.g = win.g),
cov AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(generate_series(p, p + l - 1)) AS x FROM hit) GROUP BY 1),
ids AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS sha FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN ids USING (doc_id)"""

ORACLE_SQL["op4_quality"] = rf"""
WITH b AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACED}+') AS w FROM documents),
ln AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SPACED}')) AS l FROM b),
tri AS (SELECT doc_id, p, array_to_string(w[p:p + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS p FROM b WHERE len(w) > 2)),
rep AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(generate_series(p, p + 2)) AS x FROM rep) GROUP BY 1),
st AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM b JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
fl AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM st),
fa AS (SELECT *, base_failed OR word_chars < 2.0 * n_words OR word_chars > 14.0 * n_words OR n_symbols > 0.5 * n_words OR 100 * n_dup_lines > 50 * n_lines AS failed FROM fl),
ho AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE failed) AS f FROM fa WHERE source IS NOT NULL GROUP BY 1),
mo AS (SELECT least(greatest((sum(f) + 0.5) / (sum(n) + 1.0), 1e-6), 1 - 1e-6) AS mean, avg(f / n) AS m, avg((f / n) * (f / n)) AS s, avg(1.0 / n) AS i FROM ho),
pr AS (SELECT mean, CASE WHEN s - m * m - mean * (1 - mean) * i > 0 THEN least(greatest(mean * (1 - mean) / (s - m * m - mean * (1 - mean) * i) - 1, 1.0), 1e4) ELSE 1e4 END AS k FROM mo),
bad AS (SELECT source FROM ho, pr WHERE (f + mean * k) / (n + k) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept FROM fa"""

ORACLE_SQL["op6_linededup"] = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, text FROM documents),
pg AS (SELECT DISTINCT host, text FROM d), tot AS (SELECT host, count(*) AS pages FROM pg GROUP BY 1),
li AS (SELECT host, line, count(*) AS n FROM (SELECT DISTINCT host, text, unnest(string_split(text, chr(10))) AS line FROM pg) WHERE regexp_matches(line, '{_SPACED}') GROUP BY 1, 2),
dr AS (SELECT host, list(line) AS l FROM li JOIN tot USING (host) WHERE n >= 3 AND n > 0.01 * pages GROUP BY 1),
k AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS a, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_matches(x, '{_SPACED}') OR NOT list_contains(coalesce(l, []), x)) AS b FROM d LEFT JOIN dr USING (host)),
r AS (SELECT doc_id, a, CASE WHEN len(list_filter(b, lambda x: regexp_matches(x, '{_SPACED}'))) > 0 THEN b ELSE a END AS b FROM k)
SELECT doc_id, CAST(len(a) AS BIGINT) AS n_lines, CAST(len(a) - len(b) AS BIGINT) AS n_dropped, sha256(array_to_string(b, chr(10))) AS text_sha256 FROM r"""

_STRENGTH = "(SELECT CASE WHEN v IS NULL OR v <= noise THEN 1000.0 ELSE least(greatest(own / (v - noise) - 1, 2.0), 1000.0) END FROM (SELECT avg((bad / n - mean) * (bad / n - mean)) AS v, avg(mean * (1 - mean)) AS own, avg(mean * (1 - mean) / n) AS noise FROM {0} WHERE n > 0))"
_SHRUNK = "SELECT *, bad + least({0}, weight) * mean AS a, n - bad + least({0}, weight) * (1 - mean) AS b FROM {1}"

ORACLE_SQL["op7_urlfilter"] = rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest, url FROM pages),
p AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*?://[^/?#]*/[a-z]+/([0-9]{{1,18}})', 1) AS doc FROM u),
o AS (SELECT host, CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END AS bad FROM p JOIN labels l ON doc <> '' AND CAST(l.doc_id AS VARCHAR) = doc WHERE quality IS NOT NULL OR toxic IS NOT NULL),
h0 AS (SELECT host, count(bad) AS n, CAST(coalesce(sum(bad), 0) AS BIGINT) AS bad FROM (SELECT DISTINCT host FROM p) LEFT JOIN o USING (host) GROUP BY 1),
h AS (SELECT *, string_split(host, '.') AS s FROM h0),
hd AS (SELECT host, n, bad, CASE WHEN len(s) <= 1 THEN host ELSE s[-2] || '.' || s[-1] END AS domain, CASE WHEN len(s) <= 1 THEN '' ELSE s[-1] END AS suffix FROM h),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hd GROUP BY 1, 2), s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d0 GROUP BY 1),
s1 AS (SELECT *, (SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) FROM s0) AS mean, (SELECT sum(n) + 1.0 FROM s0) AS weight FROM s0), s2 AS ({_SHRUNK.format(_STRENGTH.format("s1"), "s1")}),
d1 AS (SELECT d0.*, a / (a + b) AS mean, a + b AS weight FROM d0 JOIN (SELECT suffix, a, b FROM s2) USING (suffix)), d2 AS ({_SHRUNK.format(_STRENGTH.format("d1"), "d1")}),
h1 AS (SELECT hd.*, a / (a + b) AS mean, a + b AS weight FROM hd JOIN (SELECT domain, a, b FROM d2) USING (domain)), h2 AS ({_SHRUNK.format(_STRENGTH.format("h1"), "h1")}),
bad AS (SELECT host FROM h2 WHERE a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5),
r AS (SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1' WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
 WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/' WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/' WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END AS verdict FROM r"""

#: The driver's conversations hold no tool block, so every event is a message.
ORACLE_SQL["op9_toolchat"] = """
SELECT conv_id, turn, CAST(0 AS BIGINT) AS part, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, CAST(0 AS BIGINT) AS depth, CAST(NULL AS BOOLEAN) AS linked, true AS valid,
 CAST(to_json(struct_pack(content := coalesce(text, ''), role := role)) AS VARCHAR) AS json FROM conversations"""

_SHARE13 = "1 + (1000000000::HUGEINT * ({0} + 2)) // ({1} + 2 * v)"

ORACLE_SQL["op13_divergence"] = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
w AS (SELECT lang, source, id, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*) AS v, sum(total) AS whole FROM k GROUP BY 1),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS own FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, total, coalesce(n, 0) AS n, {_SHARE13.format("coalesce(n, 0)", "own")} AS p, {_SHARE13.format("total", "whole")} AS q FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
tm AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM tm)) WHERE part = 'pair' OR rank <= 10"""

#: CRC-32 of a short text of ASCII, bit by bit: the engine has no function for it.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split({0}, '')]), lambda c, b: list_reduce(list_prepend(xor(c, b), repeat([0::BIGINT], 8)), lambda a, z: xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295::BIGINT)"

ORACLE_SQL["op11_prefixtrie"] = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i, struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) AS s FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(s ORDER BY i) AS l FROM t GROUP BY 1),
cut AS (SELECT c, l, {_CRC.format("CAST(c AS VARCHAR)")} % 6 AS h FROM own),
reb AS (SELECT cut.c, list_concat(coalesce(base.l, [])[1:h], cut.l[h + 1:]) AS l FROM cut LEFT JOIN own base ON base.c = cut.c - cut.c % 100),
pre AS (SELECT c, d, len(l) AS n, l[1:d] AS p, CASE WHEN d > 0 THEN l[1:d - 1] END AS up, CASE WHEN d > 0 THEN length(l[d].x) ELSE 0 END AS chars FROM (SELECT c, l, unnest(generate_series(0, len(l))) AS d FROM reb)),
nd AS (SELECT p, d, up, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256 FROM pre GROUP BY 1, 2, 3),
ch AS (SELECT up, d - 1 AS d, count(*) AS n_children FROM nd WHERE d > 0 GROUP BY 1, 2),
st AS (SELECT nd.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * chars AS s FROM nd LEFT JOIN ch ON ch.d = nd.d AND ch.up = nd.p),
sub AS (SELECT a.p, a.d, sum(b.s) AS saved_tokens, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves FROM (SELECT pre.p, pre.d, nx.p AS q, nx.d AS e FROM pre JOIN pre nx ON pre.c = nx.c AND pre.d <= nx.d GROUP BY 1, 2, 3, 4) a JOIN st b ON b.d = a.e AND b.p = a.q GROUP BY 1, 2)
SELECT st.conv_id, CAST(st.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, st.n_convs, st.n_children, sub.n_leaves, CAST(sub.saved_tokens AS BIGINT) AS saved_tokens, st.ends_sha256
FROM st JOIN sub ON sub.d = st.d AND sub.p = st.p LEFT JOIN nd up ON up.d = st.d - 1 AND up.p = st.up"""
