"""The registered queries: thin, each gets its rows from its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, hmm, langid, linededup, mixing, neardup, quality, suffixdedup, wrapper
from .common import crc_mod, read_table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), neardup.Shape(words=3, percent=85))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", crc_mod(F.col("doc_id"), 3) == 1)
    return langid.predict(docs, langid.fit(docs, ~F.col("held_out")), "held_out")


def op3_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(read_table(spark, sf_dir, "documents").withColumn("held_out", crc_mod(F.col("doc_id"), 7) == 2))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.digest(read_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.scan(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(read_table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(read_table(spark, sf_dir, "pages"))


#: Sources are dealt to domains by the number in their name, as the table has no domains.
DOMAIN = "concat('d', coalesce(try_cast(regexp_extract(source, '([0-9]+)', 1) AS bigint) % 3, 0))"
WEIGHTS = {"domain": {"d0": 0.5, "d1": 0.3, "d2": 0.2}, "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}
DEFAULT = {"domain": 0.1, "lang": 0.1, "source": 1.0}


def mixed(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs, F.expr(DOMAIN), WEIGHTS, DEFAULT)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 0)
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    return quality.score(docs, model).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_near_duplicates, op2_language_id, op3_hmm_score, op4_substring_dedup, op5_decontaminate, op6_line_dedup, op7_main_text, op8_mix_sources, op9_quality, op10_nearest, pipeline)}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5_SQL = rf"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN win ON dw.s = win.s AND dw.n = win.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _shared(level: str, parent: str, key: str, weight: str, given: str) -> str:
    """SQL of one level: children of a node are filled up to one level of water."""
    p = f"PARTITION BY {parent}" if parent else ""
    on = f"JOIN {given} USING ({parent})" if parent else f"CROSS JOIN {given}"
    group = f"{parent}, {key}" if parent else key
    return f"""
{level}_a AS (SELECT {group}, sum(room) AS room, {weight} AS w FROM leaf GROUP BY {group}),
{level}_b AS (SELECT a.*, given, room / w AS ratio FROM {level}_a a {on}),
{level}_c AS (SELECT *,
  greatest(given - coalesce(sum(room) OVER ({p} ORDER BY ratio, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)
  / sum(w) OVER ({p} ORDER BY ratio, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM {level}_b),
{level}_d AS (SELECT *, max(CASE WHEN ratio > level THEN level END) OVER ({p}) AS water FROM {level}_c),
{level} AS (SELECT {group}, CASE WHEN water IS NULL THEN room ELSE least(room, water * w) END AS given FROM {level}_d)"""


OP8_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(concat('d', coalesce(try_cast(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) % 3, 0)), chr(1)) AS domain,
    coalesce(lang, chr(1)) AS lang, coalesce(source, chr(1)) AS source,
    CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[ 	

]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM documents
),
docs AS (SELECT * FROM t WHERE n_tokens > 0),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS DOUBLE) AS tokens, CAST(sum(n_tokens) AS DOUBLE) * 4 AS room FROM docs GROUP BY ALL),
total AS (SELECT sum(tokens) * 0.5 AS given FROM leaf),
{_shared("lv1", "", "domain", "CASE domain WHEN 'd0' THEN 0.5 WHEN 'd1' THEN 0.3 WHEN 'd2' THEN 0.2 ELSE 0.1 END::DOUBLE", "total")},
{_shared("lv2", "domain", "lang", "CASE lang WHEN 'en' THEN 0.4 WHEN 'de' THEN 0.2 WHEN 'fr' THEN 0.2 WHEN 'es' THEN 0.2 ELSE 0.1 END::DOUBLE", "lv1")},
{_shared("lv3", "domain, lang", "source", "1.0::DOUBLE", "lv2")},
plan AS (
  SELECT domain, lang, source, CAST(floor(round(given, 6) / tokens) AS INT) AS epochs,
    floor(round(given, 6) - tokens * floor(round(given, 6) / tokens) + 1e-6) AS rest
  FROM lv3 JOIN leaf USING (domain, lang, source)
),
ordered AS (
  SELECT doc_id, domain, lang, source, n_tokens, epochs, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5(concat_ws(':', '1', epochs::VARCHAR, coalesce(doc_id::VARCHAR, ''))), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto
  FROM docs JOIN plan USING (domain, lang, source)
)
SELECT doc_id, nullif(domain, chr(1)) AS domain, nullif(lang, chr(1)) AS lang, nullif(source, chr(1)) AS source, n_tokens,
  CAST(unnest(range(0, epochs + (upto <= rest)::INT)) AS INT) AS epoch
FROM ordered
"""


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS e FROM d
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reach FROM n UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reach = e.x),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

OP4_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 100)) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM w JOIN f USING (s) WHERE doc_id > first),
k AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run),
x AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS upto FROM k),
t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, CAST(2 * upto + 1 AS BIGINT), CAST(2 * (a - upto) AS BIGINT)), '' ORDER BY a) AS "left" FROM x JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE "left" || substr(h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_duplicates": OP1_SQL, "op4_substring_dedup": OP4_SQL, "op8_mix_sources": OP8_SQL, "op5_decontaminate": OP5_SQL}
