"""Named queries over the driver's tables, and the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import identity, version
from ..functions import decode_key, encode_columns, mask_token, norm_key, norm_name, trigrams
from ..operators import benford, cross, duplicate, fuzzy, profile

#: Fixed secret of the masking query; a case has its own.
QUERY_SECRET = b"catalog"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _hist(spark, sf_dir, name, column) -> DataFrame:
    df = table(spark, sf_dir, name)
    return benford.digits(df, profile.as_number(df, column))


def benford_digits(spark, sf_dir):
    return _rounded(_hist(spark, sf_dir, "events", "value"))


def benford_summary(spark, sf_dir):
    return _rounded(benford.summary(_hist(spark, sf_dir, "events", "value")))


def benford_nonconform(spark, sf_dir):
    return _rounded(benford.summary(_hist(spark, sf_dir, "lineitem", "l_extendedprice")))


SUITABILITY = (("events", "value"), ("lineitem", "l_extendedprice"), ("lineitem", "l_quantity"), ("lineitem", "l_discount"), ("orders", "o_totalprice"), ("customer", "c_acctbal"), ("supplier", "s_acctbal"), ("part", "p_retailprice"), ("documents", "n_chars"))


def benford_suitability(spark, sf_dir):
    """The facts that Benford's guard is decided on, and its verdict, of nine columns as if confirmed as amounts."""
    rows, tables = [], {}
    for name, column in SUITABILITY:
        tables.setdefault(name, []).append(column)
    measured = {name: profile.facts_of(table(spark, sf_dir, name), columns, {"distinct", "top10_share"}) for name, columns in tables.items()}
    for name, column in SUITABILITY:
        f = measured[name][column]
        verdict = benford.RULES.assess(f | {"is_key": False, "sensitive": False, "unique": False, "words": ()})
        rows.append((f"{name}.{column}", f["nonzero"], round(f["span"], 6), round(f["nonpositive_share"], 6), round(f["top10_share"], 6), str(verdict.verdict), ",".join(sorted(verdict.reasons))))
    return spark.createDataFrame(rows, "column string, nonzero long, span double, nonpositive_share double, top10_share double, verdict string, reasons string")


def dup_keys(spark, sf_dir):
    return duplicate.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def dup_rows(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    rows = duplicate.flagged_rows(df, ["l_orderkey", "l_linenumber"], dup_keys(spark, sf_dir))
    return rows.groupBy(F.col("flag").alias("key")).agg(F.count("*").alias("n"), F.min("l_partkey").alias("min_part"), F.max("l_partkey").alias("max_part"))


def dup_text(spark, sf_dir):
    """Equal texts, under a digest in place of the text."""
    df = table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("digest"))
    return duplicate.duplicates(df, ["digest"])


def dup_blanks(spark, sf_dir):
    return duplicate.blanks(table(spark, sf_dir, "customer"), ["c_mktsegment"])


def shared_identifier(spark, sf_dir):
    return duplicate.shared(table(spark, sf_dir, "part"), "p_name", "p_brand")


def fuzzy_pairs(spark, sf_dir):
    return _rounded(fuzzy.similar_pairs(fuzzy.names_of(table(spark, sf_dir, "part"), "p_name")).select("a", "b", "similarity"))


def fuzzy_clusters(spark, sf_dir):
    return fuzzy.clusters(fuzzy.names_of(table(spark, sf_dir, "part"), "p_name")).select("name", "cluster")


def fuzzy_conflicts(spark, sf_dir):
    return fuzzy.conflicts(table(spark, sf_dir, "part"), "p_brand", "p_name")


def name_trigrams(spark, sf_dir):
    names = fuzzy.names_of(table(spark, sf_dir, "part"), "p_name")
    return names.select("name", F.size(trigrams(F.col("name"))).cast("long").alias("n"))


def cross_only_left(spark, sf_dir):
    return cross.only_left(table(spark, sf_dir, "orders"), ["o_orderkey"], table(spark, sf_dir, "lineitem"), ["l_orderkey"])


def cross_only_right(spark, sf_dir):
    return cross.only_left(table(spark, sf_dir, "labels"), ["doc_id"], table(spark, sf_dir, "documents"), ["doc_id"])


def cross_unlabelled(spark, sf_dir):
    return cross.only_left(table(spark, sf_dir, "documents"), ["doc_id"], table(spark, sf_dir, "labels"), ["doc_id"])


def cross_reconcile(spark, sf_dir):
    left, right = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return cross.reconcile(left, ["o_orderkey"], right, ["l_orderkey"], (F.col("o_totalprice"), F.col("l_extendedprice")))


def fingerprint(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.agg(version.fingerprint_of(F.concat_ws("|", *[F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_orderstatus")])).alias("fingerprint"))


def fingerprint_table(spark, sf_dir):
    """Of a whole table, typed cells as lengths and texts."""
    df = table(spark, sf_dir, "nation")
    return df.agg(version.fingerprint_of(version.row_text(df)).alias("fingerprint"))


IDENTITIES = (("orders", ["o_orderkey"]), ("customer", ["c_custkey"]), ("part", ["p_partkey"]), ("lineitem", ["l_orderkey", "l_linenumber"]), ("documents", ["doc_id"]), ("events", ["event_id"]))


def row_identity(spark, sf_dir):
    rows = []
    for name, keys in IDENTITIES:
        f = identity.key_facts(table(spark, sf_dir, name), keys)
        rows.append((name, f["rows"], f["distinct"], f["nulls"], f["nulls"] == 0 and f["rows"] == f["distinct"]))
    return spark.createDataFrame(rows, "`table` string, rows long, distinct long, nulls long, is_identity boolean")


def key_encoding(spark, sf_dir):
    """Composite keys as JSON text, and back."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    df = df.select(encode_columns(df, ["l_orderkey", "l_linenumber"]).alias("key"))
    return df.select("key", F.element_at(decode_key(F.col("key"), 2), 1).alias("first"), F.element_at(decode_key(F.col("key"), 2), 2).alias("second"))


def normalised_names(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return df.select("c_custkey", norm_key(F.col("c_name")).alias("key"), norm_name(F.col("c_name")).alias("name"))


def profile_orders(spark, sf_dir):
    return profile.profile_table(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"])


def profile_customer(spark, sf_dir):
    return profile.profile_table(table(spark, sf_dir, "customer"), ["c_custkey", "c_nationkey", "c_acctbal"])


def pattern_share(spark, sf_dir):
    return _rounded(profile.pattern_shares(table(spark, sf_dir, "customer"), "c_name"))


def top_values(spark, sf_dir):
    share = profile.top_share(table(spark, sf_dir, "lineitem"), "l_discount")
    return spark.createDataFrame([("lineitem.l_discount", round(share, 6))], "column string, top10_share double")


def mask_tokens(spark, sf_dir):
    df = table(spark, sf_dir, "supplier")
    return df.select("s_suppkey", mask_token(norm_key(F.col("s_name")), QUERY_SECRET).alias("token"))


def evidence_links(spark, sf_dir):
    """The rows behind duplicate order and line numbers, as encoded keys."""
    df = table(spark, sf_dir, "lineitem")
    rows = duplicate.flagged_rows(df, ["l_orderkey", "l_linenumber"], dup_keys(spark, sf_dir))
    return rows.select(encode_columns(rows, ["l_orderkey", "l_linenumber", "l_partkey"]).alias("key_value"))


def queries() -> dict:
    every = (
        benford_digits, benford_summary, benford_nonconform, benford_suitability, dup_keys, dup_rows, dup_text, dup_blanks, shared_identifier,
        fuzzy_pairs, fuzzy_clusters, fuzzy_conflicts, name_trigrams, cross_only_left, cross_only_right, cross_unlabelled, cross_reconcile,
        fingerprint, fingerprint_table, row_identity, key_encoding, normalised_names, profile_orders, profile_customer, pattern_share, top_values, mask_tokens, evidence_links,
    )
    return {f.__name__: f for f in every}


# --- the same in DuckDB's SQL ---------------------------------------------------


def _digits_sql(name: str, column: str) -> str:
    return f"""
d AS (SELECT TRY_CAST(regexp_extract(CAST(abs(CAST({column} AS DECIMAL(38,10))) AS VARCHAR), '[1-9]') AS INT) AS digit FROM {name}),
h AS (SELECT CAST(i AS INT) AS digit, (SELECT count(*) FROM d WHERE d.digit = i) AS n FROM range(1, 10) t(i)),
o AS (SELECT digit, n, n / (SELECT sum(n) FROM h) AS observed, log10(1 + 1.0 / digit) AS expected FROM h)"""


def _summary_sql(name: str, column: str) -> str:
    return f"""WITH {_digits_sql(name, column)},
s AS (SELECT CAST(sum(n) AS BIGINT) AS n, avg(abs(observed - expected)) AS mad,
  sum(n) * sum((observed - expected) * (observed - expected) / expected) AS chi2,
  arg_max(digit, round(abs(observed - expected), 12)) AS worst_digit FROM o)
SELECT n, round(mad, 6) AS mad, CASE WHEN mad <= 0.006 THEN 'close' WHEN mad <= 0.012 THEN 'acceptable' WHEN mad <= 0.015 THEN 'marginal' ELSE 'nonconforming' END AS band,
  round(chi2, 6) AS chi2, round(exp(-chi2 / 2) * (1 + chi2 / 2 + pow(chi2 / 2, 2) / 2 + pow(chi2 / 2, 3) / 6), 6) AS p_value, worst_digit FROM s"""


def _suitability_sql(name: str, column: str) -> str:
    return f"""SELECT '{name}.{column}' AS "column", nonzero, round(log10(hi / lo), 6) AS span, round(nonpositive / n, 6) AS nonpositive_share, round(top / n, 6) AS top10_share, distinct_n
FROM (SELECT count(x) AS n, count(*) FILTER (x <> 0) AS nonzero, CAST(count(*) FILTER (x <= 0) AS DOUBLE) AS nonpositive, CAST(max(abs(x)) AS DOUBLE) AS hi,
  CAST(min(abs(x)) FILTER (x <> 0) AS DOUBLE) AS lo, count(DISTINCT x) AS distinct_n FROM (SELECT CAST({column} AS DECIMAL(38,10)) AS x FROM {name})),
 (SELECT CAST(sum(c) AS DOUBLE) AS top FROM (SELECT count(*) AS c FROM {name} WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY c DESC LIMIT 10))"""


def _key_sql(*columns: str) -> str:
    parts = [f"upper(regexp_replace(CAST({c} AS VARCHAR), '[\\s\\-]+', '', 'g'))" for c in columns]
    return parts[0] if len(parts) == 1 else "'[\"' || " + " || '\",\"' || ".join(parts) + " || '\"]'"


def _name_sql(c: str) -> str:
    return f"trim(upper(regexp_replace({c}, '[\\s\\-]+', ' ', 'g')))"


def _trigrams_sql(c: str) -> str:
    word = "list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))"
    return f"list_distinct(flatten(list_transform(list_filter(string_split({c}, ' '), lambda w: w <> ''), lambda w: {word})))"


def _pairs_sql(scope: str = "''") -> str:
    return f"""n AS (SELECT DISTINCT {scope} AS scope, {_name_sql("p_name")} AS name FROM part),
g AS (SELECT *, {_trigrams_sql("name")} AS t FROM n),
p AS (SELECT x.scope, x.name AS a, y.name AS b, len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) AS similarity FROM g x JOIN g y ON x.scope = y.scope AND x.name < y.name)"""


def _clusters_sql(scope: str = "''") -> str:
    return f"""WITH RECURSIVE {_pairs_sql(scope)},
e AS (SELECT scope, a, b FROM p WHERE similarity >= 0.55 UNION ALL SELECT scope, b, a FROM p WHERE similarity >= 0.55),
r AS (SELECT scope, name, name AS reach FROM n UNION SELECT r.scope, r.name, e.b FROM r JOIN e ON r.scope = e.scope AND r.reach = e.a),
c AS (SELECT scope, name, min(reach) AS cluster FROM r GROUP BY scope, name)"""


def _only_sql(left: str, lk: str, right: str, rk: str) -> str:
    return f"SELECT CAST({lk} AS VARCHAR) AS key, count(*) AS n FROM {left} WHERE {lk} IS NOT NULL AND {lk} NOT IN (SELECT {rk} FROM {right} WHERE {rk} IS NOT NULL) GROUP BY 1"


def _print_sql(text: str, name: str) -> str:
    return f"SELECT 's56:' || count(*) || ':' || coalesce(CAST(sum(CAST(CAST('0x' || substr(sha256({text}), 1, 14) AS BIGINT) AS HUGEINT)) AS VARCHAR), '0') AS fingerprint FROM {name}"


def _profile_sql(name: str, columns: tuple[str, ...]) -> str:
    def one(c: str) -> str:
        return f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct, count(x) AS eligible,
 count(*) FILTER (x <> 0) AS nonzero, count(*) FILTER (x <= 0) AS nonpositive, count(*) FILTER (x = floor(x)) AS integers FROM (SELECT {c}, TRY_CAST({c} AS DECIMAL(38,10)) AS x FROM {name})"""

    return " UNION ALL ".join(map(one, columns))


def _token_sql(text: str) -> str:
    """Twelve letters from HMAC-SHA256 of a text."""
    inner, outer = ("".join(f"{b ^ pad:02x}" for b in QUERY_SECRET.ljust(64, b"\0")) for pad in (0x36, 0x5C))
    return f"translate(substr(sha256(unhex('{outer}' || sha256(unhex('{inner}' || hex(encode({text})))))), 1, 12), '0123456789', 'ghijklmnop')"


_LINE = ("l_orderkey", "l_linenumber")


def oracle_sql() -> dict[str, str]:
    line, cell = _key_sql(*_LINE), "coalesce(length(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
    dup = f"SELECT {line} AS key, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1"
    identities = " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", count(*) AS rows, count(DISTINCT ({', '.join(k)},)) AS distinct, count(*) FILTER ({' OR '.join(f'{c} IS NULL' for c in k)}) AS nulls,
 count(*) = count(DISTINCT ({', '.join(k)},)) AND count(*) FILTER ({' OR '.join(f'{c} IS NULL' for c in k)}) = 0 AS is_identity FROM {t}"""
        for t, k in IDENTITIES
    )
    suitability = " UNION ALL ".join(_suitability_sql(*x) for x in SUITABILITY)
    amounts = "CAST(sum(CAST({0} AS DECIMAL(38,4))) AS DECIMAL(38,4))"
    patterns = {k: p.replace("'", "''") for k, p in profile.PATTERNS.items()}
    return {
        "benford_digits": f"WITH {_digits_sql('events', 'value')} SELECT digit, n, round(observed, 6) AS observed, round(expected, 6) AS expected, round(observed - expected, 6) AS deviation FROM o",
        "benford_summary": _summary_sql("events", "value"),
        "benford_nonconform": _summary_sql("lineitem", "l_extendedprice"),
        "benford_suitability": f"""WITH f AS ({suitability}),
r AS (SELECT *, list_filter([CASE WHEN nonzero < 300 THEN 'TOO_FEW_VALUES' END, CASE WHEN distinct_n < 100 THEN 'FEW_DISTINCT' END, CASE WHEN span < 2 THEN 'NARROW_RANGE' END,
  CASE WHEN top10_share > 0.8 THEN 'FIXED_AMOUNTS' END, CASE WHEN nonpositive_share > 0.2 THEN 'MANY_NONPOSITIVE' END], lambda x: x IS NOT NULL) AS why FROM f)
SELECT "column", nonzero, span, nonpositive_share, top10_share,
  CASE WHEN list_contains(why, 'TOO_FEW_VALUES') THEN 'INSUFFICIENT_DATA' WHEN list_has_any(why, ['FEW_DISTINCT', 'NARROW_RANGE', 'FIXED_AMOUNTS']) THEN 'NOT_APPLICABLE'
    WHEN len(why) > 0 THEN 'SUPPORTED_WITH_WARNING' ELSE 'SUPPORTED' END AS verdict, array_to_string(list_sort(why), ',') AS reasons FROM r""",
        "dup_keys": dup,
        "dup_rows": f"SELECT {line} AS key, count(*) AS n, min(l_partkey) AS min_part, max(l_partkey) AS max_part FROM lineitem GROUP BY 1 HAVING count(*) > 1",
        "dup_text": "SELECT upper(md5(text)) AS key, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
        "dup_blanks": "SELECT count(*) FILTER (c_mktsegment IS NULL OR trim(c_mktsegment) = '') AS blank, count(*) AS rows FROM customer",
        "shared_identifier": f"SELECT {_key_sql('p_name')} AS key, count(DISTINCT {_name_sql('p_brand')}) AS n_values, count(*) AS n FROM part GROUP BY 1 HAVING count(DISTINCT {_name_sql('p_brand')}) > 1",
        "fuzzy_pairs": f"WITH {_pairs_sql()} SELECT a, b, round(similarity, 6) AS similarity FROM p WHERE similarity >= 0.55",
        "fuzzy_clusters": f"{_clusters_sql()} SELECT name, cluster FROM c",
        "fuzzy_conflicts": f"{_clusters_sql(_key_sql('p_brand'))} SELECT scope AS key, count(DISTINCT cluster) AS n_entities, count(*) AS n_names FROM c GROUP BY 1 HAVING count(DISTINCT cluster) > 1",
        "name_trigrams": f"SELECT DISTINCT {_name_sql('p_name')} AS name, CAST(len({_trigrams_sql(_name_sql('p_name'))}) AS BIGINT) AS n FROM part",
        "cross_only_left": _only_sql("orders", "o_orderkey", "lineitem", "l_orderkey"),
        "cross_only_right": _only_sql("labels", "doc_id", "documents", "doc_id"),
        "cross_unlabelled": _only_sql("documents", "doc_id", "labels", "doc_id"),
        "cross_reconcile": f"""WITH a AS (SELECT o_orderkey AS k, {amounts.format('o_totalprice')} AS l FROM orders GROUP BY 1), b AS (SELECT l_orderkey AS k, {amounts.format('l_extendedprice')} AS r FROM lineitem GROUP BY 1)
SELECT count(a.k) AS left_keys, count(b.k) AS right_keys, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS matched, count(*) FILTER (b.k IS NULL) AS only_left,
  count(*) FILTER (a.k IS NULL) AS only_right, count(*) FILTER (abs(l - r) > 0.01) AS differing FROM a FULL JOIN b ON a.k = b.k""",
        "fingerprint": _print_sql("concat_ws('|', o_orderkey, o_custkey, o_orderstatus)", "orders"),
        "fingerprint_table": _print_sql("concat_ws('|', " + ", ".join(cell.format(c) for c in ("n_nationkey", "n_name", "n_regionkey")) + ")", "nation"),
        "row_identity": identities,
        "key_encoding": "SELECT DISTINCT '[\"' || l_orderkey || '\",\"' || l_linenumber || '\"]' AS key, CAST(l_orderkey AS VARCHAR) AS first, CAST(l_linenumber AS VARCHAR) AS second FROM lineitem",
        "normalised_names": f"SELECT c_custkey, {_key_sql('c_name')} AS key, {_name_sql('c_name')} AS name FROM customer",
        "profile_orders": _profile_sql("orders", ("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")),
        "profile_customer": _profile_sql("customer", ("c_custkey", "c_nationkey", "c_acctbal")),
        "pattern_share": " UNION ALL ".join(f"SELECT '{k}' AS pattern, count(*) FILTER (regexp_matches(trim(c_name), '{p}')) AS matches, round(count(*) FILTER (regexp_matches(trim(c_name), '{p}')) / count(c_name), 6) AS share FROM customer" for k, p in patterns.items()),
        "top_values": "SELECT 'lineitem.l_discount' AS \"column\", round(sum(c) / (SELECT count(l_discount) FROM lineitem), 6) AS top10_share FROM (SELECT count(*) AS c FROM lineitem WHERE l_discount IS NOT NULL GROUP BY l_discount ORDER BY c DESC LIMIT 10)",
        "mask_tokens": f"SELECT s_suppkey, {_token_sql(_key_sql('s_name'))} AS token FROM supplier",
        "evidence_links": f"WITH f AS ({dup}) SELECT '[\"' || l_orderkey || '\",\"' || l_linenumber || '\",\"' || l_partkey || '\"]' AS key_value FROM lineitem WHERE {line} IN (SELECT key FROM f)",
    }
