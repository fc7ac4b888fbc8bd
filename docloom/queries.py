"""Queries over the driver's tables, one or several for each operator, each with the SQL that gives the same rows where SQL can.

Typed values, tables and predictions are made from the columns of the tables by fixed rules, the same in both languages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.checkpoints import spread
from docloom.functions import answers as A
from docloom.functions import json_repair as J
from docloom.functions import numeric as N
from docloom.functions import text as T
from docloom.operators import evaluation as E
from docloom.operators import mapping as M
from docloom.operators import neighbours as W
from docloom.operators import retrieval as R
from docloom.sources import tabular
from docloom.sources.documents import document_type, from_text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text2(c) -> F.Column:
    return c.cast("decimal(18,2)").cast("string")


# --- numbers ------------------------------------------------------------------------------------------------------

#: Ways in which a price is written, by the order's key.
FORMATS = ("{us}", "{eu}", "({us})", "-{plain}", "{plain} USD", "${us}", "{us} or {plain}", "n/a", "{comma}", "{pct}%")


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"))
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    whole, part = F.floor(cents / 100).cast("bigint"), F.lpad((cents % 100).cast("string"), 2, "0")
    thousands = F.when(whole >= 1000, F.concat(F.floor(whole / 1000).cast("bigint").cast("string"), F.lit("{s}"), F.lpad((whole % 1000).cast("string"), 3, "0"))).otherwise(whole.cast("string"))
    us = F.concat(F.replace(thousands, F.lit("{s}"), F.lit(",")), F.lit("."), part)
    eu = F.concat(F.replace(thousands, F.lit("{s}"), F.lit(".")), F.lit(","), part)
    plain = F.concat(whole.cast("string"), F.lit("."), part)
    k = F.pmod("o_orderkey", F.lit(10))
    raw = (
        F.when(k == 0, us).when(k == 1, eu).when(k == 2, F.concat(F.lit("("), us, F.lit(")"))).when(k == 3, F.concat(F.lit("-"), plain)).when(k == 4, F.concat(plain, F.lit(" USD")))
        .when(k == 5, F.concat(F.lit("$"), us)).when(k == 6, F.concat(us, F.lit(" or "), plain)).when(k == 7, F.lit("n/a")).when(k == 8, F.replace(plain, F.lit("."), F.lit(","))).otherwise(F.concat(part, F.lit("."), part, F.lit("%")))
    )
    return o.select("o_orderkey", raw.alias("raw"))


WRITTEN = """
w AS (SELECT o_orderkey, c // 100 AS whole, lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS part FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)),
v AS (SELECT o_orderkey, part, CASE WHEN whole >= 1000 THEN (whole // 1000) || ',' || lpad(CAST(whole % 1000 AS VARCHAR), 3, '0') ELSE CAST(whole AS VARCHAR) END AS t, whole || '.' || part AS plain FROM w),
written AS (SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN t || '.' || part WHEN 1 THEN replace(t, ',', '.') || ',' || part WHEN 2 THEN '(' || t || '.' || part || ')' WHEN 3 THEN '-' || plain WHEN 4 THEN plain || ' USD'
  WHEN 5 THEN '$' || t || '.' || part WHEN 6 THEN t || '.' || part || ' or ' || plain WHEN 7 THEN 'n/a' WHEN 8 THEN replace(plain, '.', ',') ELSE part || '.' || part || '%' END AS raw FROM v)"""


def sql_number(s: str) -> str:
    """The signed number of a text, as DECIMAL(38,10)."""
    bare = f"regexp_replace({s}, '[^0-9.,]', '', 'g')"
    plain = f"replace(CASE WHEN regexp_matches({bare}, '\\b[0-9]{{1,3}},[0-9]{{3}}\\b') THEN replace({bare}, ',', '') WHEN regexp_matches({bare}, '\\b[0-9]{{1,3}}[.][0-9]{{3}}[.,][0-9]') THEN replace({bare}, '.', '') ELSE {bare} END, ',', '.')"
    value = f"CASE WHEN regexp_matches({plain}, '^[0-9]*[.]?[0-9]*$') AND regexp_matches({plain}, '[0-9]') THEN TRY_CAST({plain} AS DECIMAL(38,10)) END"
    negative = f"(regexp_matches({s}, '[-‒–—―−]') OR regexp_matches({s}, '\\([0-9 %.,]+(\\)|\\b)'))"
    return f"(CASE WHEN trim({s}) = '' THEN NULL WHEN {negative} THEN -({value}) ELSE {value} END)"


def sql_last(s: str) -> str:
    return f"list_last(list_filter(list_transform(regexp_extract_all({s}, '[0-9](?:[0-9.,]*[0-9])?'), lambda x: {sql_number('x')}), lambda x: x IS NOT NULL))"


@query(f"WITH {WRITTEN} SELECT o_orderkey, raw, CAST(CAST({sql_number('raw')} AS DECIMAL(18,2)) AS VARCHAR) AS number FROM written")
def clean_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir).select("o_orderkey", "raw", text2(N.clean_number(F.col("raw"))).alias("number"))


@query(f"WITH {WRITTEN} SELECT o_orderkey, CAST(CAST({sql_last('raw')} AS DECIMAL(18,2)) AS VARCHAR) AS number FROM written")
def last_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir).select("o_orderkey", text2(N.last_number(F.col("raw"))).alias("number"))


@query(f"""WITH {WRITTEN}, p AS (SELECT o_orderkey, raw, {sql_last('raw')} AS x FROM written)
SELECT o_orderkey, coalesce(CAST(CAST(floor(x) AS BIGINT) AS VARCHAR), 'n/a') AS as_int, x IS NOT NULL AS int_ok,
  CAST(CAST(x AS DECIMAL(18,2)) AS VARCHAR) AS as_numeric, CAST(CAST(CASE WHEN contains(raw, '%') OR x > 1 THEN x ELSE x * 100 END AS DECIMAL(18,2)) AS VARCHAR) AS as_percent FROM p""")
def number_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _written(spark, sf_dir).select("o_orderkey", *(A.parse_typed(k, F.col("raw")).alias(k) for k in ("int", "numeric", "percentage")))
    num = lambda c: text2(F.replace(F.col(c), F.lit("%"), F.lit("")).try_cast("double"))
    return rows.select("o_orderkey", F.col("int.value").alias("as_int"), F.col("int.ok").alias("int_ok"), num("numeric.value").alias("as_numeric"), num("percentage.value").alias("as_percent"))


@query("""SELECT l_orderkey, l_linenumber, regexp_matches(regexp_replace(c, '\\([^0-9 ]*\\)|[^/a-zA-Z0-9]', '', 'g'), '^[0-9]+$') AS is_number, regexp_matches(c, '\\b(20[0-2][0-9]|1[0-9]{3})\\b') AS is_year FROM
(SELECT l_orderkey, l_linenumber, CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 1 THEN strftime(l_shipdate, '%Y') WHEN 2 THEN CAST(l_quantity::BIGINT AS VARCHAR) || ' (net)' WHEN 3 THEN l_returnflag || l_linenumber ELSE CAST(l_partkey AS VARCHAR) || '/' || l_suppkey END AS c FROM lineitem)""")
def number_and_year_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "lineitem")
    k = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(5))
    c = F.when(k == 0, F.date_format("l_shipdate", "yyyy-MM-dd")).when(k == 1, F.date_format("l_shipdate", "yyyy")).when(k == 2, F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit(" (net)"))).when(k == 3, F.concat("l_returnflag", F.col("l_linenumber").cast("string"))).otherwise(F.concat(F.col("l_partkey").cast("string"), F.lit("/"), F.col("l_suppkey").cast("string")))
    return x.select("l_orderkey", "l_linenumber", N.is_number_cell(c).alias("is_number"), N.is_year_cell(c).alias("is_year"))


@query("""SELECT l_orderkey, l_linenumber, CAST(coalesce(TRY_CAST(rtrim(regexp_replace(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), '[^0-9]', '', 'g'), '0') AS BIGINT), 0) AS BIGINT) AS match_key,
CAST(regexp_replace('LI' || l_linenumber || l_returnflag, '[^0-9]', '', 'g') AS BIGINT) AS row_number FROM lineitem""")
def match_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "lineitem")
    return x.select("l_orderkey", "l_linenumber", N.match_key(text2(F.col("l_extendedprice"))).cast("bigint").alias("match_key"), N.digits_int(F.concat(F.lit("LI"), F.col("l_linenumber").cast("string"), "l_returnflag")).cast("bigint").alias("row_number"))


@query("SELECT l_suppkey, CAST(round(avg(abs(l_extendedprice)), 4) AS DECIMAL(18,2))::VARCHAR AS mean FROM lineitem GROUP BY l_suppkey")
def column_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices are decimals, so that no mean depends on the order in which they are added up."""
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(text2(F.round(N.mean_abs(F.col("l_extendedprice").cast(N.DECIMAL)), 4)).alias("mean"))


# --- texts --------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(text, '[^%$£€¥0-9a-zA-Z]', ' ', 'g'), ' '), lambda w: w <> '')) AS BIGINT) AS n_words, sha256(trim(regexp_replace(text, ' +', ' ', 'g'), ' ')) AS spaced FROM documents""")
def words_and_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.size(T.words(F.col("text"))).cast("bigint").alias("n_words"), F.sha2(T.clean_spaces(F.col("text")), 256).alias("spaced"))


@query("""WITH c AS (SELECT doc_id, length(regexp_replace(text, '[^0-9a-zA-Z]', '', 'g')) AS a, length(regexp_replace(text, '[^0-9]', '', 'g')) AS d, length(regexp_replace(text, '[ 0-9a-zA-Z]', '', 'g')) AS s, length(text) AS n FROM documents)
SELECT doc_id, CASE WHEN a > 0 THEN round(d / a, 9) ELSE 0.0 END AS numbers, CASE WHEN a > 0 THEN round((a - d) / a, 9) ELSE 0.0 END AS text, CASE WHEN a > 0 THEN round(s / n, 9) ELSE 0.0 END AS special FROM c""")
def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "documents").select("doc_id", T.composition(F.col("text")).alias("c"))
    return c.select("doc_id", *(F.round(f"c.{k}", 9).alias(k) for k in ("numbers", "text", "special")))


@query("""WITH x AS (SELECT o_orderkey, regexp_replace(replace(lower('Total of ' || o_orderpriority || ': 1,234.50 in ' || strftime(o_orderdate, '%Y') || '; (net)'), chr(10), ' '), '\\b(?:(?:[0-9]{1,3}[.,])+[0-9]+|[0-9]+[.,][0-9]+)\\b', ' xnumberx ', 'g') AS t FROM orders),
y AS (SELECT o_orderkey, regexp_replace(t, '([^a-zA-Z0-9 ])', ' \\1 ', 'g') AS t FROM x),
z AS (SELECT o_orderkey, replace(replace(replace(replace(replace(replace(replace(t, '1993', ' xbaseyearm3x '), '1994', ' xbaseyearm2x '), '1995', ' xbaseyearm1x '), '1996', ' xbaseyearm0x '), '1997', ' xbaseyearp1x '), '1998', ' xbaseyearp2x '), '1999', ' xbaseyearp3x ') AS t FROM y)
SELECT o_orderkey, trim(regexp_replace(regexp_replace(t, '\\b[0-9]+\\b', ' xnumberx ', 'g'), ' +', ' ', 'g'), ' ') AS cleaned FROM z""")
def clean_for_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    t = F.concat(F.lit("Total of "), "o_orderpriority", F.lit(": 1,234.50 in "), F.date_format("o_orderdate", "yyyy"), F.lit("; (net)"))
    return o.select("o_orderkey", T.clean_for_vectors(t, 1996, drop_special=True, drop_numbers=True).alias("cleaned"))


@query("""SELECT c_custkey, 'Customer ' || c_custkey AS as_entity, CASE WHEN c_custkey % 4 = 0 THEN 'n/a' ELSE '1995-02-3' || (c_custkey % 10) END AS as_date, c_custkey % 4 <> 0 AS date_ok FROM customer""")
def entity_and_date_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("string")
    named = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("The buyer is: Customer "), k, F.lit("."))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("Buyers are Customer "), k)).otherwise(F.concat(F.lit(" Customer "), k, F.lit(". ")))
    dated = F.when(F.col("c_custkey") % 4 == 0, F.lit("in 1995")).otherwise(F.concat(F.lit("due 1995-02-3"), (F.col("c_custkey") % 10).cast("string"), F.lit(" or 1996-01-01")))
    x = c.select("c_custkey", A.parse_typed("entity", named).alias("e"), A.parse_typed("date", dated).alias("d"))
    return x.select("c_custkey", F.col("e.value").alias("as_entity"), F.col("d.value").alias("as_date"), F.col("d.ok").alias("date_ok"))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "Household")


@query("""WITH x AS (SELECT c_custkey, c_mktsegment AS s FROM customer)
SELECT c_custkey, CASE WHEN s = 'AUTOMOBILE' THEN 'AUTOMOBILE' WHEN s = 'BUILDING' THEN 'BUILDING' WHEN s = 'HOUSEHOLD' THEN 'Household' ELSE 'none' END AS as_list, s IN ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD') AS list_ok,
  CASE WHEN s IN ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD') THEN lower(s) || ' | building' ELSE 'building' END AS as_multi FROM x""")
def list_and_multi_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    values = F.array(*map(F.lit, SEGMENTS))
    k = F.col("c_custkey") % 3
    said = F.when(k == 0, F.concat(F.lit("I think $ "), F.lower("c_mktsegment"), F.lit(" $ it is"))).when(k == 1, F.concat(F.lit("It is "), F.initcap("c_mktsegment"), F.lit("."))).otherwise(F.col("c_mktsegment"))
    many = F.concat(F.lit("["), F.initcap("c_mktsegment"), F.lit(" | Building|other ]"))
    x = c.select("c_custkey", A.parse_typed("list", said, values, "none").alias("l"), A.parse_typed("multi", many, values).alias("m"))
    return x.select("c_custkey", F.col("l.value").alias("as_list"), F.col("l.ok").alias("list_ok"), F.col("m.value").alias("as_multi"))


@query("""SELECT sha256(text) AS source_identifier, 'text' AS source_type, CAST(0 AS BIGINT) AS element_index, 'text' AS el_type, CAST(length(text) AS BIGINT) AS n FROM documents""")
def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_text(read(spark, sf_dir, "documents")).select("source_identifier", "source_type", F.col("element_index").cast("bigint").alias("element_index"), "el_type", F.length("text").cast("bigint").alias("n"))


@query("""SELECT c_custkey, CASE WHEN lower(e) IN ('pdf', 'png', 'jpg', 'jpeg') THEN 'pdf' WHEN lower(e) IN ('html', 'xml') THEN 'html' WHEN lower(e) IN ('xlsx', 'xls', 'csv') THEN 'tabular' ELSE 'other' END AS source_type
FROM (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'PDF' WHEN 1 THEN 'html' WHEN 2 THEN 'csv' WHEN 3 THEN 'Xls' WHEN 4 THEN 'txt' WHEN 5 THEN 'jpeg' ELSE '' END AS e FROM customer)""")
def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, (".PDF", ".html", ".csv", ".Xls", ".txt", ".jpeg", ""))), (F.col("c_custkey") % 7 + 1).cast("int"))
    return read(spark, sf_dir, "customer").select("c_custkey", document_type(F.concat(F.lit("/a.b/"), "c_name", ext)).alias("source_type"))


@query("""WITH c AS (SELECT doc_id, length(text) - length(replace(text, ',', '')) AS a, length(text) - length(replace(text, ';', '')) AS b FROM documents)
SELECT doc_id, CASE WHEN a > b THEN ',' ELSE ';' END AS delim, round(greatest(a, b) / greatest(a + b, 1), 9) AS share, CAST(a + b AS BIGINT) AS total FROM c""")
def csv_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "documents").select("doc_id", tabular.delimiter(F.col("text")).alias("d"))
    return x.select("doc_id", F.col("d.delim").alias("delim"), F.round("d.share", 9).alias("share"), F.col("d.total").cast("bigint").alias("total"))


@query("""SELECT o_orderkey, 'a:' || o_orderstatus || '_b:' || strftime(o_orderdate, '%Y') AS key, 'b:' || strftime(o_orderdate, '%Y') AS short_key FROM orders""")
def meta_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lambda i, v: F.struct(F.lit(i).alias("class_id"), v.alias("class_value"))
    meta = F.array(m("b", F.date_format("o_orderdate", "yyyy")), m("a", F.col("o_orderstatus")))
    return read(spark, sf_dir, "orders").select("o_orderkey", T.meta_key(meta).alias("key"), T.meta_key(meta, ["a"]).alias("short_key"))


# --- JSON ---------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 100 END AS BIGINT) AS first_item FROM events""")
def find_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    reply = F.concat(F.lit("Sure: ```json\n"), "props", F.lit("\n``` done"))
    listed = F.when(F.col("event_id") % 5 == 0, F.lit("none [1, 2")).otherwise(F.concat(F.lit("rows ["), (F.col("event_id") % 100).cast("string"), F.lit(", 7] and [3]")))
    return e.select("event_id", F.get_json_object(J.find_dict(reply), "$.k").cast("bigint").alias("k"), F.get(J.items(J.find_array(listed)), F.lit(0)).cast("bigint").alias("first_item"))


@query("""WITH u AS (SELECT user_id, event_id, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT user_id, CAST(2 * count(*) - count(*) FILTER (WHERE event_id % 3 = 2) AS BIGINT) AS n_objects, CAST(sum(k) + sum(CASE WHEN event_id % 3 = 2 THEN 0 ELSE event_id END) AS BIGINT) AS total FROM u GROUP BY user_id""")
def merge_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that are good arrays, arrays whose bracket is missing, or single objects, merged by user."""
    e = read(spark, sf_dir, "events")
    second = F.concat(F.lit('{"k": '), F.col("event_id").cast("string"), F.lit("}"))
    k = F.col("event_id") % 3
    reply = F.when(k == 0, F.concat(F.lit("```json\n["), "props", F.lit(", "), second, F.lit("]\n```"))).when(k == 1, F.concat(F.col("props"), F.lit(",\n "), second, F.lit("]"))).otherwise(F.col("props"))
    by_user = e.select("user_id", "event_id", reply.alias("reply")).groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "reply"))), lambda x: x["reply"]).alias("r"))
    merged = by_user.select("user_id", F.from_json(J.merge_objects(F.col("r")), F.lit("array<struct<k:bigint>>")).alias("o"))
    return merged.select("user_id", F.size("o").cast("bigint").alias("n_objects"), F.aggregate("o", F.lit(0).cast("bigint"), lambda s, x: s + x["k"]).alias("total"))


@query("""WITH u AS (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT user_id, CAST(arg_max(k, event_id) AS BIGINT) AS last_k, CAST(max(event_id) AS BIGINT) AS last_e FROM u GROUP BY user_id""")
def merge_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    reply = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "e": '), F.col("event_id").cast("string"), F.lit("}"))
    by_user = e.select("user_id", "event_id", reply.alias("reply")).groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "reply"))), lambda x: x["reply"]).alias("r"))
    one = by_user.select("user_id", J.merge_pieces(F.col("r")).alias("m"))
    return one.select("user_id", F.get_json_object("m", "$.k").cast("bigint").alias("last_k"), F.get_json_object("m", "$.e").cast("bigint").alias("last_e"))


# --- elements in order --------------------------------------------------------------------------------------------


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, turns as elements; some are tables or figures, by their length."""
    n = F.length("text")
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("source_identifier"), F.col("turn").cast("int").alias("element_index"), F.when(n % 5 == 0, "table").when(n % 7 == 0, "figure").otherwise("text").alias("el_type"), "text", F.concat(F.lit("table: "), "text").alias("text_simple"))


ELEMENTS = "e AS (SELECT CAST(conv_id AS VARCHAR) AS source_identifier, CAST(turn AS BIGINT) AS element_index, CASE WHEN length(text) % 5 = 0 THEN 'table' WHEN length(text) % 7 = 0 THEN 'figure' ELSE 'text' END AS el_type, text FROM conversations)"
_long = lambda df: df.withColumn("element_index", F.col("element_index").cast("bigint"))


@query(f"""WITH {ELEMENTS} SELECT a.source_identifier, a.element_index AS a, b.element_index AS b,
CAST(coalesce((SELECT sum(length(c.text)) FROM e c WHERE c.source_identifier = a.source_identifier AND c.element_index > a.element_index AND c.element_index < b.element_index AND c.el_type = 'text'), 0) AS BIGINT) AS distance
FROM e a JOIN e b ON a.source_identifier = b.source_identifier AND a.element_index < b.element_index""")
def text_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _elements(spark, sf_dir)
    x, y = e.select("source_identifier", F.col("element_index").alias("a")), e.select("source_identifier", F.col("element_index").alias("b"))
    pairs = x.join(y, "source_identifier").where("a < b")
    out = W.distances(e, pairs)
    return out.select("source_identifier", F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), F.col("distance").cast("bigint").alias("distance"))


@query(f"""WITH {ELEMENTS}, s AS (SELECT *, (SELECT max(c.element_index) FROM e c WHERE c.source_identifier = e.source_identifier AND c.element_index < e.element_index AND c.el_type <> 'text') AS stop FROM e),
t AS (SELECT *, coalesce((SELECT string_agg(c.text || ' ', '' ORDER BY c.element_index) FROM e c WHERE c.source_identifier = s.source_identifier AND c.element_index > s.stop AND c.element_index < s.element_index), '') AS x FROM s)
SELECT source_identifier, element_index, CASE WHEN stop IS NOT NULL AND length(x) < 500 THEN x END AS text_before FROM t""")
def texts_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(W.text_before(_elements(spark, sf_dir), 500).select("source_identifier", "element_index", "text_before"))


_CLEAN = "list_filter(string_split(regexp_replace(text, '[^%$£€¥0-9a-zA-Z]', ' ', 'g'), ' '), lambda w: w <> '')"


@query(f"""WITH {ELEMENTS}, n AS (SELECT source_identifier, element_index, el_type, CASE WHEN el_type = 'text' THEN length(text) % 30 ELSE 0 END AS n, trim(repeat('w' || element_index || ' ', CAST(length(text) % 30 AS INTEGER))) AS t FROM e),
p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source_identifier ORDER BY element_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM n)
SELECT a.source_identifier, a.element_index, trim(coalesce(string_agg(b.t, ' ' ORDER BY b.element_index DESC) FILTER (WHERE b.element_index < a.element_index AND a.pos - b.pos - b.n < 50), '')) AS text_before,
  trim(coalesce(string_agg(b.t, ' ' ORDER BY b.element_index DESC) FILTER (WHERE b.element_index > a.element_index AND b.pos - a.pos - a.n < 50), '')) AS text_after
FROM p a LEFT JOIN p b ON a.source_identifier = b.source_identifier AND b.el_type = 'text' GROUP BY 1, 2""")
def words_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts on each side until they have 50 words; texts of up to 29 words, made from the turns' lengths."""
    text = F.trim(F.repeat(F.concat(F.lit("w"), F.col("element_index").cast("string"), F.lit(" ")), F.length("text") % 30))
    return _long(W.words_around(_elements(spark, sf_dir).withColumn("text", text)).select("source_identifier", "element_index", "text_before", "text_after"))


def _around(side: str, k: int) -> str:
    """Columns of the k-th table on a side."""
    at = f"{'before' if side == 'before' else 'NOT before'} AND k = {k}"
    alnum = "length(regexp_replace(ttext, '[^0-9a-zA-Z]', '', 'g'))"
    columns = {
        "text_distance": f"CAST(coalesce(max(CASE WHEN {at} THEN {'pos - tpos' if side == 'before' else 'tpos - pos - own'} END), 0) AS BIGINT)",
        "num_words": f"CAST(coalesce(max(CASE WHEN {at} THEN len({_CLEAN.replace('text,', 'ttext,')}) END), 0) AS BIGINT)",
        "percent_numbers": f"round(coalesce(max(CASE WHEN {at} AND {alnum} > 0 THEN length(regexp_replace(ttext, '[^0-9]', '', 'g')) / {alnum} END), 0), 9)",
        "text_simple": f"coalesce(max(CASE WHEN {at} THEN 'table: ' || ttext END), '')",
    }
    return ", ".join(f"{sql} AS {name}_{side}_{k}" for name, sql in columns.items())


_AROUND = ", ".join(_around(side, k) for side in ("before", "after") for k in (1, 2, 3))


@query(f"""WITH {ELEMENTS}, p AS (SELECT *, coalesce(sum(CASE WHEN el_type = 'text' THEN length(text) ELSE 0 END) OVER (PARTITION BY source_identifier ORDER BY element_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, CASE WHEN el_type = 'text' THEN length(text) ELSE 0 END AS own FROM e),
r AS (SELECT a.source_identifier, a.element_index, a.pos, a.own, b.pos AS tpos, b.text AS ttext, b.element_index < a.element_index AS before, row_number() OVER (PARTITION BY a.source_identifier, a.element_index, b.element_index < a.element_index ORDER BY abs(b.element_index - a.element_index)) AS k
  FROM p a JOIN p b ON a.source_identifier = b.source_identifier AND b.el_type = 'table' AND b.element_index <> a.element_index)
SELECT e.source_identifier, e.element_index, {_AROUND} FROM e LEFT JOIN r USING (source_identifier, element_index) GROUP BY ALL""")
def tables_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances, words, shares of digits and texts of the next three tables on both sides."""
    out = W.tables_around(_elements(spark, sf_dir))
    whole, share, text = ("text_distance", "num_words"), "percent_numbers", "text_simple"
    cols = [c for side in ("before", "after") for k in (1, 2, 3) for c in (*(F.col(f"{n}_{side}_{k}").cast("bigint").alias(f"{n}_{side}_{k}") for n in whole), F.round(f"{share}_{side}_{k}", 9).alias(f"{share}_{side}_{k}"), F.col(f"{text}_{side}_{k}"))]
    return _long(out.select("source_identifier", "element_index", *cols))


@query(f"""WITH {ELEMENTS} SELECT source_identifier, string_agg('[chunk ' || element_index || '] ' || text, chr(10) ORDER BY element_index) AS content FROM e GROUP BY source_identifier""")
def document_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.to_string(_elements(spark, sf_dir), True)


@query(f"""WITH {ELEMENTS}, s AS (SELECT *, (SELECT max(c.element_index) FROM e c WHERE c.source_identifier = e.source_identifier AND c.element_index < e.element_index AND c.element_index >= e.element_index - 3 AND c.el_type = 'table') AS stop FROM e)
SELECT source_identifier, element_index, CASE WHEN el_type = 'table' THEN 'Table element - Text before table: ' || coalesce((SELECT string_agg(c.text, chr(10) ORDER BY c.element_index) FROM e c WHERE c.source_identifier = s.source_identifier AND c.element_index < s.element_index AND c.element_index >= s.element_index - 3 AND c.element_index > coalesce(s.stop, -1)), '') || '; ' || text ELSE text END AS llm_text FROM s""")
def surrounding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(W.surrounding_text(_elements(spark, sf_dir)).select("source_identifier", "element_index", "llm_text"))


@query(f"""WITH RECURSIVE {ELEMENTS}, o AS (SELECT source_identifier, element_index, length(text) AS n, row_number() OVER (PARTITION BY source_identifier ORDER BY element_index) AS k FROM e WHERE el_type = 'text'),
w AS (SELECT source_identifier, element_index, k, n AS size, 1 AS chunk, n > 1000 AS closed FROM o WHERE k = 1
  UNION ALL SELECT o.source_identifier, o.element_index, o.k, CASE WHEN w.closed THEN o.n ELSE w.size + o.n END, CASE WHEN w.closed THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.closed THEN o.n ELSE w.size + o.n END > 1000 FROM w JOIN o ON o.source_identifier = w.source_identifier AND o.k = w.k + 1)
SELECT source_identifier, CAST(min(element_index) AS BIGINT) AS first_element, CAST(count(*) AS BIGINT) AS n_elements FROM w GROUP BY source_identifier, chunk
UNION ALL SELECT source_identifier, element_index, 1 FROM e WHERE el_type = 'table'""")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = W.chunks(_elements(spark, sf_dir))
    return c.select("source_identifier", F.array_min("elements").cast("bigint").alias("first_element"), F.size("elements").cast("bigint").alias("n_elements"))


@query(f"""WITH {ELEMENTS} SELECT a.source_identifier, a.element_index, (SELECT CAST(b.element_index AS BIGINT) FROM e b WHERE b.source_identifier = a.source_identifier AND b.el_type = 'table' AND b.element_index <> a.element_index ORDER BY abs(b.element_index - a.element_index), b.element_index LIMIT 1) AS nearest_table FROM e a""")
def nearest_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(W.nearest_table(_elements(spark, sf_dir)).select("source_identifier", "element_index", F.col("nearest_table").cast("bigint").alias("nearest_table")))


@query(f"""WITH {ELEMENTS}, r AS (SELECT source_identifier, CASE WHEN CAST(source_identifier AS BIGINT) % 3 = 0 THEN NULL ELSE element_index END AS i FROM e WHERE el_type <> 'figure')
SELECT source_identifier, element_index FROM e WHERE EXISTS (SELECT 1 FROM r WHERE r.source_identifier = e.source_identifier AND (r.i IS NULL OR r.i = e.element_index)) AND element_index < 4""")
def allowed_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _elements(spark, sf_dir)
    refs = e.where("el_type <> 'figure'").select("source_identifier", F.when(F.col("source_identifier").cast("bigint") % 3 != 0, F.col("element_index")).alias("element_index"))
    return _long(W.allowed(W.capped(e, 4), refs).select("source_identifier", "element_index"))


# --- joins and aggregates -----------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 6) AS s, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) AS x FROM embeddings, q)
SELECT query_id, vec_id, s AS similarity, CAST(k AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 9) DESC, vec_id) AS k FROM s) WHERE k <= 10""")
def topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a query; the ten nearest are what is asked for."""
    v = spread(read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")))
    q = v.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"))
    return R.nearest(v, q, 10).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


@query("""SELECT o_custkey AS table_id, 'b' || (o_orderkey % 4) AS bucket_id, CAST(CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice::DECIMAL(18,2) END) AS DECIMAL(18,2)) AS VARCHAR) AS value FROM orders GROUP BY 1, 2""")
def bucket_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("table_id"), F.col("o_orderkey").alias("li_idx"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("decimal(18,2)")).alias("value"))
    m = o.select("table_id", "li_idx", F.concat(F.lit("b"), (F.col("li_idx") % 4).cast("string")).alias("bucket_id"))
    return M.buckets(o, m).select("table_id", "bucket_id", text2(F.col("value")).alias("value"))


@query("""SELECT o_custkey AS table_id, o_orderkey AS li_idx, CASE WHEN o_orderstatus = 'F' THEN '[NOT_SPECIFIED]' ELSE 'b' || (o_orderkey % 4) END AS bucket_id FROM orders""")
def bucket_unclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of finished orders are in no bucket."""
    items = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("table_id"), F.col("o_orderkey").alias("li_idx"), "o_orderstatus")
    chosen = items.where("o_orderstatus <> 'F'").select("table_id", "li_idx", F.concat(F.lit("b"), (F.col("li_idx") % 4).cast("string")).alias("bucket_id"))
    return M.with_unclassified(items.drop("o_orderstatus"), chosen)


@query("""WITH s AS (SELECT n_regionkey AS r, n_nationkey AS n, CAST(sum(s_acctbal::DECIMAL(18,2)) AS DECIMAL(18,2)) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)
SELECT 'n' || n AS bucket_id, CAST(v AS VARCHAR) AS value FROM s UNION ALL SELECT 'r' || r, CAST(CAST(sum(v) AS DECIMAL(18,2)) AS VARCHAR) FROM s GROUP BY r""")
def bucket_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    sums = s.groupBy(F.lit(1).alias("table_id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("bucket_id")).agg(F.sum(F.col("s_acctbal").cast("decimal(18,2)")).alias("value"))
    schema = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("bucket_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"))
    return M.roll_up(sums, schema, 2).select("bucket_id", text2(F.col("value")).alias("value"))


@query("""SELECT o_custkey, 'status ' || o_orderstatus AS line_item, """ + ", ".join(f"CAST(CAST(sum(o_totalprice::DECIMAL(18,2)) FILTER (WHERE year(o_orderdate) = {y}) AS DECIMAL(18,2)) AS VARCHAR) AS y{y}" for y in range(1992, 2000)) + " FROM orders GROUP BY 1, 2")
def table_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    long = o.groupBy("o_custkey", "o_orderstatus", F.year("o_orderdate").alias("y")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("value"))
    long = long.select("o_custkey", F.col("o_orderstatus").alias("li_idx"), F.concat(F.lit("status "), "o_orderstatus").alias("line_item"), F.concat(F.lit("y"), F.col("y").cast("string")).alias("name"), F.col("y").alias("pos"), "value")
    names = [f"y{y}" for y in range(1992, 2000)]
    return M.pivot(long, ["o_custkey"], names).select("o_custkey", "line_item", *(text2(F.col(n)).alias(n) for n in names))


@query("""WITH c AS (SELECT l_orderkey, sha256(string_agg((l_linenumber - 1) || ': ' || l_returnflag, ', ' ORDER BY l_linenumber)) AS li, count(*) AS n FROM (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag) AS l_linenumber FROM lineitem) GROUP BY l_orderkey)
SELECT li AS li_identifier, CAST(count(*) AS BIGINT) AS n_columns, CAST(min(n) AS BIGINT) AS n_items FROM c GROUP BY li""")
def tables_from_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "lineitem").withColumn("_k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag")))
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("_k", "l_returnflag", "l_quantity"))), lambda p: F.struct(p["l_returnflag"].alias("line_item"), p["l_quantity"].alias("value")))
    cols = x.groupBy(F.col("l_orderkey").alias("pos")).agg(pairs.alias("pairs"))
    cols = cols.select("pos", "pairs", F.lit("t").alias("detected_class"), F.concat(F.lit("col"), F.col("pos").cast("string")).alias("name"), M.li_identifier(F.transform("pairs", lambda p: p["line_item"])).alias("li_identifier"))
    out = M.tables_from_columns(cols)
    return out.select("li_identifier", F.size("columns").cast("bigint").alias("n_columns"), F.size("line_items").cast("bigint").alias("n_items"))


@query("""WITH a AS (SELECT DISTINCT l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS k FROM lineitem)
SELECT a.l_suppkey AS id_a, b.l_suppkey AS id_b, CAST(count(*) AS BIGINT) AS common FROM a JOIN a b USING (k) WHERE a.l_suppkey < b.l_suppkey GROUP BY 1, 2""")
def number_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every two suppliers the prices that both have."""
    x = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.collect_set(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("keys"))
    return M.number_overlap(x).select("id_a", "id_b", F.col("common").cast("bigint").alias("common"))


@query("""SELECT l_orderkey, CAST(n AS BIGINT) AS n_items, CAST(coalesce(sum(n) OVER (PARTITION BY l_orderkey % 100 ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)""")
def item_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_items"))
    out = M.offsets(t.withColumn("group_id", F.col("l_orderkey") % 100).withColumn("table_order", F.col("l_orderkey")))
    return out.select("l_orderkey", "n_items", "start")


@query("""WITH i AS (SELECT l_orderkey, lower(l_returnflag || l_linestatus) AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag) - 1 AS k FROM lineitem)
SELECT l_orderkey, CAST(k AS BIGINT) AS li_idx, c AS caption_cleaned, lag(c, 1, '') OVER w AS item_before, lead(c, 1, '') OVER w AS item_after, string_agg(c, ', ') OVER (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS all_items FROM i WINDOW w AS (PARTITION BY l_orderkey ORDER BY k)""")
def caption_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag")) - 1
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", k.cast("bigint").alias("li_idx"), F.concat("l_returnflag", "l_linestatus").alias("caption"))
    return W.caption_neighbours(items, "l_orderkey").select("l_orderkey", "li_idx", "caption_cleaned", "item_before", "item_after", "all_items")


@query("""SELECT CAST(min(l_quantity) AS BIGINT) AS min_l_quantity, CAST(max(l_quantity) AS BIGINT) AS max_l_quantity, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem""")
def scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tabular.scaling(read(spark, sf_dir, "lineitem"), ["l_quantity"], ["l_returnflag"])
    return s.select(F.col("min_l_quantity").cast("bigint").alias("min_l_quantity"), F.col("max_l_quantity").cast("bigint").alias("max_l_quantity"), F.array_join("values_l_returnflag", ",").alias("flags"))


@query("""WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - a) / (b - a), 9) AS l_quantity FROM lineitem, e""")
def min_max_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tabular.min_max(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), ["l_quantity"])
    return x.withColumn("l_quantity", F.round("l_quantity", 9))


@query("""SELECT event_type AS service, user_id % 10 AS class_id, CAST(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS VARCHAR) AS amount, CAST(count(*) AS BIGINT) AS calls FROM events GROUP BY 1, 2""")
def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("service"), (F.col("user_id") % 10).alias("class_id"), F.col("value").cast("decimal(18,2)").alias("amount"))
    return E.costs(e).select("service", "class_id", text2(F.col("amount")).alias("amount"), "calls")


# --- evaluation ---------------------------------------------------------------------------------------------------


def _eval_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies about orders, read as typed answers, beside the true ones."""
    o = spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey"))
    total = F.concat(F.lit("The total is: "), F.format_number("o_totalprice", 2), F.lit(" USD."))
    wrong = F.when(F.col("o_orderkey") % 10 == 7, F.lit("unknown")).otherwise(total)
    currency = F.when(F.col("o_orderstatus") == "F", F.lit("in some money")).otherwise(F.when(F.col("o_custkey") % 3 == 0, F.lit("It is EUR, not $")).otherwise(F.lit("usd")))
    true_currency = F.when(F.col("o_custkey") % 3 == 0, "EUR").otherwise("USD")
    money = F.array(F.lit("USD"), F.lit("EUR"))
    rows = F.array(
        F.struct(F.lit("assigned").alias("model"), F.lit("total").alias("class_id"), text2(F.col("o_totalprice")).alias("value")),
        F.struct(F.lit("assigned").alias("model"), F.lit("currency").alias("class_id"), true_currency.alias("value")),
        F.struct(F.lit("rules").alias("model"), F.lit("total").alias("class_id"), F.coalesce(text2(A.parse_typed("numeric", wrong)["value"].try_cast("double")), F.lit("n/a")).alias("value")),
        F.struct(F.lit("rules").alias("model"), F.lit("currency").alias("class_id"), A.parse_typed("list", currency, money)["value"].alias("value")),
    )
    x = o.select(F.col("o_orderkey").alias("source"), F.explode(rows).alias("r"))
    return x.select("source", "r.model", "r.class_id", F.lit("").alias("key"), "r.value", F.lit(0).alias("seq"), F.lit(0).alias("meta_n"))


@query("""WITH s AS (SELECT o_orderkey, o_orderkey % 10 <> 7 AS t, o_orderstatus <> 'F' AS c FROM orders), n AS (SELECT count(*) AS n, CAST(sum(t::INT + c::INT) AS BIGINT) AS good FROM s)
SELECT 'assigned' AS model, 1.0::DOUBLE AS completion, CAST(2 * n AS BIGINT) AS total_correct, CAST(0 AS BIGINT) AS missing_answers, 1.0::DOUBLE AS completeness, 1.0::DOUBLE AS total_correct_percent FROM n
UNION ALL SELECT 'rules', 1.0, good, 0, 1.0, round(good / (2 * n), 9) FROM n""")
def typed_answer_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.evaluate(_eval_answers(spark, sf_dir))
    return out.select("model", F.round("completion", 9).alias("completion"), F.col("total_correct").cast("bigint").alias("total_correct"), F.col("missing_answers").cast("bigint").alias("missing_answers"), F.round("completeness", 9).alias("completeness"), F.round("total_correct_percent", 9).alias("total_correct_percent"))


@query("""SELECT o_orderkey AS source, 'currency' AS class_id, 'main question' AS type, CASE WHEN o_custkey % 3 = 0 THEN 'EUR' ELSE 'USD' END AS expected, 'n/a' AS actual FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, 'total', 'main question', CAST(o_totalprice::DECIMAL(18,2) AS VARCHAR), 'n/a' FROM orders WHERE o_orderkey % 10 = 7""")
def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = E.first_answers(_eval_answers(spark, sf_dir))
    return E.error_log(E.matched(kept)).where("model = 'rules'").select("source", "class_id", "type", "expected", "actual")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag AS v, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag) AS l_linenumber FROM lineitem)),
g AS (SELECT l_orderkey, list(v) AS vs, list(k) AS ks, count(*) AS n FROM (SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 1 THEN 'k' || l_linenumber ELSE 'x' || l_linenumber END AS k, CASE WHEN l_linenumber % 3 = 0 THEN '?' ELSE v END AS v FROM l WHERE l_linenumber % 4 <> 0) GROUP BY 1)
SELECT l.l_orderkey AS source, 'k' || l_linenumber AS key, CASE WHEN list_contains(ks, 'k' || l_linenumber) THEN 'key' WHEN l.n = 1 AND g.n = 1 THEN 'single' WHEN list_contains(vs, v) THEN 'value' END AS status FROM l JOIN g USING (l_orderkey)""")
def answer_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as answers with keys; the model gives every second one another key and leaves out every fourth."""
    x = read(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag")))
    base = [F.col("l_orderkey").alias("source"), F.lit("c").alias("class_id")]
    rest = [F.col("k").alias("seq"), F.lit(1).alias("meta_n")]
    name = F.concat(F.lit("k"), F.col("k").cast("string"))
    truth = x.select(*base, F.lit("assigned").alias("model"), name.alias("key"), F.col("l_returnflag").alias("value"), *rest)
    other = x.where("k % 4 <> 0").select(*base, F.lit("m").alias("model"), F.when(F.col("k") % 2 == 1, name).otherwise(F.concat(F.lit("x"), F.col("k").cast("string"))).alias("key"), F.when(F.col("k") % 3 == 0, "?").otherwise(F.col("l_returnflag")).alias("value"), *rest)
    m = E.matched(E.first_answers(truth.unionByName(other)))
    return m.where("model = 'm'").select("source", "key", "status")
