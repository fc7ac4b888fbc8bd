"""Queries about prompts, replies, budgets and detected tables: replies are made from the columns of the tables by fixed rules and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.checkpoints import spread
from docloom.functions import answers as A
from docloom.functions import json_repair as J
from docloom.functions import text as T
from docloom.operators import detection as D
from docloom.operators import evaluation as E
from docloom.operators import mapping as M
from docloom.operators import neighbours as W
from docloom.operators import retrieval as R
from docloom.plans import prompts as P
from docloom.plans import replies
from docloom.plans.template import Item
from docloom.queries import ELEMENTS, _elements, _long, query, read, text2
from docloom.sources import documents, images, tabular

_MONEY = Item("currency", "list", id="money", values=("USD", "EUR"))
_TOTAL = Item("What is the total?", "numeric", id="total", meta=(_MONEY,))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies about orders: an object, a list of answers with a meta value and sources, one with sources that are none, or no JSON."""
    o = spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey")).select("o_orderkey", F.format_number("o_totalprice", 2).alias("p"), F.lower(F.when(F.col("o_custkey") % 2 == 0, "usd").otherwise("eur")).alias("c"))
    k = F.col("o_orderkey") % 4
    one = F.concat(F.lit('{"main_question": "It is: '), "p", F.lit('"}'))
    many = F.concat(F.lit('Sure: {"answers": [{"main_question": "'), "p", F.lit('", "money": "in '), "c", F.lit('"}, {"main\\_question": 12, "money": "?"}], "sources": [1, 7, "x", 0]} done'))
    reply = F.when(k == 0, one).when(k == 1, many).when(k == 2, F.concat(F.lit('{"main_question": "none", "sources": "0", "other": 1}'))).otherwise("I don't know: {")
    return o.select(F.col("o_orderkey").cast("string").alias("source_identifier"), F.lit("m").alias("model"), reply.alias("reply"))


@query("""WITH o AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS p, CASE WHEN o_custkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS c FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS source_identifier, CAST(0 AS BIGINT) AS seq, p AS value, TRUE AS ok, '' AS meta, '' AS sources FROM o WHERE o_orderkey % 4 = 0
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 0, p, TRUE, 'money:' || c || ':0.8', '1,0' FROM o WHERE o_orderkey % 4 = 1
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 1, '12.00', FALSE, 'money:n/a:0.0', '1,0' FROM o WHERE o_orderkey % 4 = 1
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 0, 'n/a', FALSE, '', '' FROM o WHERE o_orderkey % 4 = 2""")
def question_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies to a question as answers with meta values and the sources that documents of three elements have."""
    r = _replies(spark, sf_dir)
    elements = r.select("source_identifier", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("element_index"))
    a = replies.answers(r, _TOTAL, elements)
    meta = F.array_join(F.transform("meta", lambda m: F.concat_ws(":", m["class_id"], m["class_value"], m["prob"].cast("string"))), ",")
    value = F.coalesce(text2(F.col("class_value").try_cast("double")), "class_value")
    return a.select("source_identifier", "seq", value.alias("value"), F.col("parse_successful").alias("ok"), meta.alias("meta"), F.array_join("sources", ",").alias("sources"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS source_identifier, CAST(i AS BIGINT) AS element_index, CAST(i * 10 AS BIGINT) AS place FROM orders, (VALUES (0), (1)) s(i) WHERE o_orderkey % 4 = 1
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), i, i * 10 FROM orders, (VALUES (0), (1)) s(i) WHERE o_orderkey % 4 = 1""")
def answer_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the elements are that answers name as their sources."""
    r = _replies(spark, sf_dir)
    elements = r.select("source_identifier", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("element_index")).withColumn("place", F.col("element_index") * 10)
    found = replies.answer_sources(replies.answers(r, _TOTAL, elements), elements)
    return found.select("source_identifier", F.col("element_index").cast("bigint").alias("element_index"), F.col("place").cast("bigint").alias("place"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS source_identifier, CAST(i AS BIGINT) AS element_index, 0.8::DOUBLE AS prob, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE 0.6 END::DOUBLE AS partial_prob, CAST(s AS BIGINT) AS seq
FROM orders, (VALUES (0, 1, 0), (1, 3, 0), (1, 0, 2), (2, 2, 0), (2, 1, 1)) v(k, i, s) WHERE o_orderkey % 3 = k""")
def detection_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of elements in the lines of replies; those that a document of four elements lacks are left out, and several are parts."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("source_identifier"))
    k = F.col("o_orderkey") % 3
    said = F.when(k == 0, "It is [1]").when(k == 1, "[3, 9,0]\nno more").otherwise('first: [2]\nthen [1, "x"] or [5] ')
    elements = o.select("source_identifier", F.explode(F.array(*map(F.lit, range(4)))).alias("element_index"))
    got = replies.locations(o.select("source_identifier", F.lit("m").alias("model"), said.alias("reply")), "t", elements)
    return got.select("source_identifier", F.col("element_index").cast("bigint").alias("element_index"), "prob", "partial_prob", "seq")


@query("""SELECT o_orderkey AS column_id, 'money' AS class_id, CASE WHEN o_custkey % 3 = 0 THEN 'EUR' WHEN o_custkey % 3 = 1 THEN 'USD' ELSE 'n/a' END AS class_value, CASE WHEN o_custkey % 3 < 2 THEN 0.8 ELSE 0.0 END::DOUBLE AS prob FROM orders
UNION ALL SELECT o_orderkey, 'year', CAST(year(o_orderdate) AS VARCHAR), 0.8 FROM orders""")
def meta_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines of replies about columns; the last line of a number counts, numbers out of range don't."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_custkey") % 3
    said = F.concat(F.lit("1) "), F.when(k == 0, "EUR").when(k == 1, "in usd, I think").otherwise("unclear"), F.lit("\n2) 1\n2)in "), F.year("o_orderdate").cast("string"), F.lit("\n3) none\n0) x"))
    return replies.meta_values(o.select(F.col("o_orderkey").alias("column_id"), said.alias("reply")), [_MONEY, Item("year", "int", id="year")])


@query("""WITH i AS (SELECT o_orderkey AS table_id, unnest(range(4)) AS li_idx FROM orders WHERE o_orderkey % 5 <> 4)
SELECT table_id, CAST(li_idx AS BIGINT) AS li_idx, CASE WHEN li_idx = 0 THEN 'a' WHEN li_idx = 1 AND table_id % 5 < 3 THEN 'b' WHEN li_idx = 2 AND table_id % 5 = 0 THEN 'b' ELSE '[NOT_SPECIFIED]' END AS bucket_id FROM i""")
def mapping_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that replies put into buckets, and those that they leave out; replies that can't be read sort nothing."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("table_id"))
    k = F.col("table_id") % 5
    said = F.when(k == 0, '{"a": ["LI0"], "b": ["LI1", "LI2"]}').when(k < 3, 'Here: {"a": ["LI0"], "b": ["LI1"], "c": ["LI3"]}').when(k == 3, '{"a": ["row 0", "none"], "b": 7}').otherwise("no JSON")
    items = o.select("table_id", F.explode(F.array(*map(F.lit, range(4)))).alias("li_idx"))
    got = replies.bucket_choices(o.select("table_id", said.alias("reply")), ["a", "b"], items)
    return got.select("table_id", F.col("li_idx").cast("bigint").alias("li_idx"), "bucket_id")


@query("""SELECT doc_id, CAST(least(len(t), 200) AS BIGINT) AS n_tokens, sha256(list_aggregate(t[1:200], 'string_agg', '')) AS head FROM (SELECT doc_id, regexp_extract_all(text, '(?s)\\s*[a-zA-Z0-9_]+|\\s*[^\\sa-zA-Z0-9_]|\\s+$') AS t FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7f]', '', 'g') AS text FROM documents)) WHERE len(t) > 0""")
def cut_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to a budget of 200 tokens."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7f]", "").alias("text"))
    tokens = d.select("doc_id", P.tokenize(F.col("text")).alias("t")).where(F.size("t") > 0)
    kept = R.split_tokens(tokens.select("doc_id", F.col("doc_id").alias("request"), F.lit(0).alias("doc_order"), F.col("t").alias("tokens")), 200)
    return kept.select("doc_id", F.size("kept").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("kept", ""), 256).alias("head"))


@query(f"""WITH t AS (SELECT conv_id, turn, len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS n FROM conversations), b AS (SELECT *, sum(n) OVER (PARTITION BY conv_id) <= 100 AS fits, 100 // count(*) OVER (PARTITION BY conv_id) AS share FROM t)
SELECT conv_id, turn, CAST(CASE WHEN fits THEN n ELSE least(n, share) END AS BIGINT) AS n_kept FROM b""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as documents of one request: all of their tokens if they fit, else equal shares."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request"), F.col("turn").alias("doc_order"), F.regexp_extract_all("text", F.lit(r"([^ \t\r\n]+)")).alias("tokens"))
    return R.split_tokens(c, 100).select(F.col("request").alias("conv_id"), F.col("doc_order").alias("turn"), F.size("kept").cast("bigint").alias("n_kept"))


@query("""WITH i AS (SELECT o_custkey AS request, o_orderkey % 4 AS d, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 4 ORDER BY o_orderkey) AS k FROM orders),
n AS (SELECT *, count(*) OVER (PARTITION BY request) AS everything, max(d) OVER (PARTITION BY request) AS last_d, count(*) OVER (PARTITION BY request, d) AS own FROM i),
s AS (SELECT *, 7 // (SELECT count(DISTINCT d) FROM i WHERE i.request = n.request) AS share FROM n),
u AS (SELECT *, coalesce(sum(CASE WHEN k = 1 AND d < last_d THEN least(own, share) END) OVER (PARTITION BY request), 0) AS used FROM s)
SELECT request, d AS doc_order, CAST(k AS BIGINT) AS image_order FROM u WHERE everything <= 7 OR k <= CASE WHEN d = last_d AND own > share THEN 7 - used ELSE share END""")
def image_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of several documents that a request of seven may show."""
    w = Window.partitionBy("o_custkey", F.col("o_orderkey") % 4).orderBy("o_orderkey")
    i = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request"), (F.col("o_orderkey") % 4).alias("doc_order"), F.row_number().over(w).cast("bigint").alias("image_order"))
    return R.split_images(i, 7)


@query("""WITH p AS (SELECT l_orderkey, l_suppkey % 7 AS page, min(l_linenumber * 1000 + l_partkey % 1000) AS first FROM lineitem WHERE l_suppkey % 7 < 6 GROUP BY 1, 2)
SELECT CAST(l_orderkey AS VARCHAR) AS source_identifier, page AS page_idx, CAST(k AS BIGINT) AS page_order FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY first, page) AS k FROM p) WHERE k <= 3""")
def page_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three distinct pages on which elements of a document lie."""
    x = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("source_identifier"), (F.col("l_linenumber") * 1000 + F.col("l_partkey") % 1000).alias("element_index"), F.when(F.col("l_suppkey") % 7 < 6, F.col("l_suppkey") % 7).alias("page_idx"))
    return R.image_pages(x, 3).select("source_identifier", "page_idx", F.col("page_order").cast("bigint").alias("page_order"))


@query("""SELECT event_id, CAST(CAST(user_id * 0.002 + event_id * 0.01 / 1000 + (event_id % 3) * 0.5 AS DECIMAL(18,6)) AS VARCHAR) AS cost FROM events""")
def call_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What calls cost by tokens in and out and by images."""
    e = read(spark, sf_dir, "events")
    cost = E.call_cost(F.col("user_id"), F.col("event_id"), F.col("event_id") % 3, F.lit(2.0), F.lit(0.01), F.lit(0.5))
    return e.select("event_id", cost.cast("decimal(18,6)").cast("string").alias("cost"))


@query(f"""WITH {ELEMENTS} SELECT source_identifier, CAST(count(*) AS BIGINT) AS n, sha256(string_agg('[' || element_index || ']: ' || text || ' [/' || element_index || ']' || chr(10), '' ORDER BY element_index)) AS data FROM e GROUP BY source_identifier""")
def prompt_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered fragments of documents in question prompts, without the line that explains them."""
    e = _elements(spark, sf_dir).withColumn("llm_text", F.col("text")).withColumn("rank", F.col("element_index"))
    data = P.fragments(e)
    n = e.groupBy("source_identifier").agg(F.count("*").alias("n"))
    return data.join(n, "source_identifier").select("source_identifier", "n", F.sha2(F.regexp_replace("data", r"^[^\n]*\n", ""), 256).alias("data"))


@query(f"""WITH {ELEMENTS} SELECT source_identifier, sha256(string_agg('[' || element_index || '] before: ; words: ' || text || ' [end of item]' || chr(10), '' ORDER BY element_index)) AS data FROM e WHERE el_type = 'table' GROUP BY source_identifier""")
def detection_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of documents as detection prompts list them."""
    e = R.from_start(_elements(spark, sf_dir), tables_only=True).withColumn("text_before", F.lit(None).cast("string"))
    return P.detection_data(e).select("source_identifier", F.sha2("data", 256).alias("data"))


@query("""WITH l AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag) - 1 AS k, l_returnflag AS f, l_linenumber AS v FROM lineitem)
SELECT o, '[' || string_agg('["LI' || k || ': ' || f || '","' || CASE WHEN k % 2 = 0 THEN CAST(v AS VARCHAR) ELSE 'None' END || '"]', ',' ORDER BY k) || ']' AS data FROM l GROUP BY o""")
def mapping_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables as mapping prompts give them."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag")
    x = read(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(w) - 1)
    item = F.struct("k", F.col("l_returnflag").alias("caption"), F.array(F.when(F.col("k") % 2 == 0, F.col("l_linenumber").cast("string"))).alias("values"))
    return x.groupBy(F.col("l_orderkey").alias("o")).agg(F.sort_array(F.collect_list(item)).alias("i")).select("o", P.mapping_data(F.col("i")).alias("data"))


# --- detected tables ----------------------------------------------------------------------------------------------


@query(f"""WITH {ELEMENTS}, p AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY source_identifier ORDER BY element_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, length(text) AS own, 0.3 + (length(text) % 7) / 10.0 AS prob FROM e),
g AS (SELECT * FROM p WHERE el_type = 'table'),
gone AS (SELECT a.source_identifier, CASE WHEN a.prob < b.prob THEN a.element_index ELSE b.element_index END AS element_index FROM g a JOIN g b ON a.source_identifier = b.source_identifier AND a.element_index < b.element_index WHERE b.pos - a.pos - a.own <= 300)
SELECT source_identifier, element_index FROM g WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.source_identifier = g.source_identifier AND gone.element_index = g.element_index)""")
def best_in_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of tables that are close to each other the likelier ones."""
    e = _elements(spark, sf_dir)
    g = e.where("el_type = 'table'").select("source_identifier", F.lit("t").alias("detected_class"), F.col("element_index").alias("k"), (0.3 + (F.length("text") % 7) / 10).alias("prob"))
    pairs = g.select("source_identifier", F.col("k").alias("a")).join(g.select("source_identifier", F.col("k").alias("b")), "source_identifier").where("a < b")
    near = W.distances(e, pairs, include_tables=True).select("source_identifier", F.lit("t").alias("detected_class"), F.col("a").alias("k"), F.col("b").alias("kk"), "distance")
    return D.best_in_proximity(g, near, 300).select("source_identifier", F.col("k").cast("bigint").alias("element_index"))


_GROUPED = f"""WITH RECURSIVE {ELEMENTS}, p AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY source_identifier ORDER BY element_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, length(text) AS own, CASE WHEN length(text) % 2 = 0 THEN 0.8 ELSE 0.5 END AS prob, CASE WHEN length(text) % 3 = 0 THEN 0.0 ELSE 0.6 END AS part FROM e),
c AS (SELECT *, row_number() OVER (PARTITION BY source_identifier ORDER BY element_index) AS k FROM p WHERE el_type = 'table'),
n AS (SELECT a.source_identifier, a.k, a.prob >= 0.6 AND a.part >= 0.1 AND b.part >= 0.1 AND a.pos - b.pos - b.own <= 1000 AS joined FROM c a JOIN c b ON a.source_identifier = b.source_identifier AND b.k = a.k - 1)"""


@query(f"""{_GROUPED} SELECT c.source_identifier, c.element_index, CAST(sum(CASE WHEN coalesce(joined, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY c.source_identifier ORDER BY c.k) - 1 AS BIGINT) AS group_id FROM c LEFT JOIN n USING (source_identifier, k)""")
def merged_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations of parts of tables, in the order of the document, as the groups that they are put together to."""
    e = _elements(spark, sf_dir)
    n = F.length("text")
    loc = e.where("el_type = 'table'").select("source_identifier", F.lit("t").alias("detected_class"), "element_index", F.when(n % 2 == 0, 0.8).otherwise(0.5).alias("prob"), F.when(n % 3 == 0, 0.0).otherwise(0.6).alias("partial_prob"), F.col("element_index").alias("seq"))
    got = D.assemble(loc, e.withColumn("text", F.coalesce("text", F.lit(""))), {"t": {"best": False, "collapse": False}})
    return got.select("source_identifier", F.col("element_index").cast("bigint").alias("element_index"), F.col("group_id").cast("bigint").alias("group_id"))


@query("""WITH l AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag) - 1 AS k, l_returnflag AS f, CAST(floor(l_quantity) AS BIGINT) AS q, l_linenumber AS n FROM lineitem)
SELECT CAST(o AS VARCHAR) AS source_identifier, CAST(j AS BIGINT) AS col_idx, string_agg(f || ' ' || k || '=' || CASE j WHEN 0 THEN q ELSE 3 * q END, ';' ORDER BY k) || ';' || string_agg('second ' || k || '=' || CASE j WHEN 0 THEN 2 * q ELSE 4 * q END, ';' ORDER BY k) AS pairs FROM l, (VALUES (0), (1)) c(j) GROUP BY o, j""")
def output_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of tables that go on in another table of as many columns."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag")
    x = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("source_identifier"), (F.row_number().over(w) - 1).alias("k"), F.col("l_returnflag").alias("f"), F.col("l_quantity").cast("bigint").cast("decimal(38,10)").alias("q"))
    name = [F.concat("f", F.lit(" "), F.col("k").cast("string")), F.concat(F.lit("second "), F.col("k").cast("string"))]
    parts = F.explode(F.array(*(F.struct(F.lit(i).alias("element_index"), name[i].alias("caption"), F.array((F.col("q") * (1 + i)).cast("decimal(38,10)"), (F.col("q") * (3 + i)).cast("decimal(38,10)")).alias("values")) for i in range(2))))
    rows = x.select("source_identifier", "k", parts.alias("p")).select("source_identifier", "k", "p.*")
    cell = lambda v: F.struct(v.cast("decimal(38,10)").alias("num"))
    tables = rows.groupBy("source_identifier", "element_index").agg(F.sort_array(F.collect_list(F.struct("k", "caption", "values"))).alias("r"))
    tables = tables.select("source_identifier", "element_index", F.array(F.lit(0), F.lit(1)).alias("numeric_cols"), F.transform("r", lambda i: F.struct(i["caption"].alias("caption"), i["values"].alias("values"))).alias("line_items"), F.transform("r", lambda i: F.transform(i["values"], cell)).alias("grid"))
    places = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("source_identifier")).distinct().select("source_identifier", F.explode(F.array(F.lit(0), F.lit(1))).alias("element_index"))
    groups = places.select("source_identifier", F.lit(0).alias("group_id"), F.lit("t").alias("detected_class"), "element_index", F.col("element_index").alias("part"), F.lit(False).alias("collapse"), F.lit(0.8).alias("prob"))
    out = D.output_columns(groups, tables)
    return out.select("source_identifier", F.col("col_idx").cast("bigint").alias("col_idx"), F.array_join(F.transform("pairs", lambda p: F.concat(p["line_item"], F.lit("="), p["value"].cast("bigint").cast("string"))), ";").alias("pairs"))


# --- joins of small things ----------------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS column_id, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS detected_class, m AS class_id FROM orders, (VALUES ('m1'), ('m2'), ('m3')) v(m) WHERE (o_orderkey % 2 = 0 AND m <> 'm3') OR (o_orderkey % 2 = 1 AND m = 'm3')""")
def allowed_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meta values that the item of a column's class asks for."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("column_id"), F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b").alias("detected_class"))
    said = o.select("column_id", F.explode(F.array(*map(F.lit, ("m1", "m2", "m3")))).alias("class_id"), F.lit("x").alias("class_value"))
    items = spark.createDataFrame([("a", ["m1", "m2"]), ("b", ["m3"])], "id string, meta_ids array<string>")
    return M.allowed_meta(o, said, items).select("column_id", "detected_class", "class_id")


@query("""SELECT o_orderkey AS table_id, CASE WHEN o_orderkey % 3 = 0 THEN 's1' ELSE 's2' END AS schema_id FROM orders WHERE o_orderkey % 3 < 2""")
def mapping_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables whose class has a mapping, with the first one."""
    t = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("table_id"), F.concat(F.lit("c"), (F.col("o_orderkey") % 3).cast("string")).alias("detected_class"))
    items = spark.createDataFrame([("c0", 0, None), ("c0", 1, "s1"), ("c0", 2, "s9"), ("c1", 0, "s2"), ("c2", 0, None)], "id string, order int, schema_id string")
    return M.mapping_schema(t, items).select("table_id", "schema_id")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS source_identifier, 'data/' || o_orderkey || '_p' || page || '.png' AS file, 'image/' || CASE WHEN o_orderkey % 2 = 0 THEN 'png' ELSE 'jpeg' END AS media_type, CAST(page AS BIGINT) AS page_idx, CASE WHEN page = 0 THEN 'pic' END AS data FROM orders, (VALUES (0), (1)) p(page)""")
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of documents with their images, null where there is none."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey"), F.col("o_orderkey").cast("string").alias("source_identifier"))
    e = o.select("o_orderkey", "source_identifier", F.explode(F.array(F.lit(0), F.lit(1))).alias("page_idx")).withColumn("element_index", F.col("page_idx"))
    there = e.where("page_idx = 0").select("source_identifier", "page_idx", F.lit("pic").alias("data"))
    got = images.images_of(e, there, 5).join(o, "source_identifier")
    name = F.concat(F.lit("data/"), "source_identifier", F.lit("_p"), F.col("page_idx").cast("string"), F.lit(".png"))
    kind = images.media_type(F.concat(F.lit("a."), F.when(F.col("o_orderkey") % 2 == 0, "PNG").otherwise("tiff")))
    return got.select("source_identifier", name.alias("file"), kind.alias("media_type"), F.col("page_idx").cast("bigint").alias("page_idx"), "data")


@query("""SELECT p_partkey, CAST(floor(w * s) AS BIGINT) AS width, CAST(floor(h * s) AS BIGINT) AS height FROM (SELECT p_partkey, w, h, least(1.0::DOUBLE, 500.0::DOUBLE / greatest(w, h)) AS s FROM (SELECT p_partkey, 100 + p_partkey % 1000 AS w, 100 + p_size * 20 AS h FROM part))""")
def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of images whose longer side is at most 500."""
    p = read(spark, sf_dir, "part")
    s = p.select("p_partkey", images.fitted((100 + F.col("p_partkey") % 1000).cast("int"), (100 + F.col("p_size") * 20).cast("int"), 500).alias("s"))
    return s.select("p_partkey", F.col("s.width").cast("bigint").alias("width"), F.col("s.height").cast("bigint").alias("height"))


@query("""SELECT 's' || c_custkey AS source_identifier, '[NOT_CONFIGURED]' AS template_id, c_mktsegment AS element_identifier, CASE WHEN c_custkey % 2 = 0 THEN '[NOT_CONFIGURED]' ELSE 'a b' END AS ANSWER_x, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE '[NOT_CONFIGURED]' END AS FEATURE_y FROM customer""")
def dataset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset rows of different columns as one frame."""
    c = read(spark, sf_dir, "customer")
    base = [F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("source_identifier"), F.lit(None).cast("string").alias("template_id"), F.col("c_mktsegment").alias("element_identifier")]
    return tabular.consistent(c.where("c_custkey % 2 = 0").select(*base, F.col("c_nationkey").alias("FEATURE_y")), c.where("c_custkey % 2 = 1").select(*base, F.lit("a\u0000b").alias("ANSWER_x")))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS source, CAST(dense_rank() OVER (ORDER BY CAST(c_custkey AS VARCHAR)) - 1 AS BIGINT) AS doc_order FROM (SELECT DISTINCT o_custkey AS c_custkey FROM orders)""")
def documents_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in a stable order."""
    ids = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("source_identifier"))
    return R.by_relevance(ids).select(F.col("source_identifier").alias("source"), "doc_order")


@query("""SELECT o_orderkey, sha256(o_orderstatus || '|') AS whole, sha256(o_orderstatus || '|' || o_custkey) AS part, replace('{"a' || chr(92) || '_b": ' || o_custkey || '}', chr(92) || '_', '_') AS unescaped, 'a:' || o_orderstatus AS column_name, 'col7' AS plain_name FROM orders""")
def names_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of references, names of columns, underscores that a model escaped."""
    o = read(spark, sf_dir, "orders")
    ref = lambda i: F.sha2(T.reference_id(F.col("o_orderstatus"), i), 256)
    meta = F.array(F.struct(F.lit("a").alias("class_id"), F.col("o_orderstatus").alias("class_value")))
    told = J.unescape(F.concat(F.lit('{"a\\_b": '), F.col("o_custkey").cast("string"), F.lit("}")))
    return o.select("o_orderkey", ref(F.lit(None)).alias("whole"), ref(F.col("o_custkey")).alias("part"), told.alias("unescaped"), M.column_name(meta, F.lit(7)).alias("column_name"), M.column_name(F.array().cast("array<struct<class_id:string,class_value:string>>"), F.lit(7)).alias("plain_name"))


@query("""SELECT c_custkey, ' Said: ' || c_mktsegment AS as_text, TRUE AS ok, CASE WHEN c_custkey % 2 = 0 THEN '[' || c_mktsegment || ']' ELSE c_mktsegment END AS raw FROM customer""")
def text_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text as it is, and values as replies would give them."""
    c = read(spark, sf_dir, "customer")
    t = A.parse_typed("text", F.concat(F.lit(" Said: "), "c_mktsegment"))
    return c.select("c_custkey", t["value"].alias("as_text"), t["ok"].alias("ok"), A.to_raw(F.when(F.col("c_custkey") % 2 == 0, "multi").otherwise("text"), F.col("c_mktsegment")).alias("raw"))


@query("""WITH o AS (SELECT o_orderkey AS s, o_custkey % 3 AS k FROM orders)
SELECT 'assigned' AS model, 1.0::DOUBLE AS completion, CAST(3 * n AS BIGINT) AS total_correct, CAST(2 * n AS BIGINT) AS found, CAST(0 AS BIGINT) AS missing, 1.0::DOUBLE AS completeness, 1.0::DOUBLE AS correct_share, 1.0::DOUBLE AS found_share, 1.0::DOUBLE AS correct_ex, 1.0::DOUBLE AS found_ex FROM (SELECT count(*) AS n FROM o)
UNION ALL SELECT 'm', round((n + n0 + n1) / (2.0 * n) , 9), good, n0 + n1, n1, round((3 * n - n1) / (3 * n), 9), round(good / (3 * n), 9), round((n0 + n1) / (2 * n), 9), round(good / (3 * n - n1), 9), round((n0 + n1) / (2 * n - n1), 9)
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE k = 0) AS n0, count(*) FILTER (WHERE k = 1) AS n1, count(*) + count(*) FILTER (WHERE k = 0) * 2 AS good FROM o)""")
def meta_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of answers with meta keys: some are under other keys, wrong, or missing in the last class; all nine measures."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source"), (F.col("o_custkey") % 3).alias("k"))
    row = lambda m, c, key, v, seq, n: F.struct(F.lit(m).alias("model"), F.lit(c).alias("class_id"), F.lit(key).alias("key"), F.lit(v).alias("value"), F.lit(seq).cast("bigint").alias("seq"), F.lit(n).alias("meta_n"))
    truth = [row("assigned", "a", "", "1", 0, 0), row("assigned", "b", "y:1", "5", 1, 1), row("assigned", "b", "y:2", "6", 2, 1)]
    first = row("m", "a", "", "1", 0, 0)
    # Class b: found both (one with a later, ignored answer), one key of two and wrong, or none at all.
    said = F.when(F.col("k") == 0, F.array(first, row("m", "b", "y:1", "5", 1, 1), row("m", "b", "y:1", "9", 5, 1), row("m", "b", "y:3", "6", 2, 1))).when(F.col("k") == 1, F.array(first, row("m", "b", "y:1", "7", 1, 1))).otherwise(F.array(first))
    rows = o.select("source", F.explode(F.concat(F.array(*truth), said)).alias("r")).select("source", "r.*")
    out = E.evaluate(rows)
    r9 = lambda c: F.round(c, 9)
    return out.select("model", r9("completion").alias("completion"), F.col("total_correct").cast("bigint").alias("total_correct"), F.col("total_correct_meta_found").cast("bigint").alias("found"), F.col("missing_answers").cast("bigint").alias("missing"), r9("completeness").alias("completeness"), r9("total_correct_percent").alias("correct_share"), r9("total_correct_meta_found_percent").alias("found_share"), r9("total_correct_percent_ex_missing").alias("correct_ex"), r9("total_correct_meta_found_percent_ex_missing").alias("found_ex"))
