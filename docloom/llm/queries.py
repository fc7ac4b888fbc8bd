"""Queries over the whole tables, one for each operator, and the SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import chat_parts, exact_dedup, fm_index, langid, license_scan, merkle, mixing, sentencepiece_codec, simhash, warc
from docloom.llm.common import table

#: Where the public vocabularies are; the files themselves are no part of this repository.
TOKENIZERS = os.environ.get("DOCLOOM_TOKENIZERS", "/opt/tokenizers")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def revised(docs: DataFrame) -> DataFrame:
    """A second version: of some documents a character is another one, some have one more section or a line before the others, some lack their first line, some are gone, some are new."""
    text, n, i = F.col("text"), F.length("text"), F.col("doc_id")
    changed = F.concat(F.substring(text, F.lit(1), F.floor(n / 2).cast("int")), F.lit("~"), F.substring(text, F.floor(n / 2).cast("int") + 2, n))
    kept = docs.where(~(i % 101).eqNullSafe(3)).select("doc_id", F.when(i % 53 == 7, changed).when(i % 71 == 5, F.concat(text, F.lit("\n\nOne more section."))).when(i % 61 == 8, F.concat(F.lit("A line before.\n"), text)).when(i % 59 == 2, F.regexp_replace(text, r"^[^\n]*\n", "")).otherwise(text).alias("text"))
    return kept.unionByName(docs.where(i % 131 == 9).select((-i).alias("doc_id"), "text"))


def op1_document_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table against a second version of it: roots of what differs, and where it does."""
    docs = table(spark, sf_dir, "documents")
    return merkle.versions(docs, revised(docs))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has plain text only; a fixed rule puts attachments of each kind beside it."""
    return chat_parts.format_conversations(chat_parts.illustrated(table(spark, sf_dir, "conversations")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def damaged(pages: DataFrame) -> DataFrame:
    """A second replica: of some pages a byte is another one, of some the end is lost."""
    html, n = F.col("html"), F.length("html")
    changed = F.concat(F.substring(html, F.lit(1), F.floor(n / 2).cast("int")), F.lit("\u0000"), F.substring(html, F.floor(n / 2).cast("int") + 2, n))
    return pages.select("page_id", "url", F.when(F.col("page_id") % 97 == 13, changed).when(F.col("page_id") % 211 == 7, F.substring(html, F.lit(1), n - 10)).otherwise(html).alias("html"))


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.audit(pages, damaged(pages))


def incomplete(pages: DataFrame) -> DataFrame:
    """A damaged second replica that also lost some pages, wherever they lie in their files, and has others twice, as captured again."""
    kept = damaged(pages).where(~(F.col("page_id") % 61).eqNullSafe(41))
    again = pages.where(F.col("page_id") % 83 == 29).select("page_id", F.concat("url", F.lit("#again")).alias("url"), "html")
    return kept.unionByName(again)


def op7_warc_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit against a replica that lost and gained records inside files."""
    pages = table(spark, sf_dir, "pages")
    return warc.audit(pages, incomplete(pages))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.repeats(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_document_edits,
    op1_document_fingerprints,
    op2_language_id,
    op3_mixing,
    op4_sentencepiece,
    op5_chat_formatting,
    op6_simhash,
    op7_warc_losses,
    op7_warc_fixity,
    op8_license_scan,
    op9_substring_dedup,
    op10_exact_dedup,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


OP3 = f"""
WITH best AS (SELECT doc_id AS lid, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
r AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n]+')) AS n,
    -ln((CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0)
      / CASE WHEN q = 1 THEN 1.0::DOUBLE WHEN q = 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS k
  FROM documents LEFT JOIN best ON doc_id = lid),
s AS (SELECT source, sum(n)::HUGEINT AS have, floor(sqrt(sum(n)::DOUBLE))::HUGEINT AS w FROM r GROUP BY source),
t AS (SELECT source, have, CASE WHEN have > 0 THEN (sum(have) OVER ()) * w // (sum(w) OVER ()) ELSE 0 END AS want FROM s),
p AS (SELECT source, CASE WHEN have > 0 THEN want // have ELSE 1 END AS epochs, CASE WHEN have > 0 THEN want % have ELSE 0 END AS rest FROM t),
c AS (
  SELECT doc_id, r.source, n, epochs + CASE WHEN sum(n) OVER (PARTITION BY r.source ORDER BY k, doc_id RANGE UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS copies
  FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, CAST(e AS INTEGER) AS epoch, CAST(n AS BIGINT) AS n_tokens FROM c, LATERAL (SELECT unnest(range(0, CAST(copies AS BIGINT))) AS e)
"""

def _tree(name: str, key: str, source: str) -> str:
    """Recursive tables of a binary tree: levels of (key, i, h) from the leaves of ``source``, and the roots."""
    return f"""
{name} AS (
  SELECT {key}, i, h, n FROM (SELECT {key}, i, h, count(*) OVER (PARTITION BY {key}) AS n FROM {source})
  UNION ALL
  SELECT {key}, i // 2, CASE WHEN count(*) = 2 THEN sha256('n' || string_agg(h, '' ORDER BY i)) ELSE min(h) END, (n + 1) // 2
  FROM {name} WHERE n > 1 GROUP BY {key}, i // 2, n)"""


def _prints(n: str, source: str) -> str:
    """Recursive tables over the texts of ``source``: sections, paragraphs (their hashes), the trees' levels and the documents' roots, all named with ``n``."""
    return f"""
sections{n} AS (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS si FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS l FROM {source} WHERE text IS NOT NULL)),
paragraphs{n} AS (SELECT doc_id, si, sha256('p' || unnest(l)) AS h, unnest(range(len(l))) AS i FROM (SELECT doc_id, si, string_split(s, chr(10)) AS l FROM sections{n})),
{_tree(f"t1{n}", "doc_id, si", f"paragraphs{n}")},
roots{n} AS (SELECT doc_id, si AS i, sha256('s' || h) AS h FROM t1{n} WHERE n = 1),
{_tree(f"t2{n}", "doc_id", f"roots{n}")},
prints{n} AS (SELECT doc_id, CASE WHEN h IS NOT NULL THEN sha256('d' || h) END AS root FROM (SELECT doc_id FROM {source}) LEFT JOIN (SELECT doc_id, h FROM t2{n} WHERE n = 1) USING (doc_id))"""


OP1 = f"""
WITH RECURSIVE {_prints("", "documents")},
counts AS (SELECT doc_id, count(DISTINCT si) AS s, count(*) AS p FROM paragraphs GROUP BY doc_id)
SELECT doc_id, root, CAST(coalesce(s, 0) AS INTEGER) AS n_sections, CAST(coalesce(p, 0) AS INTEGER) AS n_paragraphs FROM prints LEFT JOIN counts USING (doc_id)
"""


def _middles(key: str) -> str:
    """Of lists a and b, by ``key``: what they don't have in common at the ends (nothing is set aside if they are of one length), and how much comes before it."""
    return f"""SELECT {key}, pre, a[pre + 1 : len(a) - suf] AS a, b[pre + 1 : len(b) - suf] AS b FROM (
  SELECT {key}, a, b, pre, CASE WHEN len(a) = len(b) THEN 0 ELSE least(len(list_filter(range(1, least(len(a), len(b)) + 1), lambda k: list_reverse(a)[1 : k] = list_reverse(b)[1 : k])), least(len(a), len(b)) - pre) END AS suf FROM (
    SELECT {key}, a, b, CASE WHEN len(a) = len(b) THEN 0 ELSE len(list_filter(range(1, least(len(a), len(b)) + 1), lambda k: a[1 : k] = b[1 : k])) END AS pre FROM {{}}))"""


def _places(key: str) -> str:
    """A row for each place in which the middles differ."""
    return f"""SELECT {key}, pre + k AS i, CASE WHEN k >= len(a) THEN 'added' WHEN k >= len(b) THEN 'removed' ELSE 'changed' END AS change, a[k + 1] AS x, b[k + 1] AS y
  FROM (SELECT *, unnest(range(greatest(len(a), len(b)))) AS k FROM ({{}})) WHERE a[k + 1] IS DISTINCT FROM b[k + 1]"""


_SECTIONS = "(SELECT doc_id, coalesce(sa, []) AS a, coalesce(sb, []) AS b FROM both_texts)"
_PARAGRAPHS = "(SELECT doc_id, si, CASE WHEN change <> 'added' THEN string_split(x, chr(10)) ELSE [] END AS a, CASE WHEN change <> 'removed' THEN string_split(y, chr(10)) ELSE [] END AS b FROM sections_differ)"
OP1_EDITS = f"""
WITH RECURSIVE revised AS (
  SELECT doc_id, CASE WHEN doc_id % 53 = 7 THEN substr(text, 1, length(text) // 2) || '~' || substr(text, length(text) // 2 + 2) WHEN doc_id % 71 = 5 THEN text || chr(10) || chr(10) || 'One more section.'
    WHEN doc_id % 61 = 8 THEN 'A line before.' || chr(10) || text WHEN doc_id % 59 = 2 THEN regexp_replace(text, '^[^\\n]*\\n', '') ELSE text END AS text
  FROM documents WHERE doc_id % 101 <> 3
  UNION ALL SELECT -doc_id, text FROM documents WHERE doc_id % 131 = 9),
{_prints("_a", "documents")},
{_prints("_b", "revised")},
pairs AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.root AS old_root, b.root AS new_root, a.doc_id IS NULL AS is_new, b.doc_id IS NULL AS is_gone FROM prints_a a FULL JOIN prints_b b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.root IS DISTINCT FROM b.root),
both_texts AS (SELECT doc_id, string_split(o.text, chr(10) || chr(10)) AS sa, string_split(r.text, chr(10) || chr(10)) AS sb FROM pairs JOIN documents o USING (doc_id) JOIN revised r USING (doc_id) WHERE NOT is_new AND NOT is_gone),
sections_differ AS (SELECT doc_id, i AS si, change, x, y FROM ({_places("doc_id").format(_middles("doc_id").format(_SECTIONS))})),
edits AS (SELECT doc_id, si, i, change FROM ({_places("doc_id, si").format(_middles("doc_id, si").format(_PARAGRAPHS))}))
SELECT doc_id, old_root, new_root, CAST(si AS INTEGER) AS section, CAST(i AS INTEGER) AS paragraph, change FROM pairs JOIN edits USING (doc_id)
UNION ALL SELECT doc_id, old_root, new_root, NULL, NULL, CASE WHEN is_new THEN 'added' ELSE 'removed' END FROM pairs WHERE is_new OR is_gone
"""

OP5 = """
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, conv_id || '/' || turn AS name FROM conversations),
p AS (
  SELECT conv_id, turn, role, 0 AS pos, 'image' AS kind, 'img/' || name || '.png' AS ref, ((224 + 28 * (n % 10) + 27) // 28) * ((224 + n % 100 + 27) // 28) + 2 AS tokens, '' AS text FROM t WHERE n % 3 = 0
  UNION ALL SELECT conv_id, turn, role, 1, 'text', NULL, len(regexp_extract_all(text, '[^ \t\r\n]+')), text FROM t
  UNION ALL SELECT conv_id, turn, role, 2, 'audio', 'snd/' || name || '.wav', CAST(ceil((n % 40) / 4.0 * 25) AS BIGINT), '' FROM t WHERE n % 5 = 1
  UNION ALL SELECT conv_id, turn, role, 3, 'document', 'doc/' || name || '.pdf', (1 + n % 9) * 256, '' FROM t WHERE n % 7 = 2),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, kind ORDER BY turn, role, pos) AS k FROM p),
f AS (SELECT *, CASE WHEN kind = 'text' THEN text ELSE '<|' || kind || '_' || k || '|>' END AS body FROM q),
m AS (
  SELECT conv_id, turn, role, '<|' || role || '|>' || chr(10) || string_agg(body, '' ORDER BY pos) || '<|end|>' || chr(10) AS m,
    sum(tokens) + 4 AS tokens, list({'placeholder': kind || '_' || k, 'ref': ref, 'tokens': tokens} ORDER BY pos) FILTER (WHERE kind <> 'text') AS refs, count(*) FILTER (WHERE kind <> 'text') AS n
  FROM f GROUP BY conv_id, turn, role)
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns, string_agg(m, '' ORDER BY turn, role) AS formatted, coalesce(CAST(to_json(flatten(list(refs ORDER BY turn, role) FILTER (WHERE refs IS NOT NULL))) AS VARCHAR), '[]') AS attachments,
  CAST(sum(n) AS INTEGER) AS n_attachments, CAST(sum(tokens) AS BIGINT) AS n_tokens
FROM m GROUP BY conv_id
"""

_RECORD = """
  SELECT page_id, page_id // 1024 AS f, 'WARC/1.1' || e || 'WARC-Type: response' || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e || 'WARC-Target-URI: ' || coalesce(url, '') || e
    || 'Content-Type: text/html' || e || 'Content-Length: ' || strlen(coalesce(html, '')) || e || e || coalesce(html, '') || e || e AS rec
  FROM {source}, (SELECT chr(13) || chr(10) AS e)"""
_PLACED = "SELECT page_id, f, sha256(rec) AS digest, sum(strlen(rec)) OVER (PARTITION BY f ORDER BY page_id) AS y, strlen(rec) AS n FROM ({})"

OP7 = f"""
WITH damaged AS (
  SELECT page_id, url, CASE WHEN page_id % 97 = 13 THEN substr(html, 1, length(html) // 2) || chr(0) || substr(html, length(html) // 2 + 2)
    WHEN page_id % 211 = 7 THEN substr(html, 1, length(html) - 10) ELSE html END AS html FROM pages),
a AS ({_PLACED.format(_RECORD.format(source="pages"))}),
b AS ({_PLACED.format(_RECORD.format(source="damaged"))})
SELECT a.f AS warc_file, page_id, CAST(a.y - a.n AS BIGINT) AS start_offset, CAST(a.y AS BIGINT) AS end_offset, CASE WHEN a.digest <> b.digest THEN 'changed' ELSE 'moved' END AS state
FROM a JOIN b USING (page_id) WHERE a.digest <> b.digest OR a.y <> b.y OR a.n <> b.n
"""

_LAID = "SELECT page_id, f, digest, y - n AS s, y AS e FROM (SELECT *, sum(n) OVER (PARTITION BY f ORDER BY page_id, digest ROWS UNBOUNDED PRECEDING) AS y FROM (SELECT page_id, f, sha256(rec) AS digest, strlen(rec) AS n FROM ({})))"

OP7_LOSSES = f"""
WITH damaged AS (
  SELECT page_id, url, CASE WHEN page_id % 97 = 13 THEN substr(html, 1, length(html) // 2) || chr(0) || substr(html, length(html) // 2 + 2)
    WHEN page_id % 211 = 7 THEN substr(html, 1, length(html) - 10) ELSE html END AS html FROM pages),
incomplete AS (SELECT page_id, url, html FROM damaged WHERE page_id % 61 <> 41 UNION ALL SELECT page_id, url || '#again', html FROM pages WHERE page_id % 83 = 29),
a AS (SELECT *, row_number() OVER (PARTITION BY f, page_id, digest ORDER BY s) AS k, 0 AS side FROM ({_LAID.format(_RECORD.format(source="pages"))})),
b AS (SELECT *, row_number() OVER (PARTITION BY f, page_id, digest ORDER BY s) AS k, 1 AS side FROM ({_LAID.format(_RECORD.format(source="incomplete"))})),
rest AS (
  SELECT *, row_number() OVER (PARTITION BY f, page_id, side ORDER BY digest, s) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) r
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM a UNION ALL SELECT * FROM b) o WHERE o.f = r.f AND o.page_id = r.page_id AND o.digest = r.digest AND o.k = r.k AND o.side <> r.side)),
found AS (
  SELECT a.f, a.page_id, a.s, a.e, 'moved' AS state FROM a JOIN b USING (f, page_id, digest, k) WHERE a.s <> b.s OR a.e <> b.e
  UNION ALL SELECT coalesce(x.f, y.f), coalesce(x.page_id, y.page_id), coalesce(x.s, y.s), coalesce(x.e, y.e), CASE WHEN x.f IS NULL THEN 'extra' WHEN y.f IS NULL THEN 'missing' ELSE 'changed' END
  FROM (SELECT * FROM rest WHERE side = 0) x FULL JOIN (SELECT * FROM rest WHERE side = 1) y ON x.f = y.f AND x.page_id = y.page_id AND x.n = y.n)
SELECT f AS warc_file, page_id, CAST(s AS BIGINT) AS start_offset, CAST(e AS BIGINT) AS end_offset, state FROM found
"""

OP10 = """
SELECT doc_id, keep_doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_doc_id FROM documents) WHERE doc_id <> keep_doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_document_edits": OP1_EDITS, "op1_document_fingerprints": OP1, "op3_mixing": OP3, "op5_chat_formatting": OP5, "op7_warc_fixity": OP7, "op7_warc_losses": OP7_LOSSES, "op10_exact_dedup": OP10}
