"""Registered queries: text scans and redaction over documents/pages/conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.operators import text
from lakeward.plans.registry import query
from lakeward.sources.tables import read_table


def corpus_lines(spark, d) -> DataFrame:
    """All lines of every document and page, tagged with their source table."""
    docs = read_table(spark, d, "documents").select(
        F.lit("documents").alias("source"), F.col("doc_id").alias("item_id"), F.col("text").alias("body")
    )
    pages = read_table(spark, d, "pages").select(
        F.lit("pages").alias("source"), F.col("page_id").alias("item_id"), F.col("html").alias("body")
    )
    return text.text_lines(planted(docs.unionByName(pages)), ["source", "item_id"], "body")


# Lines added to an item by its id modulo 50, so that every rule meets its input.
PLANTED = {
    7: "\nBearer " + "a1" * 12,
    9: "\r\t# roles/owner in a comment, me@gmail.com",
    11: "\x0bgcloud add-iam-policy-binding p --role roles/owner\n",
    13: "\u2028x --key-file k.json",
    15: "\r\n-----BEGIN RSA PRIVATE KEY-----\nrole: roles/editor",
}


def planted(items: DataFrame) -> DataFrame:
    extra = F.create_map(*[x for k, v in PLANTED.items() for x in (F.lit(k), F.lit(v))])[(F.col("item_id") % 50).cast("int")]
    return items.withColumn("body", F.concat("body", F.coalesce(extra, F.lit(""))))


def _sql_regex(p: str) -> str:
    return p.replace("'", "''")


def _chars(value: str) -> str:
    return " || ".join(f"chr({ord(c)})" if ord(c) < 32 or ord(c) > 126 else f"'{c}'" for c in value)


O_LINES = (
    "extra(k, added) AS (VALUES "
    + ", ".join(f"({k}, {_chars(v)})" for k, v in PLANTED.items())
    + f"""),
items AS (SELECT 'documents' AS source, doc_id AS item_id, text AS body FROM documents
          UNION ALL SELECT 'pages', page_id, html FROM pages),
parted AS (
  SELECT source, item_id, regexp_split_to_array(body || coalesce(added, ''), '{text.LINE_END}') AS parts
  FROM items LEFT JOIN extra ON k = item_id % 50),
lines AS (
  SELECT source, item_id, unnest(range(1, n + 1)) AS line_no, unnest(parts[:n]) AS line
  FROM (SELECT *, len(parts) - (parts[-1] = '')::INT AS n FROM parted))"""
)

SECRET_SQL = (
    "WITH "
    + O_LINES
    + "\n"
    + "\nUNION ALL ".join(
        f"SELECT source, item_id, line_no, '{r}' AS reason FROM lines WHERE regexp_matches(line, '{_sql_regex(p)}')"
        for p, r in text.SECRET_PATTERNS
    )
)


@query("secret_scan", SECRET_SQL)
def q_secret_scan(spark, d):
    return text.secret_scan(corpus_lines(spark, d), ["source", "item_id"])


GRANT_SQL = (
    "WITH "
    + O_LINES
    + ", nc AS (SELECT * FROM lines WHERE NOT regexp_matches(line, '^\\s*#'))\n"
    + "\nUNION ALL ".join(
        f"""SELECT source, item_id, line_no, 'grants prohibited {r}' AS reason FROM nc
            WHERE contains(line, '{r}') AND (contains(line, 'add-iam-policy-binding') OR contains(lower(line), 'role'))"""
        for r in text.PROHIBITED_ROLES
    )
    + """\nUNION ALL SELECT source, item_id, line_no, 'creates/uses a service-account key' FROM nc
        WHERE contains(line, 'iam service-accounts keys create') OR contains(line, '--key-file')"""
)


@query("grant_scan", GRANT_SQL)
def q_grant_scan(spark, d):
    return text.grant_scan(corpus_lines(spark, d), ["source", "item_id"])


def _redact_sql(col: str) -> str:
    out = col
    for p, icase in text.REDACTION_PATTERNS:
        out = f"regexp_replace({out}, '{_sql_regex(p)}', '[REDACTED]', '{'gi' if icase else 'g'}')"
    out = f"regexp_replace({out}, '^\\s+|\\s+$', '', 'g')"
    return out


@query(
    "redact_messages",
    f"""SELECT conv_id, turn, role,
          CASE WHEN text IS NULL OR text = '' OR r = '' THEN NULL
               WHEN length(r) > 2000 THEN substr(r, 1, 1997) || '...' ELSE r END AS message
        FROM (SELECT *, {_redact_sql('text')} AS r FROM conversations)""",
)
def q_redact_messages(spark, d):
    conv = read_table(spark, d, "conversations")
    return conv.select("conv_id", "turn", "role", text.redact(F.col("text")).alias("message"))
