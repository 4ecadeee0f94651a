"""Contract checks on the customer and the order feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedweave.functions import json_values as J
from feedweave.operators import drift as D
from feedweave.operators.contract import CUSTOMERS, ORDERS
from feedweave.operators.contract import contract_fields as contract_relation
from workload.derived import derived, derived_sql

FEED = {"customers": ("customer_feed", CUSTOMERS), "orders": ("order_feed", ORDERS)}


def _both(spark, sf_dir, check):
    customers = check(derived(spark, sf_dir, "customer_feed").drop("flaw"), CUSTOMERS)
    orders = check(derived(spark, sf_dir, "order_feed").drop("flaw"), ORDERS)
    return customers.unionByName(orders)


def contract_fields(spark, sf_dir):
    """The contracts with the number of payloads that carry each declared field.

    Payloads are counted as maps of declared paths, so the counts are one aggregate over the feed.
    """
    counts = None
    for feed, (name, contract) in FEED.items():
        parsed = derived(spark, sf_dir, name).withColumn("_doc", J.parse(F.col("payload")))
        present = [F.count(J.node(F.col("_doc"), f.path)).alias(f.path.replace(".", "_")) for f in contract.fields]
        wide = parsed.agg(*present)
        pairs = F.array(
            *[F.struct(F.lit(f.path).alias("path"), F.col(f.path.replace(".", "_")).alias("payloads")) for f in contract.fields]
        )
        tall = wide.select(F.lit(feed).alias("feed"), F.inline(pairs))
        counts = tall if counts is None else counts.unionByName(tall)
    relation = contract_relation(spark, CUSTOMERS, ORDERS)
    return relation.join(counts, ["feed", "path"]).select(
        "feed", "ord", "path", "parent", "name", "type", "required", F.array_join(F.array_sort("allowed"), "|").alias("allowed"), "payloads"
    )


def _findings(df):
    """Findings as rows, in their order within the record."""
    return df.select("feed", "arrival_seq", F.posexplode("findings").alias("finding_no", "f")).select(
        "feed", "arrival_seq", "finding_no", "f.*"
    )


def _check(check):
    return lambda spark, sf_dir: _findings(_both(spark, sf_dir, check))


def drift_renamed(spark, sf_dir):
    found = _findings(_both(spark, sf_dir, D.drift_findings).drop("_document"))
    return found.where(F.col("kind") == D.RENAMED).drop("finding_no")


def drift_fingerprint(spark, sf_dir):
    found = D.drift_fingerprint(_both(spark, sf_dir, lambda r, c: D.drift_findings(r, c).drop("_document")))
    return found.groupBy("feed", "severity", "fingerprint").agg(
        F.count(F.lit(1)).alias("findings"), F.countDistinct("business_key").alias("keys"),
        F.unix_micros(F.min("source_updated_at")).alias("first_us"),
    )


def drift_route(spark, sf_dir):
    routed = _both(spark, sf_dir, lambda r, c: D.drift_route(r, c).drop("_document"))
    return routed.select("feed", "arrival_seq", "route", "drift_detected", F.col("drift_details").alias("details"))


# Fixed values, written out here so that a changed contract is noticed: feed, position, path, parent, name, type, required, allowed.
CONTRACT_ROWS = """
  ('customers', 0, 'id', '', 'id', 'STRING', True, NULL),
  ('customers', 1, 'email', '', 'email', 'STRING', True, NULL),
  ('customers', 2, 'firstName', '', 'firstName', 'STRING', True, NULL),
  ('customers', 3, 'lastName', '', 'lastName', 'STRING', True, NULL),
  ('customers', 4, 'status', '', 'status', 'STRING', True, 'ACTIVE|CHURNED|INACTIVE'),
  ('customers', 5, 'tier', '', 'tier', 'STRING', True, 'BRONZE|GOLD|PLATINUM|SILVER'),
  ('customers', 6, 'address', '', 'address', 'OBJECT', True, NULL),
  ('customers', 7, 'address.line1', 'address', 'line1', 'STRING', True, NULL),
  ('customers', 8, 'address.line2', 'address', 'line2', 'STRING', False, NULL),
  ('customers', 9, 'address.city', 'address', 'city', 'STRING', True, NULL),
  ('customers', 10, 'address.postalCode', 'address', 'postalCode', 'STRING', True, NULL),
  ('customers', 11, 'address.country', 'address', 'country', 'STRING', True, NULL),
  ('customers', 12, 'tags', '', 'tags', 'ARRAY', False, NULL),
  ('customers', 13, 'createdAt', '', 'createdAt', 'STRING', True, NULL),
  ('customers', 14, 'updatedAt', '', 'updatedAt', 'STRING', True, NULL),
  ('customers', 15, 'deleted', '', 'deleted', 'BOOLEAN', False, NULL),
  ('orders', 0, 'id', '', 'id', 'STRING', True, NULL),
  ('orders', 1, 'customerId', '', 'customerId', 'STRING', True, NULL),
  ('orders', 2, 'status', '', 'status', 'STRING', True, 'CANCELLED|DELIVERED|PAID|PENDING|SHIPPED'),
  ('orders', 3, 'total', '', 'total', 'OBJECT', True, NULL),
  ('orders', 4, 'total.amount', 'total', 'amount', 'STRING', True, NULL),
  ('orders', 5, 'total.currency', 'total', 'currency', 'STRING', True, NULL),
  ('orders', 6, 'lines', '', 'lines', 'ARRAY', True, NULL),
  ('orders', 7, 'placedAt', '', 'placedAt', 'STRING', True, NULL),
  ('orders', 8, 'updatedAt', '', 'updatedAt', 'STRING', True, NULL),
  ('orders', 9, 'deleted', '', 'deleted', 'BOOLEAN', False, NULL)"""

JSON_TYPE = """CASE {t} WHEN 'VARCHAR' THEN 'STRING' WHEN 'BIGINT' THEN 'NUMBER' WHEN 'UBIGINT' THEN 'NUMBER'
  WHEN 'HUGEINT' THEN 'NUMBER' WHEN 'DOUBLE' THEN 'NUMBER' WHEN 'BOOLEAN' THEN 'BOOLEAN' WHEN 'ARRAY' THEN 'ARRAY' ELSE 'OBJECT' END"""
# Contract against payloads as a relational join: one row per record and declared field, one per record and added name.
CONTRACT_SQL = f"""
contract(feed, ord, path, parent, name, type, required, allowed) AS (VALUES {CONTRACT_ROWS}),
records AS (SELECT feed, arrival_seq, business_key, source_updated_at, deleted, CAST(payload AS JSON) AS doc
  FROM ({derived_sql('customer_feed')}) AS c
  UNION ALL SELECT feed, arrival_seq, business_key, source_updated_at, deleted, CAST(payload AS JSON) FROM ({derived_sql('order_feed')}) AS o),
fields AS (SELECT r.feed, r.arrival_seq, c.ord, c.path, c.type, c.required, c.allowed,
    json_type(r.doc, '$.' || c.path) AS raw_type, json_extract_string(r.doc, '$.' || c.path) AS value
  FROM records AS r JOIN contract AS c ON c.feed = r.feed),
typed AS (SELECT *, raw_type IS NULL OR raw_type = 'NULL' AS absent, {JSON_TYPE.format(t='raw_type')} AS actual_type FROM fields),
missing AS (SELECT feed, arrival_seq, ord, 'FIELD_MISSING' AS kind, path AS field, type AS expected, CAST(NULL AS VARCHAR) AS actual,
    'required field ''' || path || ''' is missing' AS details FROM typed WHERE absent AND required),
retyped AS (SELECT feed, arrival_seq, ord, 'FIELD_RETYPED' AS kind, path AS field, type AS expected, actual_type AS actual,
    'field ''' || path || ''' is ' || actual_type || ', expected ' || type AS details FROM typed WHERE NOT absent AND actual_type <> type),
domain AS (SELECT feed, arrival_seq, ord, 'VALUE_OUT_OF_DOMAIN' AS kind, path AS field, allowed AS expected, value AS actual,
    'field ''' || path || ''' has value ''' || value || ''' outside [' || replace(allowed, '|', ', ') || ']' AS details
  FROM typed WHERE NOT absent AND actual_type = type AND allowed IS NOT NULL AND NOT list_contains(string_split(allowed, '|'), value)),
root_names AS (SELECT feed, arrival_seq, doc, unnest(json_keys(doc)) AS name, generate_subscripts(json_keys(doc), 1) AS pos FROM records),
names AS (
  SELECT feed, arrival_seq, doc, name, '' AS parent, name AS path, pos * 1000 AS pos FROM root_names
  UNION ALL
  SELECT feed, arrival_seq, doc, unnest(json_keys(doc, '$.' || path)) AS name, path AS parent, path || '.' || unnest(json_keys(doc, '$.' || path)) AS path,
    pos * 1000 + generate_subscripts(json_keys(doc, '$.' || path), 1) AS pos
  FROM (SELECT r.*, c.path FROM root_names AS r JOIN contract AS c ON c.feed = r.feed AND c.path = r.name AND c.type = 'OBJECT'
        WHERE json_type(r.doc, '$.' || c.path) = 'OBJECT') AS nested),
added AS (SELECT n.feed, n.arrival_seq, 100 + pos AS ord, 'FIELD_ADDED' AS kind, n.path AS field, CAST(NULL AS VARCHAR) AS expected,
    {JSON_TYPE.format(t="json_type(doc, '$.' || n.path)")} AS actual, 'unexpected field ''' || n.path || '''' AS details
  FROM names AS n LEFT JOIN contract AS c ON c.feed = n.feed AND c.path = n.path WHERE c.path IS NULL),
-- The feeds never offer two candidates for one missing field, nor one candidate to two: a plain join pairs them.
pairs AS (SELECT m.feed, m.arrival_seq, m.ord, m.field AS old, a.field AS new
  FROM missing AS m JOIN added AS a ON a.feed = m.feed AND a.arrival_seq = m.arrival_seq
   AND regexp_extract(m.field, '^(?:(.*)[.])?[^.]*$', 1) = regexp_extract(a.field, '^(?:(.*)[.])?[^.]*$', 1)
   AND (contains(lower(regexp_extract(m.field, '[^.]*$')), lower(regexp_extract(a.field, '[^.]*$')))
     OR contains(lower(regexp_extract(a.field, '[^.]*$')), lower(regexp_extract(m.field, '[^.]*$'))))),
findings AS (
  SELECT * FROM missing WHERE (feed, arrival_seq, field) NOT IN (SELECT feed, arrival_seq, old FROM pairs)
  UNION ALL SELECT * FROM retyped UNION ALL SELECT * FROM domain
  UNION ALL SELECT * FROM added WHERE (feed, arrival_seq, field) NOT IN (SELECT feed, arrival_seq, new FROM pairs)
  UNION ALL SELECT feed, arrival_seq, 100000000 + ord, 'FIELD_RENAMED', old, old, new,
    'field ''' || old || ''' appears to be renamed to ''' || new || '''' FROM pairs)"""


def _rows_sql(relation: str) -> str:
    return f"""WITH {CONTRACT_SQL} SELECT feed, arrival_seq, CAST(row_number() OVER (PARTITION BY feed, arrival_seq ORDER BY ord) - 1 AS INTEGER)
        AS finding_no, kind, field, expected, actual, details FROM {relation}"""


FINGERPRINTED = """prints AS (SELECT f.*, r.business_key, r.source_updated_at, r.deleted,
  CASE WHEN kind = 'FIELD_ADDED' THEN 'WARNING' ELSE 'BLOCKING' END AS severity,
  left(kind || ':' || field || ':' || coalesce(expected, '-') || '->' || coalesce(actual, '-'), 256) AS fingerprint
  FROM findings AS f JOIN records AS r USING (feed, arrival_seq))"""

QUERIES = {
    "contract_fields": contract_fields,
    "drift_missing": _check(D.drift_missing),
    "drift_retyped": _check(D.drift_retyped),
    "drift_out_of_domain": _check(D.drift_out_of_domain),
    "drift_added": _check(D.drift_added),
    "drift_renamed": drift_renamed,
    "drift_findings": _check(lambda r, c: D.drift_findings(r, c).drop("_document")),
    "drift_fingerprint": drift_fingerprint,
    "drift_route": drift_route,
}
ORACLES = {
    "contract_fields": f"""WITH {CONTRACT_SQL} SELECT c.feed, c.ord, c.path, c.parent, c.name, c.type, c.required, c.allowed,
        count(raw_type) AS payloads FROM contract AS c JOIN typed AS t ON t.feed = c.feed AND t.path = c.path GROUP BY ALL""",
    "drift_missing": _rows_sql("missing"),
    "drift_retyped": _rows_sql("retyped"),
    "drift_out_of_domain": _rows_sql("domain"),
    "drift_added": _rows_sql("added"),
    "drift_renamed": f"""WITH {CONTRACT_SQL} SELECT feed, arrival_seq, kind, field, expected, actual, details FROM findings
        WHERE kind = 'FIELD_RENAMED'""",
    "drift_findings": _rows_sql("findings"),
    "drift_fingerprint": f"""WITH {CONTRACT_SQL}, {FINGERPRINTED} SELECT feed, severity, fingerprint, count(*) AS findings,
        count(DISTINCT business_key) AS keys, epoch_us(min(source_updated_at)) AS first_us FROM prints GROUP BY ALL""",
    "drift_route": f"""WITH {CONTRACT_SQL}, {FINGERPRINTED}, per_record AS (
        SELECT feed, arrival_seq, bool_or(severity = 'BLOCKING') AS blocking, string_agg(details, '; ' ORDER BY ord) AS details
        FROM prints WHERE NOT deleted GROUP BY 1, 2)
        SELECT r.feed, r.arrival_seq, CASE WHEN deleted THEN 'BYPASS' WHEN blocking THEN 'QUARANTINE' ELSE 'CONTINUE' END AS route,
          blocking IS NOT NULL AS drift_detected, CASE WHEN blocking THEN details END AS details
        FROM records AS r LEFT JOIN per_record AS p USING (feed, arrival_seq)""",
}
