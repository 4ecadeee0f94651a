"""Reading, mapping and checking payloads; projecting canonical records to destination rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedweave.feeds import CUSTOMER_DESTINATION, ORDER_DESTINATION
from feedweave.functions.money import is_decimal_text
from feedweave.functions.money import to_minor_units as minor_units
from feedweave.operators import destination as X
from feedweave.operators import mapping as MP
from feedweave.operators import validation as V
from feedweave.operators.drift import DOCUMENT, with_document
from workload.derived import derived, derived_sql
from workload.tables import table


def _listed(errors):
    return F.array_join(F.transform(errors, lambda e: F.concat(e["field"], F.lit(": "), e["message"])), "; ")


def _us(column, name):
    return F.unix_micros(column).alias(name)


def mapped_customers(spark, sf_dir):
    return MP.map_customer(derived(spark, sf_dir, "customer_feed"))


def mapped_orders(spark, sf_dir):
    return MP.map_order(derived(spark, sf_dir, "order_feed"))


def payload_fields(spark, sf_dir):
    customers = with_document(derived(spark, sf_dir, "customer_feed"))
    raw = MP.PayloadFields.raw(F.col(DOCUMENT), text=["email", "status"], instant=["createdAt"], list=["tags"])
    read = MP.PayloadFields(F.col("_raw"))
    email, e1 = read.text("email")
    status, e2 = read.choice("status", MP.LIFECYCLES)
    created, e3 = read.instant("createdAt")
    tags, e4 = read.text_list("tags")
    first = customers.withColumn("_raw", F.when(F.lit(True), raw)).select(
        "feed",
        "arrival_seq",
        F.concat_ws("|", email, status, F.unix_micros(created), F.array_join(tags, ",")).alias("read_values"),
        _listed(V.collect(e1, e2, e3, e4)).alias("problems"),
    )
    orders = with_document(derived(spark, sf_dir, "order_feed"))
    raw = MP.PayloadFields.raw(F.col(DOCUMENT), text=["status"], amount=["total.amount"], list=["lines"])
    status, e1 = read.choice("status", MP.ORDER_STATES)
    amount, e2 = read.minor_units("total.amount")
    lines, e3 = read.objects("lines")
    second = orders.withColumn("_raw", F.when(F.lit(True), raw)).select(
        "feed",
        "arrival_seq",
        F.concat_ws("|", status, amount, F.coalesce(F.size(lines), F.lit(0))).alias("read_values"),
        _listed(V.collect(e1, e2, e3)).alias("problems"),
    )
    return first.unionByName(second)


def map_customer(spark, sf_dir):
    c = F.col("canonical")
    return mapped_customers(spark, sf_dir).select(
        "arrival_seq",
        "failure_kind",
        _listed(F.col("errors")).alias("errors"),
        *[c[n].alias(n) for n in ("email", "given_name", "family_name", "lifecycle", "tier")],
        *[c["address"][n].alias(n) for n in ("street", "city", "postal_code", "country_code")],
        F.array_join(c["tags"], ",").alias("tags"),
        _us(c["created_at"], "created_us"),
        _us(c["updated_at"], "updated_us"),
    )


def map_order(spark, sf_dir):
    c = F.col("canonical")
    line = F.transform(c["lines"], lambda x: F.concat_ws("*", x["sku"], x["quantity"], x["unit_price_minor"]))
    return mapped_orders(spark, sf_dir).select(
        "arrival_seq",
        "failure_kind",
        _listed(F.col("errors")).alias("errors"),
        c["customer_key"].alias("customer_key"),
        c["state"].alias("state"),
        c["total"]["amount_minor"].alias("total_minor"),
        c["total"]["currency"].alias("currency"),
        F.array_join(line, ",").alias("lines"),
        _us(c["placed_at"], "placed_us"),
        _us(c["updated_at"], "updated_us"),
    )


def map_tombstone(spark, sf_dir):
    feeds = derived(spark, sf_dir, "customer_feed").unionByName(derived(spark, sf_dir, "order_feed"))
    return MP.map_tombstone(feeds).select(
        "feed", "business_key", _us("source_updated_at", "clock_us"), "arrival_seq", "is_delete"
    )


def mapping_failures(spark, sf_dir):
    columns = ["feed", "arrival_seq", "failure_kind", "reason", "message"]
    customers = MP.mapping_failures(mapped_customers(spark, sf_dir)).select(*columns)
    return customers.unionByName(MP.mapping_failures(mapped_orders(spark, sf_dir)).select(*columns))


# Amounts in many spellings, made from the order total.
AMOUNTS = """
SELECT o_orderkey, CASE o_orderkey % 16
    WHEN 0 THEN price || '5' WHEN 1 THEN price || '00' WHEN 2 THEN '-' || price WHEN 3 THEN '+' || price
    WHEN 4 THEN digits || 'e2' WHEN 5 THEN digits || 'E-2' WHEN 6 THEN digits || 'e-3' WHEN 7 THEN ' ' || price
    WHEN 8 THEN 'n/a' WHEN 9 THEN digits || digits || digits WHEN 10 THEN '.' || digits WHEN 11 THEN digits || '.'
    WHEN 12 THEN '0.000' WHEN 13 THEN '' WHEN 14 THEN '000' || price ELSE price END AS amount
FROM (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS STRING) AS price,
             CAST(o_orderkey + 1000000 AS STRING) AS digits FROM {orders}) AS priced
"""


def to_minor_units(spark, sf_dir):
    amounts = spark.sql(AMOUNTS, orders=table(spark, sf_dir, "orders"))
    units, problem = minor_units(F.col("amount"))
    readable = is_decimal_text(F.col("amount"))
    return amounts.select(
        "o_orderkey",
        "amount",
        F.when(readable & problem.isNull(), units).alias("minor_units"),
        F.when(~readable, F.lit("not a decimal")).otherwise(problem).alias("problem"),
    )


ADDRESSES = """
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '  ' ELSE c_name END AS street,
       CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS city,
       CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE CAST(c_nationkey AS STRING) END AS postal_code,
       CASE WHEN c_custkey % 3 = 0 THEN substr(c_mktsegment, 1, 3) WHEN c_custkey % 13 = 0 THEN lower(substr(c_mktsegment, 1, 2))
            ELSE substr(c_mktsegment, 1, 2) END AS country_code
FROM {customer}
"""
CUSTOMERS = """
SELECT c_custkey, CASE WHEN c_custkey % 19 = 0 THEN ' ' ELSE 'k' END AS business_key,
       CASE WHEN c_custkey % 4 = 0 THEN 'a b@x.org' WHEN c_custkey % 4 = 1 THEN lower(c_mktsegment) || '@x' ELSE c_mktsegment || '@x.org' END AS email,
       CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_name END AS given_name,
       CASE WHEN c_custkey % 10 = 0 THEN ' ' ELSE c_name END AS family_name,
       c_nationkey AS created, 12 AS updated, CASE WHEN c_custkey % 6 = 0 THEN ' ' ELSE 'vip' END AS tag
FROM {customer}
"""
LINES = """
SELECT o_orderkey, o_orderkey % 4 AS line_count, CAST(o_orderkey % 7 - 1 AS INT) AS quantity, o_orderkey % 11 - 2 AS unit_price,
       CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE 'sku' END AS sku,
       CAST(CAST(o_totalprice AS DECIMAL(18, 2)) * 100 AS BIGINT) - 20000000 AS amount,
       CASE WHEN o_orderkey % 3 = 0 THEN 'EUR' WHEN o_orderkey % 3 = 1 THEN 'eur' ELSE 'EURO' END AS currency,
       o_custkey % 10 AS placed, CASE WHEN o_custkey % 8 = 0 THEN '' ELSE 'cus' END AS customer_key
FROM {orders}
"""


def validate_address(spark, sf_dir):
    rows = spark.sql(ADDRESSES, customer=table(spark, sf_dir, "customer"))
    address = F.struct("street", "city", "postal_code", "country_code")
    return rows.select("c_custkey", _listed(V.validate_address(address)).alias("errors"))


def validate_customer(spark, sf_dir):
    rows = spark.sql(CUSTOMERS, customer=table(spark, sf_dir, "customer"))
    customer = F.struct(
        "business_key",
        "email",
        "given_name",
        "family_name",
        F.timestamp_seconds("updated").alias("updated_at"),
        F.timestamp_seconds("created").alias("created_at"),
        F.array("tag").alias("tags"),
    )
    return rows.select("c_custkey", _listed(V.validate_customer(customer)).alias("errors"))


def validate_money(spark, sf_dir):
    rows = spark.sql(LINES, orders=table(spark, sf_dir, "orders"))
    return rows.select("o_orderkey", _listed(V.validate_money(F.col("amount"), F.col("currency"))).alias("errors"))


def _order_lines():
    first = F.struct(F.lit("ok").alias("sku"), F.lit(2).alias("quantity"), F.lit(5).cast("bigint").alias("unit_price_minor"))
    other = F.struct("sku", "quantity", F.col("unit_price").alias("unit_price_minor"))
    return F.slice(F.array(first, other, other), F.lit(1), F.col("line_count").cast("int"))


def validate_order_lines(spark, sf_dir):
    rows = spark.sql(LINES, orders=table(spark, sf_dir, "orders")).withColumn("lines", _order_lines())
    return rows.select("o_orderkey", _listed(V.validate_order_lines(F.col("lines"))).alias("errors"))


def validate_order(spark, sf_dir):
    rows = spark.sql(LINES, orders=table(spark, sf_dir, "orders")).withColumn("lines", _order_lines())
    order = F.struct(
        F.lit("ord").alias("business_key"),
        "customer_key",
        "lines",
        F.struct(F.lit(10).cast("bigint").alias("amount_minor")).alias("total"),
        F.timestamp_seconds(F.lit(5)).alias("updated_at"),
        F.timestamp_seconds("placed").alias("placed_at"),
    )
    return rows.select("o_orderkey", _listed(V.validate_order(order)).alias("errors"))


def project_customer_row(spark, sf_dir):
    rows = mapped_customers(spark, sf_dir).withColumn("r", X.project_customer_row(F.col("canonical")))
    shown = [n for n in CUSTOMER_DESTINATION.columns if n != "source_created_at"]
    return rows.where(F.col("canonical").isNotNull()).select(
        "arrival_seq", *[F.col(f"r.{n}").alias(n) for n in shown], _us("r.source_created_at", "source_created_us")
    )


def project_order_row(spark, sf_dir):
    rows = mapped_orders(spark, sf_dir).withColumn("r", X.project_order_row(F.col("canonical")))
    shown = [n for n in ORDER_DESTINATION.columns if n != "placed_at"]
    return rows.where(F.col("canonical").isNotNull()).select(
        "arrival_seq", *[F.col(f"r.{n}").alias(n) for n in shown], _us("r.placed_at", "placed_us")
    )


def customer_tier_view(spark, sf_dir):
    """Tier ranks as stored, some outside the known ones."""
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_custkey") % 7 - 1).cast("int").alias("tier_rank")
    )
    return X.customer_tier_view(customers)


def content_fingerprint(spark, sf_dir):
    rows = mapped_customers(spark, sf_dir).where(F.col("canonical").isNotNull())
    print_ = X.content_fingerprint(F.col("r"), CUSTOMER_DESTINATION.kinds)
    return rows.withColumn("r", X.project_customer_row(F.col("canonical"))).select(
        "arrival_seq", print_.alias("content_fingerprint")
    )


def _text(path: str) -> str:
    return f"CASE WHEN json_type(doc, '$.{path}') = 'VARCHAR' THEN json_extract_string(doc, '$.{path}') END"


def _instant(text: str) -> str:
    return f"CASE WHEN {text} LIKE '%T%Z' THEN TRY_CAST(replace(replace({text}, 'T', ' '), 'Z', '') AS TIMESTAMP) END"


def _errors(*cases: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} END" for c in cases) + "], lambda x: x IS NOT NULL)"


def _need(column: str, path: str) -> str:
    return f"{column} IS NULL THEN '{path}: missing or not a text'"


def _when(column: str, stamp: str, path: str) -> str:
    return (
        f"{stamp} IS NULL THEN '{path}: missing or not a ISO-8601 timestamp' "
        f"WHEN {column} IS NULL THEN '{path}: is not an ISO-8601 timestamp: ' || {stamp}"
    )


def _one_of(column: str, path: str, values) -> str:
    listed = ", ".join(values)
    quoted = ", ".join(f"'{v}'" for v in values)
    return (
        f"{column} IS NULL OR upper({column}) NOT IN ({quoted}) THEN '{path}: must be one of {listed} (was ''' || "
        f"coalesce({column}, 'null') || ''')'"
    )


def _blank(expression: str, field: str) -> str:
    return f"trim({expression}) = '' THEN '{field}: must not be blank'"


CUSTOMERS_SQL = f"""
records AS (SELECT *, CAST(payload AS JSON) AS doc FROM ({derived_sql('customer_feed')}) AS f),
raw AS (SELECT *, {_text('address.line1')} AS line1, {_text('address.line2')} AS line2, {_text('email')} AS mail, {_text('firstName')} AS fst,
  {_text('lastName')} AS lst, {_text('status')} AS sts, {_text('tier')} AS tr, {_text('address.city')} AS cty, {_text('address.postalCode')} AS pst,
  {_text('address.country')} AS ctr, {_text('createdAt')} AS created_text, {_text('updatedAt')} AS updated_text,
  json_type(doc, '$.tags') AS tag_type,
  CASE WHEN json_type(doc, '$.tags') = 'ARRAY' THEN list_transform(json_extract(doc, '$.tags[*]'), lambda x: coalesce(json_extract_string(x, '$'), 'null')) ELSE [] END AS tag_texts
  FROM records),
read AS (SELECT *, {_instant('created_text')} AS created_at, {_instant('updated_text')} AS updated_at,
  list_reduce(list_filter([line1, line2], lambda x: x IS NOT NULL AND trim(x) <> ''), lambda a, b: a || ', ' || b) AS street,
  list_filter(list_transform(tag_texts, lambda x: lower(trim(x))), lambda x: x <> '') AS tag_list FROM
  (SELECT *, CASE WHEN len(list_filter([line1, line2], lambda x: x IS NOT NULL AND trim(x) <> '')) = 0 THEN true ELSE false END AS no_street FROM raw) AS r
  WHERE NOT no_street
  UNION ALL BY NAME
  SELECT *, {_instant('created_text')} AS created_at, {_instant('updated_text')} AS updated_at, '' AS street,
  list_filter(list_transform(tag_texts, lambda x: lower(trim(x))), lambda x: x <> '') AS tag_list, true AS no_street FROM raw
  WHERE len(list_filter([line1, line2], lambda x: x IS NOT NULL AND trim(x) <> '')) = 0),
judged AS (SELECT *,
  {_errors(_need('line1', 'address.line1'), _need('mail', 'email'), _need('fst', 'firstName'), _need('lst', 'lastName'), _one_of('sts', 'status', MP.LIFECYCLES),
           _one_of('tr', 'tier', MP.TIERS), _need('cty', 'address.city'), _need('pst', 'address.postalCode'), _need('ctr', 'address.country'))} AS first_errors,
  {_errors(_blank('street', 'address.street'), _blank("coalesce(cty, '')", 'address.city'), _blank("coalesce(pst, '')", 'address.postalCode'),
           "NOT regexp_full_match(upper(trim(coalesce(ctr, ''))), '[A-Z]{2}') THEN 'address.countryCode: must be an ISO 3166-1 alpha-2 code'")} AS address_errors,
  {_errors("tag_type IS NOT NULL AND tag_type NOT IN ('NULL', 'ARRAY') THEN 'tags: must be an array'", _when('created_at', 'created_text', 'createdAt'),
           _when('updated_at', 'updated_text', 'updatedAt'))} AS rest_errors,
  {_errors("NOT regexp_full_match(lower(trim(mail)), '[^@ ]+@[^@ ]+[.][^@ ]+') THEN 'email: must be a valid email address'",
           _blank('fst', 'givenName'), _blank('lst', 'familyName'), "updated_at < created_at THEN 'updatedAt: must not be before createdAt'")} AS customer_errors
  FROM read),
verdict AS (SELECT *, CASE WHEN len(address_errors) > 0 THEN first_errors ELSE list_concat(first_errors, rest_errors) END AS unreadable,
  CASE WHEN len(address_errors) > 0 THEN address_errors ELSE customer_errors END AS violations FROM judged),
customers AS (SELECT *, CASE WHEN deleted THEN NULL WHEN len(unreadable) > 0 THEN 'UNMAPPABLE' WHEN len(violations) > 0 THEN 'INVALID' END AS failure_kind,
  CASE WHEN deleted THEN [] WHEN len(unreadable) > 0 THEN unreadable ELSE violations END AS errors FROM verdict)"""


def _amount(text: str) -> str:
    """Exact value of a decimal text, as a decimal wide enough for the texts here."""
    return f"CASE WHEN regexp_full_match({text}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST({text} AS DECIMAL(38, 8)) END"


def _amount_errors(value: str, path: str) -> str:
    head = f"'{path}: must have at most two decimal places and fit in minor units ('"
    return (
        f"{value} IS NULL THEN '{path}: missing or not a decimal' WHEN {value} * 100 <> floor({value} * 100) THEN {head} || 'Rounding necessary)' "
        f"WHEN abs({value}) > 92233720368547758 THEN {head} || 'Overflow)'"
    )


def _number_text(doc: str, path: str) -> str:
    return (
        f"CASE WHEN json_type({doc}, '{path}') IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE') THEN json_extract_string({doc}, '{path}') END"
    )


ORDERS_SQL = f"""
records AS (SELECT *, CAST(payload AS JSON) AS doc FROM ({derived_sql('order_feed')}) AS f),
line_rows AS (SELECT arrival_seq, unnest(json_extract(doc, '$.lines[*]')) AS line, generate_subscripts(json_extract(doc, '$.lines[*]'), 1) - 1 AS pos FROM records),
line_read AS (SELECT arrival_seq, pos, CASE WHEN json_type(line, '$.sku') = 'VARCHAR' THEN json_extract_string(line, '$.sku') END AS sku,
  CASE WHEN json_type(line, '$.quantity') IN ('BIGINT', 'UBIGINT') THEN CAST(json_extract_string(line, '$.quantity') AS BIGINT) END AS quantity,
  {_number_text('line', '$.unitPrice')} AS price_text, {_amount(_number_text('line', '$.unitPrice'))} AS price FROM line_rows),
line_judged AS (SELECT *, CASE WHEN price * 100 = floor(price * 100) THEN CAST(price * 100 AS BIGINT) ELSE 0 END AS minor,
  list_transform({_errors("sku IS NULL THEN 'sku: missing or not a text'", "quantity IS NULL THEN 'quantity: missing or not a integer'", _amount_errors('price', 'unitPrice'))},
    lambda x: 'lines[' || pos || '].' || x) AS unreadable FROM line_read),
line_checked AS (SELECT *, {_errors(_blank("coalesce(sku, '')", 'lines.sku'), "coalesce(quantity, 0) <= 0 THEN 'lines.quantity: must be positive'",
    "minor < 0 THEN 'lines.unitPriceMinor: must not be negative'")} AS broken FROM line_judged),
line_stop AS (SELECT arrival_seq, min(CASE WHEN len(broken) > 0 THEN pos END) AS stop FROM line_checked GROUP BY 1),
line_sum AS (SELECT c.arrival_seq, count(*) AS line_count, any_value(stop) AS stop, sum(quantity * minor) AS total_of_lines,
  flatten(list(unreadable ORDER BY pos) FILTER (WHERE stop IS NULL OR pos <= stop)) AS line_unreadable,
  any_value(broken) FILTER (WHERE pos = stop) AS line_broken,
  string_agg(sku || '*' || quantity || '*' || minor, ',' ORDER BY pos) AS lines_text,
  '[' || string_agg('{{"sku":"' || sku || '","qty":' || quantity || ',"unitMinor":' || minor || '}}', ',' ORDER BY pos) || ']' AS lines_json
  FROM line_checked AS c JOIN line_stop USING (arrival_seq) GROUP BY 1),
raw AS (SELECT r.*, l.line_count, l.stop, l.total_of_lines, l.line_unreadable, l.line_broken, l.lines_text, l.lines_json,
  {_text('customerId')} AS customer, {_text('status')} AS sts, {_text('total.currency')} AS cur, {_text('placedAt')} AS placed_text, {_text('updatedAt')} AS updated_text,
  {_number_text('doc', '$.total.amount')} AS amount_text, {_amount(_number_text('doc', '$.total.amount'))} AS amount, json_type(doc, '$.lines') AS lines_type
  FROM records AS r LEFT JOIN line_sum AS l USING (arrival_seq)),
read AS (SELECT *, {_instant('placed_text')} AS placed_at, {_instant('updated_text')} AS updated_at,
  CASE WHEN amount * 100 = floor(amount * 100) AND abs(amount) < 92233720368547758 THEN CAST(amount * 100 AS BIGINT) ELSE 0 END AS amount_minor FROM raw),
judged AS (SELECT *,
  {_errors(_need('customer', 'customerId'), _one_of('sts', 'status', MP.ORDER_STATES), _amount_errors('amount', 'total.amount'), _need('cur', 'total.currency'))} AS first_errors,
  {_errors("amount_minor < 0 THEN 'amountMinor: must not be negative'",
           "NOT regexp_full_match(upper(coalesce(cur, '')), '[A-Z]{3}') THEN 'currency: must be an ISO 4217 code'")} AS money_errors,
  CASE WHEN coalesce(lines_type, '') <> 'ARRAY' THEN ['lines: missing or not a array'] ELSE coalesce(line_unreadable, []) END AS line_errors,
  {_errors(_when('placed_at', 'placed_text', 'placedAt'), _when('updated_at', 'updated_text', 'updatedAt'))} AS rest_errors,
  {_errors(_blank('customer', 'customerKey'), "coalesce(line_count, 0) = 0 THEN 'lines: must contain at least one line'",
           "coalesce(total_of_lines, 0) <> amount_minor THEN 'total: must equal the sum of line totals (' || coalesce(total_of_lines, 0) || ')'",
           "updated_at < placed_at THEN 'updatedAt: must not be before placedAt'")} AS order_errors
  FROM read),
verdict AS (SELECT *,
  CASE WHEN len(money_errors) > 0 THEN first_errors WHEN stop IS NOT NULL THEN list_concat(first_errors, line_errors)
       ELSE list_concat(list_concat(first_errors, line_errors), rest_errors) END AS unreadable,
  CASE WHEN len(money_errors) > 0 THEN money_errors WHEN stop IS NOT NULL THEN line_broken ELSE order_errors END AS violations FROM judged),
orders_mapped AS (SELECT *, CASE WHEN deleted THEN NULL WHEN len(unreadable) > 0 THEN 'UNMAPPABLE' WHEN len(violations) > 0 THEN 'INVALID' END AS failure_kind,
  CASE WHEN deleted THEN [] WHEN len(unreadable) > 0 THEN unreadable ELSE violations END AS errors FROM verdict)"""

FINE = "NOT deleted AND failure_kind IS NULL"
CANONICAL_CUSTOMER = f"""SELECT *, lower(trim(mail)) AS email, trim(fst) AS given_name, trim(lst) AS family_name, upper(sts) AS lifecycle, upper(tr) AS tier,
  trim(cty) AS city, trim(pst) AS postal_code, upper(trim(ctr)) AS country_code FROM customers WHERE {FINE}"""
ROW_CUSTOMER = f"""SELECT arrival_seq, email AS email_address, given_name || ' ' || family_name AS full_name, given_name, family_name,
  CASE lifecycle WHEN 'ACTIVE' THEN 'A' WHEN 'INACTIVE' THEN 'I' ELSE 'C' END AS lifecycle_code,
  CASE tier WHEN 'BRONZE' THEN 1 WHEN 'SILVER' THEN 2 WHEN 'GOLD' THEN 3 ELSE 4 END AS tier_rank, street AS address_line, city, postal_code, country_code,
  coalesce(array_to_string(list_sort(list_distinct(tag_list)), ','), '') AS tags_csv, created_at FROM ({CANONICAL_CUSTOMER}) AS c"""
# Distinct tags in the order they first appear.
TAGS_IN_ORDER = "array_to_string(list_filter(tag_list, lambda x, i: list_position(tag_list, x) = i), ',')"


def _oracle_rules(source: str, table_name: str, key: str, errors: str) -> str:
    return f"WITH r AS ({source.format(**{table_name: table_name})}) SELECT {key}, array_to_string({errors}, '; ') AS errors FROM r"


LINE_BROKEN = _errors(_blank("sku", "lines.sku"), "quantity <= 0 THEN 'lines.quantity: must be positive'", "unit_price < 0 THEN 'lines.unitPriceMinor: must not be negative'")
ORDER_TOTAL = "CASE line_count WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 10 + quantity * unit_price ELSE 10 + 2 * quantity * unit_price END"

QUERIES = {
    "payload_fields": payload_fields,
    "map_customer": map_customer,
    "map_order": map_order,
    "to_minor_units": to_minor_units,
    "map_tombstone": map_tombstone,
    "validate_customer": validate_customer,
    "validate_address": validate_address,
    "validate_money": validate_money,
    "validate_order_lines": validate_order_lines,
    "validate_order": validate_order,
    "mapping_failures": mapping_failures,
    "project_customer_row": project_customer_row,
    "project_order_row": project_order_row,
    "customer_tier_view": customer_tier_view,
    "content_fingerprint": content_fingerprint,
}
ORACLES = {
    "payload_fields": f"""WITH {CUSTOMERS_SQL}, first AS (SELECT feed, arrival_seq,
          coalesce(mail, '') || '|' || CASE WHEN upper(sts) IN ('ACTIVE', 'INACTIVE', 'CHURNED') THEN upper(sts) ELSE 'ACTIVE' END || '|'
            || coalesce(epoch_us(created_at), 0) || '|' || array_to_string(tag_texts, ',') AS read_values,
          array_to_string({_errors(_need('mail', 'email'), _one_of('sts', 'status', MP.LIFECYCLES), _when('created_at', 'created_text', 'createdAt'),
            "tag_type IS NOT NULL AND tag_type NOT IN ('NULL', 'ARRAY') THEN 'tags: must be an array'")}, '; ') AS problems FROM customers),
        second AS (WITH {ORDERS_SQL} SELECT feed, arrival_seq, CASE WHEN upper(sts) IN ('PENDING', 'PAID', 'SHIPPED', 'DELIVERED', 'CANCELLED') THEN upper(sts) ELSE 'PENDING' END
            || '|' || amount_minor || '|' || coalesce(line_count, 0) AS read_values,
          array_to_string({_errors(_one_of('sts', 'status', MP.ORDER_STATES), _amount_errors('amount', 'total.amount'),
            "coalesce(lines_type, '') <> 'ARRAY' THEN 'lines: missing or not a array'")}, '; ') AS problems FROM orders_mapped)
        SELECT * FROM first UNION ALL SELECT * FROM second""",
    "map_customer": f"""WITH {CUSTOMERS_SQL}, fine AS (SELECT arrival_seq, email, given_name, family_name, lifecycle, tier, street, city, postal_code, country_code,
          {TAGS_IN_ORDER} AS tags, epoch_us(created_at) AS created_us, epoch_us(updated_at) AS updated_us FROM ({CANONICAL_CUSTOMER}) AS c)
        SELECT c.arrival_seq, c.failure_kind, array_to_string(c.errors, '; ') AS errors, email, given_name, family_name, lifecycle, tier, f.street, city, postal_code,
          country_code, f.tags, f.created_us, f.updated_us FROM customers AS c LEFT JOIN fine AS f USING (arrival_seq)""",
    "map_order": f"""WITH {ORDERS_SQL} SELECT arrival_seq, failure_kind, array_to_string(errors, '; ') AS errors,
          CASE WHEN {FINE} THEN customer END AS customer_key, CASE WHEN {FINE} THEN upper(sts) END AS state, CASE WHEN {FINE} THEN amount_minor END AS total_minor,
          CASE WHEN {FINE} THEN upper(cur) END AS currency, CASE WHEN {FINE} THEN lines_text END AS lines,
          CASE WHEN {FINE} THEN epoch_us(placed_at) END AS placed_us, CASE WHEN {FINE} THEN epoch_us(updated_at) END AS updated_us FROM orders_mapped""",
    "to_minor_units": f"""WITH amounts AS ({AMOUNTS.format(orders='orders')}), exact AS (SELECT *, {_amount('amount')} AS v FROM amounts)
        SELECT o_orderkey, amount, CASE WHEN v * 100 = floor(v * 100) AND abs(v) < 92233720368547758 THEN CAST(v * 100 AS BIGINT) END AS minor_units,
          CASE WHEN v IS NULL THEN 'not a decimal' WHEN v * 100 <> floor(v * 100) THEN 'Rounding necessary' WHEN abs(v) > 92233720368547758 THEN 'Overflow' END AS problem
        FROM exact""",
    "map_tombstone": f"""SELECT feed, business_key, epoch_us(source_updated_at) AS clock_us, arrival_seq, true AS is_delete
        FROM (SELECT feed, business_key, source_updated_at, arrival_seq, deleted FROM ({derived_sql('customer_feed')}) AS c
          UNION ALL SELECT feed, business_key, source_updated_at, arrival_seq, deleted FROM ({derived_sql('order_feed')}) AS o) AS r WHERE deleted""",
    "validate_customer": _oracle_rules(CUSTOMERS, "customer", "c_custkey", _errors(
        _blank("business_key", "businessKey"), "NOT regexp_full_match(lower(email), '[^@ ]+@[^@ ]+[.][^@ ]+') THEN 'email: must be a valid email address'",
        _blank("given_name", "givenName"), _blank("family_name", "familyName"), "created > updated THEN 'updatedAt: must not be before createdAt'",
        "trim(tag) = '' THEN 'tags: must not contain blank tags'")),
    "validate_address": _oracle_rules(ADDRESSES, "customer", "c_custkey", _errors(
        _blank("street", "address.street"), _blank("city", "address.city"), _blank("postal_code", "address.postalCode"),
        "NOT regexp_full_match(country_code, '[A-Z][A-Z]') THEN 'address.countryCode: must be an ISO 3166-1 alpha-2 code'")),
    "validate_money": _oracle_rules(LINES, "orders", "o_orderkey", _errors(
        "amount < 0 THEN 'amountMinor: must not be negative'", "currency <> 'EUR' THEN 'currency: must be an ISO 4217 code'")),
    "validate_order_lines": _oracle_rules(LINES, "orders", "o_orderkey", f"CASE WHEN line_count >= 2 THEN {LINE_BROKEN} ELSE [] END"),
    "validate_order": _oracle_rules(LINES, "orders", "o_orderkey", _errors(
        "customer_key = '' THEN 'customerKey: must not be blank'", "line_count = 0 THEN 'lines: must contain at least one line'",
        f"{ORDER_TOTAL} <> 10 THEN 'total: must equal the sum of line totals (' || ({ORDER_TOTAL}) || ')'",
        "placed > 5 THEN 'updatedAt: must not be before placedAt'")),
    "mapping_failures": f"""WITH c AS (WITH {CUSTOMERS_SQL} SELECT feed, arrival_seq, failure_kind, errors FROM customers),
        o AS (WITH {ORDERS_SQL} SELECT feed, arrival_seq, failure_kind, errors FROM orders_mapped)
        SELECT feed, arrival_seq, failure_kind, CASE failure_kind WHEN 'INVALID' THEN 'VALIDATION' ELSE 'MAPPING' END AS reason,
          lower(failure_kind) || ': ' || array_to_string(errors, '; ') AS message
        FROM (SELECT * FROM c UNION ALL SELECT * FROM o) AS everything WHERE failure_kind IS NOT NULL""",
    "project_customer_row": f"""WITH {CUSTOMERS_SQL} SELECT * EXCLUDE (created_at), epoch_us(created_at) AS source_created_us FROM ({ROW_CUSTOMER}) AS r""",
    "project_order_row": f"""WITH {ORDERS_SQL} SELECT arrival_seq, customer AS customer_key,
          CASE upper(sts) WHEN 'PENDING' THEN 'PEN' WHEN 'PAID' THEN 'PAI' WHEN 'SHIPPED' THEN 'SHP' WHEN 'DELIVERED' THEN 'DLV' ELSE 'CAN' END AS state_code,
          amount_minor AS total_minor, upper(cur) AS currency, line_count, lines_json, epoch_us(placed_at) AS placed_us FROM orders_mapped WHERE {FINE}""",
    "customer_tier_view": """SELECT c_custkey, tier_rank, CASE WHEN tier_rank <= 1 THEN 'BRONZE' WHEN tier_rank = 2 THEN 'SILVER'
        WHEN tier_rank = 3 THEN 'GOLD' ELSE 'PLATINUM' END AS tier FROM (SELECT c_custkey, CAST(c_custkey % 7 - 1 AS INTEGER) AS tier_rank FROM customer) AS r""",
    "content_fingerprint": f"""WITH {CUSTOMERS_SQL} SELECT arrival_seq, sha256(concat_ws('|', email_address, full_name, given_name, family_name, lifecycle_code, tier_rank,
        address_line, city, postal_code, country_code, tags_csv,
        strftime(created_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_ms(created_at) % 1000 <> 0 THEN strftime(created_at, '.%g') ELSE '' END || 'Z')) AS content_fingerprint
        FROM ({ROW_CUSTOMER}) AS r""",
}
