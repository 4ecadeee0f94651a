"""Change feeds derived from the given tables.

Each derivation is one SELECT that Spark and DuckDB read the same way, so both sides start from equal text. The
derivations are row-local: a feed is as large as the table it comes from. What the operators then do with the feeds
is written independently on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from workload.tables import SCHEMAS, table

# A user's events as versions of one record: the content is the event type, an error is a delete, and arrival is
# disturbed so that some versions come late. (event_id * 7919) % 97 moves an event by up to 96 places.
EVENT_FEED = """
SELECT 'events' AS feed, CAST(user_id AS STRING) AS business_key, ts AS source_updated_at,
       event_type = 'error' AS deleted,
       (event_id + (event_id * 7919) % 97) * 97 + 96 - (event_id * 7919) % 97 AS arrival_seq,
       event_type, event_id, value
FROM {events}
"""

# Customer versions: every order of a customer brings its customer record again, changed by the order. The remainder
# of the order number picks what is wrong with the payload.
CUSTOMER_FEED = """
SELECT 'customers' AS feed, business_key, clock AS source_updated_at, tombstone AS deleted, o_orderkey AS arrival_seq,
       '{{' || concat_ws(',',
         '"id":"' || business_key || '"',
         CASE flaw WHEN 0 THEN '"emailAddress":"c' || cust || '@example.com"'
                   WHEN 5 THEN '"email":"not-an-address"'
                   ELSE '"email":" C' || cust || '@Example.COM "' END,
         CASE flaw WHEN 12 THEN '"firstName":"  "' ELSE '"firstName":" First' || cust || '"' END,
         '"lastName":"' || segment || '"',
         CASE WHEN flaw = 4 THEN '"status":"ON_HOLD"'
              WHEN o_orderstatus = 'F' THEN '"status":"ACTIVE"'
              WHEN o_orderstatus = 'O' THEN '"status":"INACTIVE"'
              ELSE '"status":"CHURNED"' END,
         CASE WHEN flaw = 2 THEN NULL
              WHEN o_custkey % 4 = 0 THEN '"tier":"BRONZE"'
              WHEN o_custkey % 4 = 1 THEN '"tier":"SILVER"'
              WHEN o_custkey % 4 = 2 THEN '"tier":"GOLD"'
              ELSE '"tier":"PLATINUM"' END,
         CASE WHEN flaw = 8 THEN NULL ELSE '"address":{{' || concat_ws(',',
              '"line1":"' || cust || ' Main Street"',
              CASE WHEN o_custkey % 3 = 0 THEN '"line2":"Floor 2"' WHEN o_custkey % 3 = 1 THEN '"line2":" "' END,
              CASE WHEN flaw = 9 THEN '"geo":{{"lat":1}}' END,
              '"city":" City"',
              CASE flaw WHEN 1 THEN '"postalCode":12345' WHEN 16 THEN '"postalCode":""'
                        ELSE '"postalCode":"00-' || cust || '"' END,
              CASE flaw WHEN 6 THEN '"country":"Poland"' WHEN 13 THEN '"country":"pl"' ELSE '"country":"PL"' END
              ) || '}}' END,
         CASE WHEN flaw = 3 THEN '"loyaltyPoints":12' END,
         CASE flaw WHEN 10 THEN '"tags":5' WHEN 11 THEN '"tags":["VIP"," Beta ","vip","",7,null]'
                   WHEN 14 THEN NULL WHEN 17 THEN '"tags":null' ELSE '"tags":["' || segment || '"]' END,
         CASE flaw WHEN 7 THEN '"createdAt":"yesterday"' WHEN 15 THEN '"createdAt":"2030-01-01T00:00:00Z"'
                   WHEN 18 THEN '"created":"1994-01-01T00:00:00Z"' ELSE '"createdAt":"1994-01-01T00:00:00.250Z"' END,
         '"updatedAt":"' || day || 'T' || time_of_day || 'Z"',
         CASE WHEN tombstone THEN '"deleted":true' END
       ) || '}}' AS payload,
       flaw
FROM (
  SELECT *, CAST(day || ' ' || time_of_day AS TIMESTAMP) AS clock
  FROM (
    SELECT o_orderkey, o_custkey, o_orderstatus, 'cus_' || lpad(CAST(o_custkey AS STRING), 6, '0') AS business_key,
           lpad(CAST(o_custkey AS STRING), 6, '0') AS cust, o_orderkey % 23 AS flaw, o_orderkey % 11 = 0 AS tombstone,
           substr(o_orderpriority, 1, 1) AS segment, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day,
           lpad(CAST(o_orderkey % 24 AS STRING), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS STRING), 2, '0')
             || ':' || lpad(CAST(o_custkey % 60 AS STRING), 2, '0') AS time_of_day
    FROM {orders}
  ) AS dated
) AS clocked
"""

# One order record per order, with one to three lines priced by the order's own total.
ORDER_FEED = """
SELECT 'orders' AS feed, business_key, clock AS source_updated_at, tombstone AS deleted, o_orderkey AS arrival_seq,
       '{{' || concat_ws(',',
         '"id":"' || business_key || '"',
         CASE flaw WHEN 14 THEN NULL WHEN 19 THEN '"customerIdentifier":"cus_' || cust || '"'
                   WHEN 21 THEN '"customerId":""' ELSE '"customerId":"cus_' || cust || '"' END,
         CASE WHEN flaw = 2 THEN '"status":"ON_HOLD"' WHEN flaw = 18 THEN '"status":"paid"'
              WHEN o_orderstatus = 'F' THEN '"status":"DELIVERED"'
              WHEN o_orderstatus = 'O' THEN '"status":"PENDING"' ELSE '"status":"SHIPPED"' END,
         '"total":{{' || concat_ws(',',
              CASE flaw WHEN 0 THEN '"amount":"31.49"' WHEN 4 THEN '"amount":"-1.00"' WHEN 10 THEN '"amount":' || total
                        WHEN 11 THEN '"amount":"abc"' WHEN 15 THEN '"amount":"1e2"' WHEN 22 THEN '"amount":"1.005"'
                        WHEN 23 THEN '"amount":"99999999999999999999"' ELSE '"amount":"' || total || '"' END,
              CASE flaw WHEN 3 THEN '"currency":"EURO"' WHEN 24 THEN NULL ELSE '"currency":"eur"' END) || '}}',
         CASE WHEN flaw = 8 THEN NULL WHEN flaw = 9 THEN '"lines":[]' ELSE '"lines":[' || concat_ws(',',
              line_start || CASE flaw WHEN 1 THEN '2,"unitPrice":"10.505"}}' WHEN 5 THEN '0,"unitPrice":"' || price || '"}}'
                                      WHEN 7 THEN '"2","unitPrice":"' || price || '"}}'
                                      WHEN 16 THEN '1.5,"unitPrice":"' || price || '"}}'
                                      WHEN 25 THEN '2,"unitPrice":' || price || '}}'
                                      WHEN 26 THEN '2,"unitPrice":"-' || price || '"}}'
                                      ELSE '2,"unitPrice":"' || price || '"}}' END,
              CASE WHEN flaw = 1 THEN line_start || '1,"unitPrice":"0.001"}}'
                   WHEN flaw = 6 THEN '{{"sku":" ","quantity":1,"unitPrice":"5.00"}}'
                   WHEN o_orderkey % 2 = 0 THEN line_start || '1,"unitPrice":"5.000"}}' END,
              CASE WHEN flaw = 27 THEN '{{"quantity":1,"unitPrice":"x"}}' END) || ']' END,
         CASE WHEN flaw = 20 THEN '"note":"gift"' END,
         CASE flaw WHEN 12 THEN '"placedAt":"2035-01-01T00:00:00Z"' WHEN 13 THEN '"placedAt":"soon"'
                   WHEN 17 THEN '"placedAt":"' || day || '"' ELSE '"placedAt":"' || day || 'T00:00:00Z"' END,
         '"updatedAt":"' || day || 'T' || time_of_day || 'Z"',
         CASE WHEN tombstone THEN '"deleted":true' END
       ) || '}}' AS payload,
       flaw
FROM (
  SELECT *, CAST(day || ' ' || time_of_day AS TIMESTAMP) AS clock, '{{"sku":"SKU-' || cust || '","quantity":' AS line_start,
         CAST(CAST(price * 2 + CASE WHEN o_orderkey % 2 = 0 THEN 5 ELSE 0 END AS DECIMAL(18, 2)) AS STRING) AS total
  FROM (
    SELECT o_orderkey, o_custkey, o_orderstatus, 'ord_' || lpad(CAST(o_orderkey AS STRING), 9, '0') AS business_key,
           lpad(CAST(o_custkey AS STRING), 6, '0') AS cust, o_orderkey % 53 AS flaw, o_orderkey % 13 = 0 AS tombstone,
           CAST(o_totalprice AS DECIMAL(18, 2)) AS price, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day,
           lpad(CAST(o_orderkey % 24 AS STRING), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS STRING), 2, '0')
             || ':' || lpad(CAST(o_custkey % 60 AS STRING), 2, '0') AS time_of_day
    FROM {orders}
  ) AS dated
) AS clocked
"""

# A run log: one run per feed and hour of events. A run of many errors failed, a run with errors is partial.
RUN_LOG = """
SELECT feed || '-' || CAST(hour AS STRING) AS run_id, feed,
       CASE WHEN first_event % 5 = 0 THEN 'BACKFILL' ELSE 'INCREMENTAL' END AS run_mode,
       CASE WHEN events = 1 AND errors = 0 AND first_event % 2 = 0 THEN 'RUNNING' WHEN errors * 2 > events THEN 'FAILED'
            WHEN errors > 0 THEN 'PARTIAL' ELSE 'SUCCEEDED' END AS status,
       started_at,
       CASE WHEN events = 1 AND errors = 0 AND first_event % 2 = 0 THEN NULL ELSE last_at END AS finished_at,
       events AS extracted, loaded, skipped, errors AS quarantined, lag AS max_lag_seconds
FROM (
  SELECT CASE WHEN user_id % 2 = 0 THEN 'customers' ELSE 'orders' END AS feed,
         date_trunc('hour', ts) AS hour, min(event_id) AS first_event, min(ts) AS started_at, max(ts) AS last_at,
         count(*) AS events,
         CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors,
         CAST(sum(CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 1 ELSE 0 END) AS BIGINT) AS loaded,
         CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS skipped,
         CAST(floor(max(CASE WHEN event_type IN ('click', 'view', 'purchase') THEN value END)) AS BIGINT) AS lag
  FROM {events}
  GROUP BY 1, 2
) AS hourly
"""

DERIVED = {
    "event_feed": EVENT_FEED,
    "customer_feed": CUSTOMER_FEED,
    "order_feed": ORDER_FEED,
    "run_log": RUN_LOG,
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derivation as a Spark DataFrame."""
    text = DERIVED[name]
    sources = {t: table(spark, sf_dir, t) for t in SCHEMAS if "{" + t + "}" in text}
    return spark.sql(text, **sources)


def derived_sql(name: str) -> str:
    """The derivation as SQL over the given tables."""
    return DERIVED[name].format(**{t: t for t in SCHEMAS})
