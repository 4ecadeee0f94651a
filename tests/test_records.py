"""Single-record rules: drift, mapping, money, pages."""

import copy
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedweave.functions.money import is_decimal_text, to_minor_units
from feedweave.functions.text import format_instant, parse_instant, trim_text, wrap_to_int
from feedweave.operators import drift
from feedweave.operators import mapping as MP
from feedweave.operators.contract import CUSTOMERS, ORDERS
from feedweave.operators.drift import drift_findings, drift_route, fingerprint
from feedweave.sources import change_feed as S
from feedweave.sources import pages as P

T0 = datetime(2026, 3, 1, 10)
RECORD = "feed string, business_key string, source_updated_at timestamp, deleted boolean, payload string, arrival_seq bigint"
CUSTOMER = {
    "id": "cus_1",
    "email": "Ada@Example.com",
    "firstName": "Ada",
    "lastName": "Lovelace",
    "status": "ACTIVE",
    "tier": "GOLD",
    "address": {"line1": "1 Main St", "city": "London", "postalCode": "N1", "country": "gb"},
    "tags": ["vip"],
    "createdAt": "2026-01-01T00:00:00Z",
    "updatedAt": "2026-03-01T10:00:00Z",
}
ORDER = {
    "id": "ord_1",
    "customerId": "cus_1",
    "status": "PAID",
    "total": {"amount": "21.75", "currency": "eur"},
    "lines": [{"sku": "A", "quantity": 2, "unitPrice": "7.25"}, {"sku": "B", "quantity": 1, "unitPrice": "7.25"}],
    "placedAt": "2026-03-01T09:00:00Z",
    "updatedAt": "2026-03-01T10:00:00Z",
}


def changed(base, **changes):
    """A payload with dotted paths set, or removed where the value is `...`."""
    doc = copy.deepcopy(base)
    for path, value in changes.items():
        *parents, leaf = path.split("__")
        at = doc
        for parent in parents:
            at = at[int(parent)] if isinstance(at, list) else at[parent]
        if value is ...:
            del at[leaf]
        else:
            at[leaf] = value
    return doc


def records(spark, *docs):
    rows = [("f", d.get("id", "k"), T0, False, json.dumps(d), i) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, RECORD)


def findings(spark, contract, *docs):
    df = drift_findings(records(spark, *docs), contract).withColumn(
        "prints", F.transform("findings", fingerprint)
    )
    return [r.prints for r in df.orderBy("arrival_seq").collect()]


def test_drift_cases(spark):
    renamed = {("emailAddress" if k == "email" else k): v for k, v in CUSTOMER.items()}
    got = findings(
        spark,
        CUSTOMERS,
        CUSTOMER,
        renamed,
        changed(CUSTOMER, address__postalCode=1, tier=..., status="ON_HOLD"),
        changed(CUSTOMER, loyaltyPoints=7),
        changed(CUSTOMER, address__geo={"lat": 1}, tags=...),
        changed(CUSTOMER, address="somewhere"),
        changed(CUSTOMER, email=None, tags="x", status=True, extra=None),
    )
    assert got == [
        [],
        ["FIELD_RENAMED:email:email->emailAddress"],
        [
            "VALUE_OUT_OF_DOMAIN:status:ACTIVE|CHURNED|INACTIVE->ON_HOLD",
            "FIELD_MISSING:tier:STRING->-",
            "FIELD_RETYPED:address.postalCode:STRING->NUMBER",
        ],
        ["FIELD_ADDED:loyaltyPoints:-->NUMBER"],
        ["FIELD_ADDED:address.geo:-->OBJECT"],
        ["FIELD_RETYPED:address:OBJECT->STRING"]
        + [f"FIELD_MISSING:address.{f}:STRING->-" for f in ("line1", "city", "postalCode", "country")],
        [
            "FIELD_MISSING:email:STRING->-",
            "FIELD_RETYPED:status:STRING->BOOLEAN",
            "FIELD_RETYPED:tags:ARRAY->STRING",
            "FIELD_ADDED:extra:-->OBJECT",
        ],
    ]


def test_one_undeclared_field_is_found_without_walking_the_payload(spark):
    docs = [
        changed(CUSTOMER, extra=1),
        changed(CUSTOMER, extra={"a": {"b": 1}}),
        changed(CUSTOMER, extra=None),
        changed(CUSTOMER, address__geo=[1]),
        changed(CUSTOMER, address={"geo": "x"}),
        changed(CUSTOMER, address=..., extra="x"),
        changed(CUSTOMER, address=5, extra=True),
        changed(CUSTOMER, **{"a.b c'\"": 1.5}),
        changed(CUSTOMER, **{"": 1}),
    ]
    seen = drift.with_types(records(spark, *docs), CUSTOMERS)
    rows = seen.select(drift._one_undeclared(CUSTOMERS).alias("one"), drift._undeclared(CUSTOMERS).alias("walked")).collect()
    assert len(rows) == len(docs) and all(len(r.one) == 1 and r.one == r.walked for r in rows)
    several = drift_findings(records(spark, changed(CUSTOMER, z=1, address__geo=1, b=2)), CUSTOMERS).first().findings
    assert sorted(f.field for f in several) == ["address.geo", "b", "z"]


def test_rename_is_greedy_and_stays_next_to_its_field(spark):
    """Two missing fields and two similar candidates; a nested candidate never serves a root field."""
    doc = changed(CUSTOMER, firstName=..., lastName=..., email=..., address__email="x")
    doc |= {"first": "a", "last_name": "b", "First-Name": "c"}
    (got,) = findings(spark, CUSTOMERS, doc)
    assert got == [
        "FIELD_MISSING:email:STRING->-",
        "FIELD_ADDED:address.email:-->STRING",
        "FIELD_ADDED:First-Name:-->STRING",
        "FIELD_RENAMED:firstName:firstName->first",
        "FIELD_RENAMED:lastName:lastName->last_name",
    ]


def test_route(spark):
    docs = [CUSTOMER, changed(CUSTOMER, extra=1), changed(CUSTOMER, tier=..., extra=1)]
    rows = drift_route(records(spark, *docs), CUSTOMERS).orderBy("arrival_seq").collect()
    assert [(r.route, r.drift_detected) for r in rows] == [("CONTINUE", False), ("CONTINUE", True), ("QUARANTINE", True)]
    assert rows[2].drift_details == "required field 'tier' is missing; unexpected field 'extra'"
    deleted = records(spark, changed(CUSTOMER, tier=...)).withColumn("deleted", F.lit(True))
    assert drift_route(deleted, CUSTOMERS).first().route == "BYPASS"


def mapped(spark, mapper, *docs):
    rows = mapper(records(spark, *docs)).orderBy("arrival_seq").collect()
    return [(r.failure_kind, [f"{e.field}: {e.message}" for e in r.errors], r.canonical) for r in rows]


def test_customer_mapping(spark):
    spaced = changed(CUSTOMER, email=" ADA@x.org\t", tags=[" VIP", "vip", "", 7, None, {"a": 1}, True], address__line2="Flat 2")
    fine, spaced, country, numeric, early = mapped(
        spark,
        MP.map_customer,
        CUSTOMER,
        spaced,
        changed(CUSTOMER, address__country="Poland"),
        changed(CUSTOMER, address__postalCode=1, createdAt="soon"),
        changed(CUSTOMER, createdAt="2026-04-01T00:00:00Z", email="nobody"),
    )
    assert fine[0] is None and fine[2].email == "ada@example.com" and fine[2].address.country_code == "GB"
    assert spaced[2].email == "ada@x.org" and spaced[2].tags == ["vip", "7", "null", "true"]
    assert spaced[2].address.street == "1 Main St, Flat 2"
    assert country[:2] == ("INVALID", ["address.countryCode: must be an ISO 3166-1 alpha-2 code"])
    # The broken address ends the reading, so the unreadable date is not reported.
    assert numeric[:2] == ("UNMAPPABLE", ["address.postalCode: missing or not a text"])
    assert early[:2] == ("INVALID", ["email: must be a valid email address", "updatedAt: must not be before createdAt"])


def test_order_mapping(spark):
    three = changed(ORDER, lines__0__unitPrice="7.255", lines__1__unitPrice="7.255")
    fine, three, total, blank, stop, number, huge = mapped(
        spark,
        MP.map_order,
        ORDER,
        three,
        changed(ORDER, total__amount="21.74"),
        changed(ORDER, lines__0__sku=" ", lines__1__sku=...),
        changed(ORDER, lines__0__quantity="2", lines__1__quantity="x", placedAt="never"),
        changed(ORDER, total__amount=21.75, lines__0__unitPrice=7.25),
        changed(ORDER, lines__0__quantity=2**32 + 2),
    )
    assert fine[0] is None and fine[2].total.amount_minor == 2175 and fine[2].total.currency == "EUR"
    message = "must have at most two decimal places and fit in minor units (Rounding necessary)"
    assert three[:2] == ("UNMAPPABLE", [f"lines[{i}].unitPrice: {message}" for i in (0, 1)])
    assert total[:2] == ("INVALID", ["total: must equal the sum of line totals (2175)"])
    assert blank[:2] == ("INVALID", ["lines.sku: must not be blank"])
    assert stop[:2] == ("UNMAPPABLE", ["lines[0].quantity: missing or not a integer"])
    assert number[0] is None and number[2].total.amount_minor == 2175
    assert huge[0] is None and huge[2].lines[0].quantity == 2


@pytest.mark.parametrize(
    "text, units, problem",
    [
        ("10.50", 1050, None),
        ("-0.05", -5, None),
        ("+7", 700, None),
        ("1e2", 10000, None),
        ("15E-1", 150, None),
        ("10.5000", 1050, None),
        (".5", 50, None),
        ("5.", 500, None),
        ("0e50", 0, None),
        ("10.5000001", None, "Rounding necessary"),
        ("1e-3", None, "Rounding necessary"),
        ("92233720368547758.07", 2**63 - 1, None),
        ("92233720368547758.08", None, "Overflow"),
        ("1e30", None, "Overflow"),
        (" 1", None, "unreadable"),
        ("", None, "unreadable"),
        ("1,5", None, "unreadable"),
    ],
)
def test_minor_units(spark, text, units, problem):
    df = spark.createDataFrame([(text,)], "t string")
    value, trouble = to_minor_units(F.col("t"))
    ok, got, why = df.select(is_decimal_text(F.col("t")), value, trouble).first()
    assert (why if ok else "unreadable") == problem
    if units is not None:
        assert got == units


def test_text_functions(spark):
    rows = [("2026-03-01T10:00:00Z",), ("2026-03-01T12:00:00.5+02:00",), ("2026-03-01",), ("2026-02-30T00:00:00Z",), ("x",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(format_instant(parse_instant(F.col("t")))).collect()]
    assert got == ["2026-03-01T10:00:00Z", "2026-03-01T10:00:00.500Z", None, None, None]
    assert spark.range(1).select(trim_text(F.lit(" a b \n"))).first()[0] == "a b"
    assert spark.range(1).select(wrap_to_int(F.lit(2**31))).first()[0] == -(2**31)


def small_feed(spark):
    rows = [("b", 10, False), ("a", 10, False), ("c", 20, False), ("d", 30, True), ("e", 0, False)]
    data = [("f", k, T0 + timedelta(seconds=s), d, "{}", i) for i, (k, s, d) in enumerate(rows)]
    return spark.createDataFrame(data, RECORD)


def test_feed_scan_and_pages(spark):
    feed = small_feed(spark)

    def keys(df):
        return "".join(r.business_key for r in df.collect())

    assert keys(S.change_feed_scan(feed)) == "eabcd"
    assert keys(S.change_feed_scan(feed, T0)) == "abcd"
    assert keys(S.change_feed_scan(feed, T0 + timedelta(seconds=10), T0 + timedelta(seconds=30))) == "cd"
    pages, after = [], None
    while True:
        page = S.resume_after(feed, None, None, after, 2).collect()
        pages.append("".join(r.business_key for r in page))
        if not page[-1].has_more:
            assert page[-1].next_key is None
            break
        after = (page[-1].next_clock, page[-1].next_key)
    assert pages == ["ea", "bc", "d"]
    index = S.page_index(S.feed_pages(feed, 2)).orderBy("page_no").collect()
    assert [(r.records, r.cursor_key, r.has_more) for r in index] == [(2, "a", True), (2, "c", True), (1, None, False)]
    with pytest.raises(ValueError):
        S.resume_after(feed, None, None, None, 501)
    assert S.resume_after(feed, None, None, None, 501, clamp=True).count() == 5


def pages(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies, 1)), "page_no bigint, body string")


def test_broken_pages_fail_the_read(spark):
    good = json.dumps({"items": [CUSTOMER], "nextCursor": "c", "hasMore": True})
    assert P.read_envelope_pages(pages(spark, good)).first().business_key == "cus_1"
    for body in ('{"hasMore":false}', "not json", json.dumps({"items": [changed(CUSTOMER, id=" ")]})):
        with pytest.raises(Exception, match="page 1|tracked"):
            P.read_envelope_pages(pages(spark, body)).collect()
    edges = {"edges": [{"node": ORDER}], "pageInfo": {"endCursor": None, "hasNextPage": False}}
    assert P.read_connection_pages(pages(spark, json.dumps({"data": {"orders": edges}}))).first().business_key == "ord_1"
    for body in ({"errors": [{"message": "no"}], "data": {"orders": edges}}, {"data": {"orders": {}}}):
        with pytest.raises(Exception, match="page 1"):
            P.read_connection_pages(pages(spark, json.dumps(body))).collect()


def test_contract_children():
    assert [f.name for f in CUSTOMERS.children("address")] == ["line1", "line2", "city", "postalCode", "country"]
    assert "address.city" not in [f.path for f in ORDERS.children("")]
