"""Schema drift: differences between a payload and the feed's declared contract.

A contract is tiny and static, so it is compiled into column expressions: each record is checked where it is, in
one projection, without a join or a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.functions import json_values as J
from feedweave.functions.once import compute_once
from feedweave.operators.contract import Contract, Field

FINDING = "struct<kind: string, field: string, expected: string, actual: string, details: string>"
FINDINGS = f"array<{FINDING}>"
# Finding kinds, severities and the width of a stored fingerprint.
ADDED, MISSING, RETYPED, RENAMED, OUT_OF_DOMAIN = (
    "FIELD_ADDED",
    "FIELD_MISSING",
    "FIELD_RETYPED",
    "FIELD_RENAMED",
    "VALUE_OUT_OF_DOMAIN",
)
WARNING, BLOCKING = "WARNING", "BLOCKING"
FINGERPRINT_WIDTH = 256

DOCUMENT = "_document"
TYPES = "_types"
MEMBERS = "_members"


def with_document(records: DataFrame) -> DataFrame:
    """Parse the payload once; every check reads from this column."""
    if DOCUMENT in records.columns:
        return records
    return records.withColumn(DOCUMENT, J.parse(F.col("payload")))


def _objects(contract: Contract) -> list[str]:
    """The root and the declared objects, whose members are looked at."""
    return ["", *[field.path for field in contract.fields if field.type == "OBJECT"]]


def _members(contract: Contract, parent: str) -> Column:
    return F.col(MEMBERS)[f"m{_objects(contract).index(parent)}"]


def _member(contract: Contract, field: Field) -> Column:
    return F.try_element_at(_members(contract, field.parent), F.lit(field.name))


def with_types(records: DataFrame, contract: Contract) -> DataFrame:
    """Flatten the objects of the payload once, and look up the JSON type of every declared field once: an array in
    contract order.
    """
    flat = [J.members(F.col(DOCUMENT), parent).alias(f"m{i}") for i, parent in enumerate(_objects(contract))]
    parsed = with_document(records).withColumn(MEMBERS, F.struct(*flat))
    return parsed.withColumn(TYPES, F.array(*[J.json_type_or_null(_member(contract, f)) for f in contract.fields]))


def _type(contract: Contract, field: Field) -> Column:
    return F.get(F.col(TYPES), F.lit(contract.fields.index(field)))


def _is_absent(kind: Column) -> Column:
    return kind.isNull() | (kind == J.NULL)


def _finding(kind: str, field: Column, expected: Column, actual: Column, details: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        field.alias("field"),
        expected.cast("string").alias("expected"),
        actual.cast("string").alias("actual"),
        details.alias("details"),
    )


#: What a check says of a field: a condition and the finding it stands for; the first condition that holds counts.
Cases = list[tuple[Column, Column]]


def _missing(contract: Contract, field: Field) -> Cases:
    if not field.required:
        return []
    found = _finding(
        MISSING, F.lit(field.path), F.lit(field.type), F.lit(None), F.lit(f"required field '{field.path}' is missing")
    )
    return [(_is_absent(_type(contract, field)), found)]


def _retyped(contract: Contract, field: Field) -> Cases:
    actual = _type(contract, field)
    details = F.concat(F.lit(f"field '{field.path}' is "), actual, F.lit(f", expected {field.type}"))
    found = _finding(RETYPED, F.lit(field.path), F.lit(field.type), actual, details)
    return [(~_is_absent(actual) & (actual != field.type), found)]


def _out_of_domain(contract: Contract, field: Field) -> Cases:
    if field.allowed is None:
        return []
    text = J.as_text(_member(contract, field))
    domain = sorted(field.allowed)
    details = F.concat(F.lit(f"field '{field.path}' has value '"), text, F.lit(f"' outside [{', '.join(domain)}]"))
    found = _finding(OUT_OF_DOMAIN, F.lit(field.path), F.lit("|".join(domain)), text, details)
    return [((_type(contract, field) == "STRING") & ~text.isin(*domain), found)]


def _declared(contract: Contract, field: Field) -> Cases:
    """At most one finding per declared field: absent, else of another type, else outside its value set."""
    return _missing(contract, field) + _retyped(contract, field) + _out_of_domain(contract, field)


def _surplus(contract: Contract, parent: str) -> Column:
    """Names of an object's members that the contract does not declare; null where there is no object."""
    declared = F.array(*[F.lit(field.name) for field in contract.children(parent)])
    return F.array_except(F.map_keys(_members(contract, parent)), declared)


def _added(contract: Contract) -> Column:
    """Most records have no undeclared field, and many of the others one: only where several have to be put in payload
    order is the payload walked.
    """
    several = [F.coalesce(F.size(_surplus(contract, parent)), F.lit(0)) for parent in _objects(contract)]
    number = sum(several[1:], several[0])
    none = F.array().cast(FINDINGS)
    return F.when(number == 0, none).when(number == 1, _one_undeclared(contract)).otherwise(_undeclared(contract))


def _undeclared_finding(path: Column, value: Column) -> Column:
    details = F.concat(F.lit("unexpected field '"), path, F.lit("'"))
    return _finding(ADDED, path, F.lit(None), J.json_type(value), details)


def _one_undeclared(contract: Contract) -> Column:
    """The undeclared field of a payload that has exactly one, in whichever object it stands."""
    found = []
    for parent in _objects(contract):
        name = F.get(_surplus(contract, parent), F.lit(0))
        path = F.concat(F.lit(f"{parent}." if parent else ""), name)
        finding = _undeclared_finding(path, F.try_element_at(_members(contract, parent), name))
        found.append(F.when(name.isNotNull(), F.array(finding).cast(FINDINGS)))
    return F.coalesce(*found)


def _undeclared(contract: Contract, parent: str = "") -> Column:
    """Undeclared fields of an object in payload order, going down into declared objects where they stand."""
    prefix = f"{parent}." if parent else ""
    value = J.node(F.col(DOCUMENT), parent)
    text = F.get_json_object("payload", f"$.{parent}") if parent else F.col("payload")
    names = F.json_object_keys(text)
    members = F.try_variant_get(value, "$", "map<string,variant>")
    declared = contract.children(parent)
    objects = [field for field in declared if field.type == "OBJECT"]

    def undeclared(name: Column) -> Column:
        finding = _undeclared_finding(F.concat(F.lit(prefix), name), members[name])
        found = F.when(~name.isin(*[f.name for f in declared]), F.array(finding))
        for child in objects:
            found = found.when(name == child.name, _undeclared(contract, child.path))
        return found.otherwise(F.array().cast(FINDINGS))

    interesting = F.filter(names, lambda name: ~name.isin(*[f.name for f in declared if f.type != "OBJECT"]))
    return F.when(
        J.json_type_or_null(value) == "OBJECT", F.flatten(F.transform(interesting, undeclared))
    ).otherwise(F.array().cast(FINDINGS))


def _of_kind(findings: Column, kind: str) -> Column:
    return F.filter(findings, lambda f: f["kind"] == kind)


def _parent(path: Column) -> Column:
    return F.regexp_extract(path, r"\A(?:(.*)\.)?[^.]*\z", 1)


def _plain_name(path: Column) -> Column:
    leaf = F.regexp_extract(path, r"([^.]*)\z", 1)
    return F.regexp_replace(F.lower(leaf), r"[^\p{L}\p{Nd}]", "")


def _similar(old: Column, new: Column) -> Column:
    a, b = _plain_name(old), _plain_name(new)
    return (_parent(old) == _parent(new)) & (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def drift_renamed(findings: Column) -> Column:
    """Pair each missing field with the first still unpaired added field next to it that has a similar name.

    The pair becomes one rename finding; renames come last. Missing fields choose in contract order.
    """
    missing, added = _of_kind(findings, MISSING), _of_kind(findings, ADDED)
    start = F.struct(
        F.transform(added, lambda f: f["field"]).alias("free"),
        F.array().cast("array<struct<old: string, new: string>>").alias("pairs"),
    )

    def choose(state: Column, m: Column) -> Column:
        candidates = F.filter(state["free"], lambda name: _similar(m["field"], name))
        chosen = F.slice(candidates, 1, 1)
        pairs = F.transform(chosen, lambda name: F.struct(m["field"].alias("old"), name.alias("new")))
        return F.struct(
            F.array_except(state["free"], chosen).alias("free"), F.concat(state["pairs"], pairs).alias("pairs")
        )

    def collapse(pairs: Column) -> Column:
        kept = F.filter(
            findings,
            lambda f: ~(
                (f["kind"].isin(MISSING) & F.exists(pairs, lambda p: p["old"] == f["field"]))
                | (f["kind"].isin(ADDED) & F.exists(pairs, lambda p: p["new"] == f["field"]))
            ),
        )
        renames = F.transform(
            pairs,
            lambda p: _finding(
                RENAMED,
                p["old"],
                p["old"],
                p["new"],
                F.concat(F.lit("field '"), p["old"], F.lit("' appears to be renamed to '"), p["new"], F.lit("'")),
            ),
        )
        return F.concat(kept, renames)

    collapsed = F.aggregate(missing, start, choose, lambda state: collapse(state["pairs"]))
    # A pair takes two findings; most records have none.
    return F.when(F.size(findings) < 2, findings).when((F.size(missing) > 0) & (F.size(added) > 0), collapsed).otherwise(findings)


def _check_fields(contract: Contract, check: Callable[[Contract, Field], Cases]) -> Column:
    """What a check finds, in contract order. Lists are joined, not filtered: filters are not compiled."""
    none, found = F.array().cast(FINDINGS), []
    for field in contract.fields:
        cases = check(contract, field)
        if cases:
            (condition, finding), *others = cases
            column = F.when(condition, F.array(finding).cast(FINDINGS))
            for condition, finding in others:
                column = column.when(condition, F.array(finding).cast(FINDINGS))
            found.append(column.otherwise(none))
    return F.concat(*found) if found else none


def drift_findings(records: DataFrame, contract: Contract, skip: Column | None = None) -> DataFrame:
    """Add `findings`: declared findings in contract order, then added fields, renames collapsed last.

    Skipped records are not looked at and have none.
    """
    found = F.concat(_check_fields(contract, _declared), _added(contract))
    if skip is not None:
        found = F.when(~skip, found).otherwise(F.array().cast(FINDINGS))
    checked = with_types(records, contract).withColumn("_raw_findings", found)
    return compute_once(checked, findings=drift_renamed(F.col("_raw_findings"))).drop("_raw_findings", TYPES, MEMBERS)


def _only(records: DataFrame, contract: Contract, findings: Column) -> DataFrame:
    return compute_once(with_types(records, contract), findings=findings).drop(DOCUMENT, TYPES, MEMBERS)


def drift_missing(records: DataFrame, contract: Contract) -> DataFrame:
    """Required fields absent or null, at any level, before renames are inferred."""
    return _only(records, contract, _check_fields(contract, _missing))


def drift_retyped(records: DataFrame, contract: Contract) -> DataFrame:
    """Declared fields present with another JSON type."""
    return _only(records, contract, _check_fields(contract, _retyped))


def drift_out_of_domain(records: DataFrame, contract: Contract) -> DataFrame:
    """Text values outside a field's closed, case-sensitive value set."""
    return _only(records, contract, _check_fields(contract, _out_of_domain))


def drift_added(records: DataFrame, contract: Contract) -> DataFrame:
    """Fields the contract does not declare, before renames are inferred."""
    return _only(records, contract, _added(contract))


def severity(kind: Column) -> Column:
    return F.when(kind == ADDED, F.lit(WARNING)).otherwise(F.lit(BLOCKING))


def fingerprint(finding: Column) -> Column:
    """Identity of a finding across records and runs."""
    dash = F.lit("-")
    text = F.concat(
        finding["kind"],
        F.lit(":"),
        finding["field"],
        F.lit(":"),
        F.coalesce(finding["expected"], dash),
        F.lit("->"),
        F.coalesce(finding["actual"], dash),
    )
    return F.left(text, F.lit(FINGERPRINT_WIDTH))


def drift_fingerprint(records: DataFrame) -> DataFrame:
    """One row per finding of every record, with severity and fingerprint."""
    exploded = records.select(
        "feed", "business_key", "source_updated_at", "arrival_seq", F.posexplode("findings").alias("finding_no", "_f")
    )
    return exploded.select(
        "feed",
        "business_key",
        "source_updated_at",
        "arrival_seq",
        "finding_no",
        "_f.*",
        severity(F.col("_f.kind")).alias("severity"),
        fingerprint(F.col("_f")).alias("fingerprint"),
    )


def drift_route(records: DataFrame, contract: Contract, skip: Column | None = None) -> DataFrame:
    """Check the contract and add `route` and `drift_detected`.

    BYPASS: a skipped record (a tombstone unless told otherwise), its payload is not read. QUARANTINE: at least one blocking finding, `details` tells all
    findings. CONTINUE: no finding or only warnings.
    """
    skip = F.col("deleted") if skip is None else skip
    checked = drift_findings(records, contract, skip)
    blocking = F.exists("findings", lambda f: f["kind"] != ADDED)
    return (
        checked.withColumn("drift_detected", F.size("findings") > 0)
        .withColumn(
            "route",
            F.when(skip, F.lit("BYPASS"))
            .when(blocking, F.lit("QUARANTINE"))
            .otherwise(F.lit("CONTINUE")),
        )
        .withColumn(
            "drift_details",
            F.when(blocking, F.array_join(F.transform("findings", lambda f: f["details"]), "; ")),
        )
    )
