"""Run registered queries next to their SQL and compare the results.

    python -m workload.check [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if value is None or value != value:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return int(value) if value.is_integer() else round(value, 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(tuple(repr(_plain(row[i])) for i in order) for row in rows)


def compare(spark, connection, sf_dir, query, sql):
    start = time.time()
    frame = query(spark, sf_dir)
    names, got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    print(f"spark {time.time() - start:.1f}s {len(got)} rows", end=" ")
    cursor = connection.execute(sql)
    expected_names, expected = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if names != expected_names:
        return f"columns {names} vs {expected_names}"
    if len(got) != len(expected):
        return f"{len(got)} rows vs {len(expected)}: only spark {sorted(set(got) - set(expected))[:2]} only sql {sorted(set(expected) - set(got))[:2]} {names}"
    if got != expected:
        return f"values differ {names}: only spark {sorted(set(got) - set(expected))[:2]} only sql {sorted(set(expected) - set(got))[:2]}"
    return None


def main(argv: list[str]) -> int:
    from feedweave.session import local_session
    from workload.queries import all_oracles, all_queries

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session("check")
    connection = duck(sf_dir)
    queries, oracles = all_queries(), all_oracles()
    failures = 0
    for name in argv[1:] or queries:
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, connection, sf_dir, queries[name], oracles[name])
                rows = ""
            else:
                rows, problem = f" rows only: {queries[name](spark, sf_dir).count()}", None
        except Exception as error:  # a broken query must not hide the others
            problem, rows = f"{type(error).__name__}: {str(error)[:1500]}", ""
        failures += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s{rows} {problem or ''}", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
