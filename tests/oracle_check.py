"""Compare registered queries with their DuckDB twins: columns, row counts, values."""

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if hasattr(value, "normalize"):
        return int(value) if value == value.to_integral_value() else float(value)
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs. A plan with a cross join counts as different."""
    df = query(spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    plan = df._jdf.queryExecution().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if operator in plan:
            return f"the plan has a {operator}"
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    theirs = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    left, right = rows_of(df.columns, ours), rows_of(columns, theirs)
    if left == right:
        return None
    return f"rows {len(ours)} against {len(theirs)}; only ours {list((left - right).items())[:3]}; only theirs {list((right - left).items())[:3]}"


if __name__ == "__main__":
    import __spark_entry__ as registry
    from corpusloom.session import build_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    session, database = build_session("local[8]", 8), connect(folder)
    queries, oracles = registry.queries(), registry.oracle_sql()
    failed = []
    for query_name in wanted or queries:
        started = time.time()
        if query_name not in oracles:
            count = queries[query_name](session, folder).count()
            print(f"rows  {query_name} {count} {time.time() - started:.1f}s", flush=True)
            continue
        try:
            difference = compare(session, database, query_name, queries[query_name], oracles[query_name], folder)
        except Exception as error:
            difference = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok   ' if difference is None else 'FAIL '} {query_name} {time.time() - started:.1f}s", flush=True)
        if difference is not None:
            failed.append(query_name)
            print("      ", difference[:1800], flush=True)
    print(f"{len(wanted or queries)} checked, {len(failed)} failed: {failed}")
