"""Run registered queries next to their expected results and report differences.

    python tests/compare.py SF_DIR [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(
        (tuple(normal(row[i]) for i in order) for row in rows), key=lambda r: tuple(map(repr, r))
    )


def differences(spark, con, name, query, sql, sf_dir, show=3):
    frame = query(spark, sf_dir)
    got_names, got = table(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want_names, want = table(columns, result.fetchall())
    if got_names != want_names:
        return [f"columns {got_names} != {want_names}"]
    if got == want:
        return []
    extra = sorted(set(got) - set(want), key=repr)[:show]
    missing = sorted(set(want) - set(got), key=repr)[:show]
    return [f"{len(got)} rows, expected {len(want)}"] + [
        f"  + {row}" for row in extra
    ] + [f"  - {row}" for row in missing]


def main() -> int:
    sys.path.insert(0, ".")
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, only = sys.argv[1], set(sys.argv[2:])
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    expected = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            problems = (
                differences(spark, con, name, query, expected[name], sf_dir)
                if name in expected
                else ["no expected result"]
            )
        except Exception as error:  # reported, and the next query still runs
            problems = [f"{type(error).__name__}: {str(error)[:700]}"]
        bad += bool(problems)
        print(f"{'ok  ' if not problems else 'DIFF'} {name} {time.time() - start:.1f}s", flush=True)
        for line in problems:
            print("    " + line)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main())
