"""Run registered queries beside their SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def open_duckdb(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return f"bool:{value}"
    if isinstance(value, int):
        return f"int:{value}"
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"float:{value + 0.0:.9g}" if value else "float:0"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(item) for item in value) + "]"
    if hasattr(value, "isoformat"):
        return f"time:{value.isoformat()}"
    return f"{type(value).__name__}:{value}"


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([tuple(_cell(row[i]) for i in order) for row in rows])


def compare(spark_df, con, sql) -> str | None:
    """None when equal, else a short description of the first difference."""
    got_columns, got = canonical(spark_df.columns, [tuple(row) for row in spark_df.collect()])
    cursor = con.execute(sql)
    want_columns, want = canonical([d[0] for d in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        only = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        return f"rows {len(got)} != {len(want)}; spark only {only[0]}; sql only {only[1]}"
    for left, right in zip(got, want):
        if left != right:
            diff = [(c, a, b) for c, a, b in zip(got_columns, left, right) if a != b]
            return f"first difference {diff[:4]} in {left[:4]}"
    return None


def main(argv):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as registered
    from nudgeframe.session import local_session

    sf_dir, wanted = argv[0], argv[1:]
    spark = local_session("compare")
    if "--split" in argv:  # force the large-input paths on small data
        wanted.remove("--split")
        spark.conf.set("spark.nudgeframe.smallBytes", "0")
        spark.conf.set("spark.nudgeframe.rowsPerTask", "60")
    con = open_duckdb(sf_dir)
    sql = registered.oracle_sql()
    bad = 0
    for name, query in registered.queries().items():
        if wanted and not any(part in name for part in wanted):
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in sql:
                problem = compare(df, con, sql[name])
                note = "ok" if problem is None else f"DIFF {problem}"
            else:
                rows = df.collect()
                note = f"rows-only {len(rows)} e.g. {rows[0] if rows else None}"
        except Exception as error:
            note = f"FAIL {type(error).__name__}: {str(error)[:1500]}"
        bad += note.startswith(("DIFF", "FAIL"))
        print(f"{name:34s} {time.time() - start:6.2f}s {note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
