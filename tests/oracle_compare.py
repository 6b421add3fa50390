"""Run registered Spark queries and their DuckDB oracle SQL side by side.

Usage: python tests/oracle_compare.py [sf_dir] [key ...]
Compares row count, column names, column kinds and the sorted rows (DOUBLE
values compared at 10 significant digits, or exactly with STRICT=1).
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


EXACT_TYPES = bool(os.environ.get("EXACT_TYPES"))
_SPARK_TO_DUCK = {"long": "BIGINT", "integer": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                  "date": "DATE", "boolean": "BOOLEAN", "short": "SMALLINT", "float": "FLOAT"}


def kind_spark(dt) -> str:
    name = dt.typeName()
    if EXACT_TYPES:
        return _SPARK_TO_DUCK.get(name, name.upper())
    return {"long": "int", "integer": "int", "short": "int", "double": "float", "float": "float",
            "string": "str", "date": "date", "boolean": "bool", "decimal": "decimal",
            "timestamp": "ts", "timestamp_ntz": "ts", "array": "array"}.get(name, name)


def kind_duck(t) -> str:
    s = str(t).upper()
    if EXACT_TYPES:
        return s
    if s in ("BIGINT", "INTEGER", "HUGEINT", "SMALLINT", "TINYINT", "UBIGINT", "UINTEGER"):
        return "int"
    if s in ("DOUBLE", "FLOAT"):
        return "float"
    if s == "VARCHAR":
        return "str"
    if s == "DATE":
        return "date"
    if s == "BOOLEAN":
        return "bool"
    if s.startswith("DECIMAL"):
        return "decimal"
    if s.startswith("TIMESTAMP"):
        return "ts"
    if s.endswith("[]"):
        return "array"
    return s


STRICT = bool(os.environ.get("STRICT"))


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if STRICT else float(f"{v:.10g}")
    return v


def sort_key(row):
    return tuple((0, "") if v is None else (1, str(v)) for v in row)


def compare(spark, con, sf_dir: str, key: str, fn, sql: str | None) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_kinds = [kind_spark(f.dataType) for f in sdf.schema.fields]
    s_rows = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t0
    res = {"key": key, "rows": len(s_rows), "spark_sec": round(t_spark, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    rel = con.sql(sql)
    d_cols = rel.columns
    d_kinds = [kind_duck(t) for t in rel.types]
    d_rows = rel.fetchall()
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={s_cols} duck={d_cols}")
    else:
        sk = dict(zip(s_cols, s_kinds))
        dk = dict(zip(d_cols, d_kinds))
        bad = {c: (sk[c], dk[c]) for c in s_cols if sk[c] != dk[c]}
        if bad:
            problems.append(f"kinds {bad}")
        if len(s_rows) != len(d_rows):
            problems.append(f"rowcount spark={len(s_rows)} duck={len(d_rows)}")
        order = sorted(s_cols)
        si = [s_cols.index(c) for c in order]
        di = [d_cols.index(c) for c in order]
        a = sorted([tuple(norm(r[i]) for i in si) for r in s_rows], key=sort_key)
        b = sorted([tuple(norm(r[i]) for i in di) for r in d_rows], key=sort_key)
        if a != b:
            diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
            problems.append(f"values differ, e.g. {diffs}")
    res["status"] = "ok" if not problems else "FAIL"
    if problems:
        res["problems"] = problems
    return res


def main(argv: list[str]) -> int:
    from salespark.plans.session import build_session
    import __spark_entry__ as entry
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    keys = argv[1:]
    if os.environ.get("PLAIN_SESSION"):
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[*]")
                 .config("spark.sql.shuffle.partitions", "8").getOrCreate())
    else:
        spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs = entry.queries()
    oracle = entry.oracle_sql()
    failures = 0
    for key in (keys or list(qs)):
        try:
            r = compare(spark, con, sf_dir, key, qs[key], oracle.get(key))
        except Exception as e:  # report and continue
            r = {"key": key, "status": "ERROR", "error": str(e).splitlines()[0][:400]}
        if r["status"] in ("FAIL", "ERROR"):
            failures += 1
        print(r, flush=True)
    print(f"{failures} failing of {len(keys or qs)}")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
