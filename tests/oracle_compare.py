"""Run queries beside their DuckDB twins: python tests/oracle_compare.py [--sf DIR] [NAME...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return db


def shown(x: object) -> str:
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x) or x is pd.NA:
        return "null"
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    if hasattr(x, "year"):
        return str(x)[:19].removesuffix(" 00:00:00")
    try:
        return f"{round(float(x), 6) + 0.0:.6f}" if not isinstance(x, str) else x
    except (TypeError, ValueError):
        return str(x)


def normal(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].astype(object).map(shown)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def differs(ours: pd.DataFrame, theirs: pd.DataFrame) -> str:
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    a, b = normal(ours), normal(theirs)
    off = (a != b).any(axis=1)
    return f"{off.sum()} of {len(a)} rows\n{a[off].head(3)}\n{b[off].head(3)}" if off.any() else ""


def main(args: list[str]) -> int:
    sf_dir = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf_dir, args = args[1], args[2:]
    import __spark_entry__ as entry
    from presslens.session import session

    spark, db, bad = session(), database(sf_dir), 0
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in args or queries:
        began = time.time()
        try:
            ours = queries[name](spark, sf_dir).toPandas()
            said = differs(ours, db.sql(oracle[name]).df()) if name in oracle else ""
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(said)
        print(f"{'BAD' if said else 'ok' if name in oracle else 'ran'} {name} {time.time() - began:.1f}s {len(ours) if not said else said}", flush=True)
    print(f"{bad} bad")
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
