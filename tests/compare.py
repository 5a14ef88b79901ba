"""Run registered queries and their SQL side by side: python tests/compare.py DIR [NAME ...]"""

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, bool):
        return str(v)
    return v if v is None else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def compare(df, con, sql) -> str | None:
    """None when equal, else what differs."""
    cursor = con.execute(sql)
    theirs = [d[0] for d in cursor.description]
    expected = rows_of(theirs, cursor.fetchall())
    if sorted(df.columns) != sorted(theirs):
        return f"columns {sorted(df.columns)} != {sorted(theirs)}"
    got = rows_of(df.columns, df.collect())
    if got != expected:
        return (f"{sum(got.values())} rows against {sum(expected.values())}; only here {list((got - expected).items())[:3]}; "
                f"only there {list((expected - got).items())[:3]}")
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, only = sys.argv[1], sys.argv[2:]
    con, queries, sqls, bad = connect(sf_dir), entry.queries(), entry.oracle_sql(), 0
    for name in only or queries:
        begun = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sqls:
                problem, n = compare(df, con, sqls[name]), "?"
            else:
                n, problem = df.count(), None
        except Exception as e:  # report and go on
            n, problem = -1, f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} rows={n} {time.time() - begun:.1f}s"
              f"{'' if name in sqls else ' (rows only)'}{'' if problem is None else ' ' + problem}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
