"""python tests/oracle_compare.py [SF_DIR] [NAME...]: runs queries beside their SQL and says where they differ."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.12g}")
    return v if not hasattr(v, "isoformat") else v.isoformat()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    theirs = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if mine != theirs:
        return f"{len(mine)} and {len(theirs)} rows; first differences " + str([(a, b) for a, b in zip(mine, theirs, strict=False) if a != b][:2])
    return None


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    where = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    con, said = connect(where), entry.oracle_sql()
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        t = time.time()
        try:
            out = compare(session, con, name, query, said[name], where) if name in said else f"(no SQL; {query(session, where).count()} rows)"
        except Exception as e:
            out = "FAILED " + str(e)[:600]
        print(f"{name} {time.time() - t:.1f}s {out or 'equal'}", flush=True)
