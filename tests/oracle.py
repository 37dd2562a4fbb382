import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canon(names, rows, digits=6):
    order = sorted(range(len(names)), key=names.__getitem__)

    def cell(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "None"
        if isinstance(x, (float, decimal.Decimal)):
            return f"{float(x) + 0.0:.{digits}f}"
        if isinstance(x, datetime.datetime):
            return x.isoformat()
        return str(list(x)) if isinstance(x, (list, tuple)) else str(x)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)
