import datetime
import decimal
import math

import duckdb


def run_sql(sql, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def canon(names, rows, digits=7):
    order = sorted(range(len(names)), key=names.__getitem__)

    def cell(x):
        if isinstance(x, float) and math.isnan(x):
            return "None"
        if isinstance(x, (float, decimal.Decimal)):
            return f"{float(x):.{digits}g}"
        if isinstance(x, datetime.datetime):
            return x.isoformat()
        return str(x)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)
