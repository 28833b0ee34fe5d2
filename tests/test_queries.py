"""Every query with an oracle, at the smallest size, against DuckDB."""

import math

import duckdb
import pytest

from bibloom.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows):
    def cell(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 9)
        return x

    return sorted(repr(tuple(cell(x) for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert canonical(map(tuple, got.select(*columns).collect())) == canonical(want)
