import duckdb
import pytest

import __spark_entry__

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", ["fold_metrics", "fold_digest", "interval_stats", "range_accumulate", "strat_split", "spearman", "kruskal_h", "rater_pairs", "best_epoch", "pixel_stats"])
def test_query_equals_sql(spark, name):
    df = __spark_entry__.queries()[name](spark, DIR)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    key = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert key(tuple(r[c] for c in columns) for r in df.collect()) == key(tuple(r[i] for i in place) for r in want.fetchall())
