import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["live_filter", "newest_cards", "term_idf", "facet_boost", "tag_phrases", "occasion_lexicon", "prefix_terms", "symspell_deletes", "audit_cap", "audit_status", "audit_strict_and", "baseline_search", "understand_groups", "ladder_search"]


def plain(rows, columns):
    show = lambda v: f"{v:.9f}" if isinstance(v, float) else str(v)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    sql = con.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, SMALL)
    assert plain(df.collect(), df.columns) == plain(sql.fetchall(), sql.columns)


def test_each_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
