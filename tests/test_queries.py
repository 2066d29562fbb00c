"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from talkloom.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return c


def normal(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(normal, x))
    return x


CHOSEN = ["o12_failure_flags", "o14_failure_by_chunk_cluster", "o17_cluster_profile", "o02_conversation_docs", "o08_chunker", "d14_cited_against_actual", "d28_language_coherence", "d40a_conversation_label_table", "v08_merge_clusters", "v29_training_pairs", "z04_decomposition", "z13_measures", "o24_failed_keywords", "o01_pseudonymise_and_scrub", "f28_json_path", "p04_between_dates", "p14_length_range", "p16_valid_configs", "t02_nulls_last", "v28_cluster_cards", "z05e_partial_autocorrelation", "z06_date_spine", "z01_trend", "z05a_autocorrelation", "z05b_jarque_bera", "v12_representatives", "v15a_davies_bouldin", "v15b_calinski_harabasz", "v27_top_terms"]


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    want = duck.execute(catalog.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: tuple(str(x) for x in r)
    got = sorted((tuple(normal(x) for x in r) for r in df.select(*columns).collect()), key=key)
    assert got == sorted((tuple(normal(x) for x in r) for r in want.fetchall()), key=key)


def test_names_match():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
