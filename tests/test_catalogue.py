"""Every registered graph query against its SQL twin on the small tables."""

import duckdb
import pytest

from tessel.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One or two of each family; the whole catalogue takes minutes and is what the driver compares.
NAMES = "deg_in edges_by_id edge_exists induced simplify loops_added bidirected undirected_copyfeat components line_edges khop_out2 expand_capped walk3 node2vec3 neg_uniform history_lastk block_layer hetero_block union_batch laplacian_sym adjacency_csr spmm edge_softmax prop_sym gcn pna attention_dot rel_mean standardize split_link filtered_mrr loss_ldam msg_last memory_replay part_boundary route_nodes".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame) -> list:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got, want = catalogue.queries()[name](spark, SF).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:  # both engines' numbers as one kind
        if got[c].dtype.kind in "fi" and want[c].dtype.kind in "fi":
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert rows(got) == rows(want)


def test_names_and_twins_agree():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert len(catalogue.queries()) > 150
