"""Every registered query that has SQL gives the same rows as DuckDB."""

import duckdb
import pandas as pd
import pytest

from ammlytics.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(df):
    def show(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return None
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return repr(round(float(v), 6) + 0.0)
        return pd.Timestamp(v).isoformat() if hasattr(v, "isoformat") else str(v)

    return sorted((tuple(show(v) for v in row) for row in df[sorted(df.columns)].astype(object).values.tolist()), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


#: Queries of two names; what once kept them to a part of their rows.
WHOLE = {"split_route_buy": "id < 60", "split_route_sell": "id < 60", "venue_verdicts": "% 40", "decile_medians": "% 97", "null_bar_shuffle": "i < 200", "equity_curve": "i < 60", "lp_concentrated": "i < 300", "dense_panel": "1995", "interval_weights": "1995"}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_query_over_all_rows(spark, sf_dir, duck, name):
    """No query keeps to a part of its rows, under either name."""
    assert WHOLE[name] not in ORACLES[name]
    other = f"{name}_all"
    if other in QUERIES:
        assert ORACLES[other] == ORACLES[name]
        assert canonical(QUERIES[other](spark, sf_dir).toPandas()) == canonical(QUERIES[name](spark, sf_dir).toPandas())


def test_walk_forward_walks_all_bars(spark):
    from ammlytics.operators import research as R
    from ammlytics.plans.research import ib
    from ammlytics.sources.fixtures import Tables

    sf_dir = "/root/testdata/sf0.01"  # more than 600 bars a pair
    settings = {"boll_rev": (20, 1.5), "donchian_bo": (20,)}, [(0.15, 0.1, 10), (0.3, 0.2, 20), (0.05, 0.05, 5)]
    whole = R.walk_forward(ib(Tables(spark, sf_dir)), *settings, is_len=240, oos_len=120).toPandas()
    for c in ("net", "avg_trade", "pf"):  # the query rounds to nine digits first
        whole[c] = whole[c].astype(float).round(9)
    assert canonical(QUERIES["walk_forward"](spark, sf_dir).toPandas()) == canonical(whole)
    assert ib(Tables(spark, sf_dir)).where("i >= 600").count()


def test_queries_without_sql(spark, sf_dir):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, sf_dir).count() >= 0
