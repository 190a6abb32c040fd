"""Every query of the library against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from zonewatch.plans.oracles import ORACLES, STORED_ORACLES, WHOLE_ORACLES
from zonewatch.plans.queries import QUERIES, WHOLE
from zonewatch.plans.storequeries import STORED


def rows(df: pd.DataFrame) -> list[str]:
    def plain(x):
        if x is None or x is pd.NA or x != x:
            return None
        x = x.item() if hasattr(x, "item") else x
        return round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    df = df[sorted(df.columns)]
    return sorted(str([plain(x) for x in r]) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    path = f"{sf_dir}/documents.parquet"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys() and WHOLE.keys() == WHOLE_ORACLES.keys() and STORED.keys() == STORED_ORACLES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, db, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(db.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(STORED))
def test_job(spark, sf_dir, db, name):
    assert rows(STORED[name](spark, sf_dir).toPandas()) == rows(db.sql(STORED_ORACLES[name]).df())


#: Those of the whole zone that decode names, or see them coded for the first time.
IDNA = ("display_names", "skeleton_fold", "squat_homoglyph", "match_by_brand", "match_lines", "zone_stage_dedup", "lexical_features", "zone_diff_events")


@pytest.mark.parametrize("name", IDNA)
def test_whole_zone(spark, sf_dir, db, name):
    assert rows(WHOLE[f"whole_{name}"](spark, sf_dir).toPandas()) == rows(db.sql(WHOLE_ORACLES[f"whole_{name}"]).df())
