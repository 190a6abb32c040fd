"""The pipeline and the registered queries on the driver's small tables, against plain versions."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from zonewatch.llm import entries, langid, toxicity
from zonewatch.llm.common import save, table, text_crc

from .test_text_operators import components_by_hand, lines_by_hand


def test_sql(spark, sf_dir):
    paths = {t: f"{sf_dir}/{t}.parquet" for t in ("documents", "embeddings")}
    con = duckdb.connect()
    for t, path in paths.items():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    for name, sql in entries.ORACLE_SQL.items():
        got, want = entries.QUERIES[name](spark, sf_dir).toPandas(), con.sql(sql).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        pd.testing.assert_frame_equal(*(x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want)), check_dtype=False)


@pytest.mark.parametrize("name", sorted(entries.QUERIES))
def test_contract_columns(spark, sf_dir, name):
    out = entries.QUERIES[name](spark, sf_dir)
    need = {
        "op1": "doc_id held_out lang_pred score", "op2": "doc_id held_out score predicted", "op3": "doc_id size text_crc32 law shard slot grown_shard",
        "op4": "doc_id n_shingles component_id kept", "op5": "doc_id n_tokens ids_sha256 decoded_sha256", "op6": "query_id rank vec_id score",
        "op7": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op8": "vec_id n_links component_id kept",
        "op9": "doc_id n_lines n_dropped kept_sha256", "op10": "doc_id piece start length ids_crc32 sequence_id offset",
        "op11": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
        "op12": "doc_id n_words n_base first_word last_word base_labels labels score", "op13": "word form root n n_near form_n"}[name.split("_")[0]]
    assert set(need.split()) <= set(out.columns)
    if name.split("_")[0] in ("op1", "op2", "op3", "op4", "op5", "op9", "op11", "op12"):
        assert out.count() == table(spark, sf_dir, "documents").count()


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, before = docs.columns, docs
    for (name, stage), n in zip(corpus_pipeline.STAGES, range(5)):
        after = save(stage(spark, before, sf_dir), name)
        rows = [(r.doc_id, r.text) for r in before.collect()]
        if n < 4:
            assert after.columns == columns
            ids = {r.doc_id: r.text for r in after.collect()}
        if name == "toxicity":
            model = toxicity.fit(before, table(spark, sf_dir, "labels"), text_crc(F.col("doc_id")) % 4 != 2)
            gone = {r.doc_id for r in toxicity.score(before, model, threshold=0.5).where("predicted = 1").collect()}
            assert ids.keys() == {i for i, _ in rows} - gone
        elif name == "language":
            model = langid.fit(before, text_crc(F.col("doc_id")) % 3 != 1)
            assert ids.keys() == {r.doc_id for r in langid.predict(before, model).where("lang_pred <> 'und' AND score >= 0.4").collect()}
        elif name == "lines":
            assert ids == {i: t for i, t, _, _ in lines_by_hand(rows)}
        elif name == "near_copies":
            assert ids.keys() == {i for i, _, c in components_by_hand(rows) if i == c}
        else:
            assert {r.doc_id for r in after.collect()} == {i for i, _ in rows}
        before = after
