"""The registered queries of the training-data operators: contract columns, folds, and SQL where there is some."""

import math
import os
import zlib

import duckdb
import pytest

from logloom.llm import registry

SMALL = "/root/testdata/sf0.001"
CONTRACT = {
    "op1_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_substring_dedup": {"doc_id": "bigint", "text": "string"},
    "op3_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_lm_scoring": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op5_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op6_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op7_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op8_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op9_mixing": {"doc_id": "bigint", "source": "string", "mix_slot": "bigint"},
    "op10_url_filters": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
}
FOLDS = {"op1_toxicity": (3, 1), "op3_quality_classifier": (4, 2), "op4_lm_scoring": (7, 2), "op6_language_id": (4, 2)}


def canon(rows):
    one = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(one(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_registered(spark, name):
    df = registry.queries()[name](spark, SMALL)
    assert CONTRACT[name].items() <= dict(df.dtypes).items()
    cols = sorted(df.columns)
    rows = df.select(*cols).collect()
    key = "page_id" if name.startswith("op10") else "doc_id"
    source = "pages" if name.startswith("op10") else "documents"
    want = [r[0] for r in duckdb.sql(f"SELECT {key} FROM '{SMALL}/{source}.parquet'").fetchall()]
    assert sorted(r[key] for r in rows) == sorted(want)
    if name in FOLDS:
        parts, held = FOLDS[name]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == held) for r in rows)
    if "predicted" in cols:
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    if name in registry.oracle_sql():
        con = duckdb.connect()
        for f in os.listdir(SMALL):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
        assert canon(map(tuple, rows)) == canon(con.execute(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall())
