"""Registered queries against their DuckDB oracles, or against brute force over a whole small table."""
import zlib

import brute
import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_oracle import _rows
from tokenizers import Tokenizer

from edge_tables import edge_docs, edge_rows, no_docs  # noqa: F401

import __spark_entry__ as entry
from featurelab.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def _texts():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()


def test_registration():
    names = set(entry.queries())
    assert set(QUERIES) <= names and "pipeline" in names and set(ORACLES) <= set(entry.oracle_sql())
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    a, b = _rows(QUERIES[name](spark, SF).toPandas()), _rows(duck.execute(ORACLES[name]).df())
    assert a == b


def test_op1_matches_brute_force(spark):
    rows = _texts()
    want = {i: (n, g, s, brute.sha(k)) for (i, _), (n, g, s, k) in zip(rows, brute.repeats([t for _, t in rows]))}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op1_suffix_array_dedup"](spark, SF).collect()}
    assert got == want


def test_op4_matches_brute_force(spark):
    want = brute.components(_texts())
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op4_minhash_near_dedup"](spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("name", ["op2_language_id", "op5_toxicity"])
def test_folds_and_columns(spark, name):
    out = QUERIES[name](spark, SF).collect()
    assert sorted(r["doc_id"] for r in out) == [i for i, _ in _texts()]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in out)


def test_op7_counts_add_up(spark):
    got = QUERIES["op7_token_counts"](spark, SF).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"))
    whole = QUERIES["op10_best_fit_packing"](spark, SF).groupBy("doc_id").agg(F.sum("length").alias("m"))
    # the rendered document holds its text's tokens, and those of two short fields and two line ends
    bad = got.join(whole, "doc_id").where("n < m or n > m + 12").count()
    assert bad == 0 and got.count() == len(_texts())


def test_op8_orders_the_calls_of_the_whole_table(spark):
    calls = {(r["conv_id"], r["turn"]): r["level"] for r in QUERIES["op8_chat_dependencies"](spark, SF).where("step = 0 and role = 'assistant'").collect()}
    want = {}
    for conv, turn in sorted(duckdb.sql(f"select conv_id, turn from '{SF}/conversations.parquet' where role = 'user'").fetchall()):
        want[conv, turn] = max(want.get((conv, turn - 1), -1), want.get((conv, turn - 2), -1)) + 1
    assert calls == want and max(want.values()) > 1


def test_op9_columns(spark):
    out = QUERIES["op9_html_extraction"](spark, SF)
    assert out.columns[:4] == ["page_id", "url", "text", "n_chars"]
    assert out.where(F.length("text") != F.col("n_chars")).count() == 0


def test_pipeline_matches_brute_force(spark):
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    rows = [(i, t) for i, t in _texts() if brute.good(t)]
    comp = brute.components(rows, 80)
    rows = [(i, t) for i, t in rows if comp[i][1] == i]
    rows = [(i, k.decode("utf-8", "ignore")) for (i, _), (*_, k) in zip(rows, brute.repeats([t for _, t in rows]))]
    rows = [(i, t) for i, t in rows if not (lambda n, h, _: h > 0 and 20 * h >= n)(*brute.contamination(t, items))]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in rows}
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == set(want)
    for i, pieces in got.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["piece"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(want[i][at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(want[i])
    assert len(want) > 50 and max(map(len, got.values())) > 1


def test_pipeline_stages_keep_columns_and_handle_odd_rows(spark, edge_docs, edge_rows, no_docs):
    docs = edge_docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs = docs.union(docs.where("doc_id in (6, 8)")).union(docs.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert tuple(stage(spark, no_docs, SF).columns) == corpus_pipeline.COLUMNS
        docs = stage(spark, docs, SF)
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    ids = [r["doc_id"] for r in docs.collect()]
    assert len(ids) == len(set(ids)) and 6 in ids
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= len(ids)
