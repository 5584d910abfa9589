"""Every query runs; those with SQL agree with it; the pipeline's stages hold what they promise."""

import importlib
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import brute  # noqa: E402
from test_near_copies import groups  # noqa: E402
import corpus_pipeline  # noqa: E402
from junctura.llm import oracles, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    flat = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted(columns), sorted(repr([flat(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    cursor = con.cursor().execute(queries.ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in cursor.description], cursor.fetchall())


def test_op1_agrees_with_sql_and_its_shards_add_up(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    cursor = con.cursor().execute(oracles.OP1)
    found = queries.op1_mixing(spark, SF)
    assert rows(found.columns[:5], [r[:5] for r in found.collect()]) == rows([d[0] for d in cursor.description], cursor.fetchall())
    assert all(sum(int(x.split(":")[1]) for x in r.shards.split(",") if x) == r.taken for r in found.collect())


def test_other_queries_match_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = queries.op6_simhash(spark, SF).collect()
    assert sorted(map(tuple, found)) == sorted(brute.op6(docs))
    assert queries.op5_html_extraction(spark, SF).count() == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert {r.doc_id for r in queries.op10_best_fit_packing(spark, SF).collect()} == {d for d, _ in docs}


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.op3_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in scored)
    assert len(scored) > 50 and right >= 0.95 * len(scored)


def near(docs):
    """The smallest doc_id of each group of texts with a five-word Jaccard index of 0.8, by comparing all pairs."""
    found = groups([r["text"] for r in docs])
    return {min(r["doc_id"] for r, h in zip(docs, found, strict=True) if h == g) for g in set(found)}


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        kept.append([r.asDict() for r in docs.collect()])
        assert n == 4 or docs.columns == columns
    ruled, unique, cut, mixed, packed = kept
    judged = {r.doc_id: r.kept for r in queries.op2_quality_rules(spark, SF).collect()}
    assert {r["doc_id"] for r in ruled} == {d for d, k in judged.items() if k}
    assert sorted(r["doc_id"] for r in unique) == sorted(near(ruled))
    removed = {d: (n, gone) for d, n, gone, _ in brute.op4([(r["doc_id"], r["text"]) for r in unique])}
    assert {r["doc_id"]: len(brute.words(r["text"])) for r in cut} == {d: n - gone for d, (n, gone) in removed.items() if gone < n}
    size = {r["doc_id"]: len(brute.words(r["text"])) for r in cut}
    assert {r["doc_id"] for r in mixed} <= set(size) and all(len(brute.words(r["text"])) <= size[r["doc_id"]] for r in mixed)
    assert abs(sum(len(brute.words(r["text"])) for r in mixed) - sum(size.values())) <= 20
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed}


def test_modules_import_alone():
    assert importlib.reload(queries).QUERIES
