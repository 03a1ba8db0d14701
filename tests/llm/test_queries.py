import os
from collections import Counter

import duckdb
import public_tokenizers
import pytest

import corpus_pipeline
from framewright.llm import quality_rules, queries
from framewright.llm import sentencepiece_nbest as sp

from ..test_queries import SF_DIR, TABLES, rows
from .test_jaccard_join import brute as components
from .test_substring_dedup import brute as repeats

needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF_DIR).toPandas()
    want = con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@needs_tables
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_covers_its_table(spark, name):
    out = queries.QUERIES[name](spark, SF_DIR)
    table = "pages" if name.startswith("op7") else "documents"
    if not name.startswith("op10"):
        assert out.count() == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
    else:
        assert out.count() > 0


def test_stages_follow_one_another(spark, tmp_path, edge_docs, edge_rows):
    item = next(t for d, t in edge_rows if d == 6)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(6, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = edge_docs.selectExpr("doc_id", "text", "cast(null as string) as lang", "cast(null as string) as source", "cast(length(text) as long) as n_chars", "1 as sid", "2 as rest")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, str(tmp_path))
        assert name == "pieces" or after.columns == docs.columns
        path = str(tmp_path / name)
        after.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = [(r.doc_id, r.text) for r in docs.collect()]
    verdicts = [quality_rules.measure([(t or "").encode()], quality_rules.Bands())["kept"][0] for _, t in edge_rows]  # held against brute force elsewhere
    assert Counter(seen["quality"]) == Counter(r for r, kept in zip(edge_rows, verdicts) if kept)
    groups = {c if c is not None else ("null", i) for i, (_, n, c) in enumerate(components(seen["quality"])) if n}
    assert len(seen["near_duplicates"]) == len(groups)
    assert set(seen["near_duplicates"]) <= set(seen["quality"])
    want = Counter()
    for (d, t), (_, n, lost, kept) in zip(seen["near_duplicates"], repeats(seen["near_duplicates"])):
        if lost < n:
            want[d, kept if lost else t] += 1
    assert Counter(seen["repeated_passages"]) == want
    assert {d for d, _ in seen["repeated_passages"]} - {d for d, _ in seen["benchmark_leaks"]} == {6}
    assert Counter(seen["pieces"]) == Counter(seen["benchmark_leaks"])
    assert docs.where("not round_trip").count() == 0
    model = sp.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    for r in docs.collect():  # the pieces spell the text, a space ahead, and cost what they cost
        assert b"".join(model.bytes[i] for i in r.ids) == b" " + r.text.encode() and r.n_pieces == len(r.ids)
        assert r.cost == sum(int(model.cost[i]) for i in r.ids) and all(o.cost >= r.cost for o in r.others)


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.collect() == []
