from __future__ import annotations

import corpus_pipeline
import pytest
from shelfspark.llm import bpe, jaccard, line_dedup, mixing, quality
from shelfspark.llm.common import stage
from shelfspark.llm.queries import MIX_TARGET, ORACLE, QUERIES, WORD_BPE


@pytest.fixture(scope="module")
def staged(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, function in corpus_pipeline.STAGES:
        out.append(stage(function(spark, out[-1], sf_dir), name))
    return out


def test_columns(staged):
    assert all(x.columns == staged[0].columns for x in staged[1:5])


def test_each_stage_against_its_operator(staged):
    start, kept, lines, near, mixed, encoded = staged
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(kept) == ids(quality.quality_rules(start).filter("kept"))
    clean = {r.id: r.clean for r in line_dedup.line_dedup(kept).collect()}
    assert {r.doc_id: r.text for r in lines.collect()} == {i: t for i, t in clean.items() if t.strip()}
    found = jaccard.near_classes(lines, 5, 80)
    assert ids(near) == ids(found.filter("doc_id = component_id"))
    copies = {r.doc_id: r.copies for r in mixing.mix_counts(near, MIX_TARGET).collect()}
    assert ids(mixed) == sorted(i for i, n in copies.items() for _ in range(n))
    model = bpe.load(WORD_BPE)
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == bpe.encode_text(model, texts[r.doc_id]) for r in encoded.collect())
    assert encoded.count() == mixed.count()


def test_clean_documents_stay(spark, sf_dir, staged):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    words = quality.quality_rules(staged[0]).filter("not base_failed").select("doc_id")
    want = {r.doc_id for r in labels.join(words, "doc_id").collect()}
    assert want <= {r.doc_id for r in staged[1].collect()}


def test_run(spark, sf_dir, staged):
    assert corpus_pipeline.run(spark, sf_dir).count() == staged[-1].count()


def test_empty_table(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_edge_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and identifiers, ties, and columns of names that the operators use."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n)) + "."
    long, twice, tie = prose(60_000), prose(80), prose(90)
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, long, "en", "a"), (4, twice, "en", "b"), (4, twice, "en", "b"), (None, prose(70), None, "b"), (7, tie, "de", None), (8, tie, "de", None)]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df = df.withColumns({c: F.lit(1) for c in ("id", "n", "token", "kept", "label", "templates", "mix_copies", "quality_text")})
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = [spark.read.parquet(str(tmp_path / "documents.parquet"))]
    for name, function in corpus_pipeline.STAGES:
        got.append(stage(function(spark, got[-1], str(tmp_path)), name))
    ids = [sorted((r.doc_id for r in x.collect()), key=repr) for x in got]
    assert all(x.columns == got[0].columns for x in got[1:5])
    assert ids[1] == ids[2] == [3, 4, 4, 7, 8, None] and ids[3] == [3, 4, 4, 7, None]
    assert {r.text for r in got[3].filter("doc_id = 3").collect()} == {long}
    model = bpe.load(WORD_BPE)
    assert set(ids[4]) <= set(ids[3]) and sorted(ids[5], key=repr) == ids[4]
    assert all(r.n_tokens == bpe.encode_text(model, long)[0] for r in got[5].filter("doc_id = 3").collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids[5])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_cover_their_tables(spark, sf_dir, name):
    table = {"op7_html_extract": "pages", "op13_vector_codes": "embeddings"}.get(name, "documents")
    assert QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_against_sql(spark, sf_dir, name):
    import duckdb

    c = duckdb.connect()
    for table in ("documents", "embeddings"):
        c.sql(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    want = c.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, sf_dir).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
