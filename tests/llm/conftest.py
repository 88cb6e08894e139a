from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture()
def documents(spark):
    """A documents table from (doc_id, text) pairs or whole rows."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def sample(spark):
    """Rows of the driver's own documents."""
    return [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]


@pytest.fixture()
def clashing(documents):
    """A documents table with extra columns whose names the operators use themselves."""

    def make(rows):
        from pyspark.sql import functions as F

        df = documents(rows)
        return df.withColumns({c: F.lit(1) for c in ("id", "n", "token", "kept", "digest", "mix_copies", "mix_copy", "mix_weight", "mix_cut", "mix_epochs", "mix_source_key", "mix_share", "mix_exponent", "in_0", "bucket", "label", "signature", "templates", "lost", "held_out", "quality_text")})

    return make
