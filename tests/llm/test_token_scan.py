from __future__ import annotations

import numpy as np
import pytest
from shelfspark.llm import token_scan as ts
from shelfspark.llm.queries import BYTE_BPE, byte_pattern


def test_counts(documents, sample):
    encode = ts.encoder(BYTE_BPE, byte_pattern()).encode_ordinary
    rows = [r[:2] for r in sample] + [(10**12, None), (-5, ""), (7_000_000, "x" * 300_000), (7_000_000, "again"), (None, "nobody"), (2**62, "Ā Ā")]
    got = sorted(((r.doc_id, r.n_tokens) for r in ts.token_counts(documents(rows), BYTE_BPE, byte_pattern()).collect()), key=repr)
    assert got == sorted(((i, len(encode(t or ""))) for i, t in rows), key=repr)


def test_empty(documents, clashing):
    assert ts.token_counts(documents([]), BYTE_BPE, byte_pattern()).count() == 0
    assert ts.token_counts(clashing([(1, "a b")]), BYTE_BPE, byte_pattern()).first().n_tokens == 2


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_stitching_across_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    want = {}
    for k in range(3):
        ids = rng.integers(0, 6, 200)
        ids[rng.integers(0, 200, 5)] = 5
        if k == 1:
            ids[40:160] = 1
        ids.astype(">u2").tofile(tmp_path / f"f{k}.txt")
        at = np.flatnonzero(ids == 5)
        starts = np.concatenate(([0], at[:-1] + 1)) if len(at) else at
        want |= {(f"f{k}.txt", i): (int(a), int(b - a)) for i, (a, b) in enumerate(zip(starts, at))}
    blocks = ts.scan_blocks(spark, f"file://{tmp_path}", end=5, block_tokens=block)
    got = {(r.file.rsplit("/", 1)[-1], r.doc_index): (r.start, r.n_ids) for r in ts.stitch(blocks).collect()}
    assert got == want


def test_headers_spell_identifiers():
    for i in (0, 1, -1, 2**63 - 1, -(2**63) + 1, 39_999, 40_000):
        spelled = ts.header_of(i)
        assert max(spelled) < ts.HEADER_BASE < ts.END_OF_DOCUMENT and ts.ids_of(np.array([spelled])) == [i]
    assert ts.ids_of(np.array([ts.header_of(None)])) == [None]
