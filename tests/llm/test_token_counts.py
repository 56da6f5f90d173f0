import os

import numpy as np
import pytest

from tallymill.llm import token_counts


@pytest.mark.parametrize(("block", "run"), [(1, 5), (3, 2), (7, 4096), (1 << 20, 1)])
def test_scan(spark, tmp_path, block, run):
    chance = np.random.default_rng(block)
    want, files = {}, []
    for k in range(4):
        lengths = [0, 0, *chance.integers(0, 12, 30), 0][: 0 if k == 3 else None]
        parts = [np.append(chance.integers(0, 50, n), 999) for n in lengths]
        if k == 1:
            parts.append(chance.integers(0, 50, 5))  # no separator at the end
            lengths.append(5)
        tokens = np.concatenate(parts).astype("<u2") if parts else np.zeros(0, "<u2")
        path = str(tmp_path / f"f{k}")
        tokens.tofile(path)
        files.append((path, len(tokens)))
        want |= {(path, i): int(n) for i, n in enumerate(lengths)}
    got = token_counts.scan(spark.createDataFrame(files, "file string, tokens long"), end=999, block=block, run=run).collect()
    assert {(r.file, r.ordinal): r.n_tokens for r in got} == want and len(got) == len(want)


@pytest.mark.skipif(not os.path.exists(token_counts.VOCABULARY), reason="no vocabulary file here")
def test_documents(spark):
    rows = [(1, "Hello wörld, <|endoftext|> 123"), (2, None), (3, ""), (4, "a b c " * 50_000), (5, "x"), (5, "x"), (6, "a" * 160_000), (None, "null id")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_tokens string")
    encode = token_counts.encoder(token_counts.VOCABULARY).encode_ordinary
    want = sorted(((i, len(encode(t or ""))) for i, t in rows), key=str)
    for block in (5, 1 << 20):
        assert sorted(((r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs, block=block).collect()), key=str) == want
    assert token_counts.token_counts(docs.where("false")).count() == 0
