"""Memory of the byte-pair step: decoding takes little beside its result, one worker a core."""

from __future__ import annotations

import tracemalloc

import numpy as np
import public_tokenizers

import corpus_pipeline
from billwright.llm import byte_bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_decoding_takes_little_beside_ids_and_bytes():
    own = byte_bpe.Encoder(RANKS, "")
    own.decode(np.zeros(0, np.int32), np.zeros(1, np.int64))  # the token table
    every = sorted(own.tokens)
    ids = np.resize(np.array(every, np.int32), 600_000)
    offsets = np.array([0, 0, 7, 300_001, len(ids)])
    tracemalloc.start()
    found = own.decode(ids, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = b"".join(own.tokens[i] for i in ids.tolist())
    assert b"".join(found.to_pylist()) == whole
    assert [len(x) for x in found.to_pylist()][:2] == [0, sum(len(own.tokens[i]) for i in every[:7])]
    assert peak < 2 * len(whole) + 16 * len(ids) + 64 * byte_bpe.BYTES_AT_ONCE


def test_pipeline_encodes_and_decodes_in_separate_stages(texts, spark):
    values = ["Two words", "", None, "ärger \U0001f600 12  x"]
    made = corpus_pipeline.tokenize(spark, texts(values), "")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    rows = {r.doc_id: r for r in made.collect()}
    assert all(r.round_trip for r in rows.values())
    assert [rows[i].n_tokens == 0 for i in range(4)] == [False, True, True, False]
    assert all(r.n_tokens == len(r.ids) for r in rows.values())
