"""Ids at the ends of their range in the files of operator 9."""

import zlib

import numpy as np

from provenlake.llm import common, rans


def test_least_id_is_not_null(spark):
    from tokenizers import Tokenizer

    path = common.vocabulary("word_bpe_49k.json")
    rows = [(-(1 << 63), "the least id"), (None, "an id of no one"), (None, "another"), ((1 << 63) - 1, "the greatest"), (0, None)]
    got = rans.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    tok = Tokenizer.from_file(path)
    ids = {t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t in rows}
    want = {(i, len(ids[t]), zlib.crc32(ids[t].tobytes())) for i, t in rows}
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == want
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, None, -(1 << 63), 0, (1 << 63) - 1]
