import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from costloom.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
CASES = ["", " ", "   ", "a", " a", "a ", "a  b", "\na\n\tb", "▁a▁▁", "é ﬁ 　x", "<s> </s> <0x0A> <unk>", "\x00 \x01", "😀 x😀y", None, "x" * 5000, "a b " * 30000]


def test_equals_the_library(docs, sample):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = list(enumerate(CASES)) + [(100 + r.doc_id, r.text) for r in sample.collect()]
    got = {r.doc_id: r for r in pieces.encode_decode(docs(rows), pieces.model_bytes(PATH), with_ids=True).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        ids = sp.encode(text or "", add_bos=True, add_eos=True)
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_cases(docs, clashing):
    model = pieces.model_bytes(PATH)
    out = pieces.encode_decode(clashing([(None, None), (1, "x"), (1, "x")]), model).collect()
    assert sorted(r.n_tokens for r in out) == [2, 3, 3]
    assert pieces.encode_decode(docs([]), model).collect() == []


def test_refuses_other_vocabularies():
    class Crossing:
        get_piece_size = lambda self: 1
        id_to_piece = lambda self, i: "a▁b"

    with pytest.raises(ValueError, match="crosses"):
        pieces.check_vocabulary(Crossing())
