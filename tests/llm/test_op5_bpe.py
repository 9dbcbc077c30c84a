import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from terralift.llm import op5_bpe
from tests.llm.data import documents, texts

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library(reference):
    codec = op5_bpe.Codec(PATH, public_tokenizers.PATTERN)
    draw = random.Random(3)
    many = [t or "" for t in texts(5, 60)] + ["".join(chr(draw.choice([32, 97, 98, 233, 0x4E2D, 0x1F642, 10, 48])) for _ in range(200)) for _ in range(40)] + ["ab" * 3000, "<|endoftext|> it's  we'll\n\n x"]
    for t in many:
        got = codec.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == reference.encode_ordinary(t)
        assert codec.decode(got).decode() == t


def test_table(spark, reference):
    docs = documents(spark)
    rows = op5_bpe.encode_digests(docs, PATH, public_tokenizers.PATTERN, keep=["doc_id", "text"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = reference.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert op5_bpe.encode_digests(documents(spark, []), PATH, public_tokenizers.PATTERN, keep=["doc_id"]).count() == 0
    packed = op5_bpe.encode(docs, PATH, public_tokenizers.PATTERN, keep=["text"])
    back = op5_bpe.decode(packed, PATH, public_tokenizers.PATTERN, keep=["text"]).collect()
    assert all(bytes(r["bytes"]).decode() == (r["text"] or "") for r in back)
