import base64
import hashlib
import random

import numpy as np
import pytest

from expodex.llm import bpe
from expodex.llm.common import table

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def exact():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.fixture(scope="module")
def coder():
    with open(PATH, "rb") as f:
        return bpe.ByteBPE(f.read(), public_tokenizers.PATTERN)


def test_long_and_odd_pieces(coder, exact):
    rng = random.Random(1)
    texts = ["", "a" * 5000, "ab" * 3000, "the" * 700, "0" * 3000, "é" * 999, " " * 500 + "y", "日本語" * 50, "aab" * 500, "'s 'S 'll"]
    texts += ["".join(rng.choice("abeth") for _ in range(2000)) for _ in range(5)]
    texts += ["".join(rng.choice("theingaonr") for _ in range(rng.randrange(1, 200))) for _ in range(400)]
    texts += ["".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(2000))]
    ids, first = coder.encode_batch(texts)
    for k, text in enumerate(texts):
        own = ids[first[k] : first[k + 1]]
        assert own.tolist() == exact(text)
        assert coder.decode(own) == text.encode()


def test_whole_table_and_repeats(spark, data, exact, odd, none):
    for docs in (table(spark, data, "documents"), odd):
        rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        want = sorted(
            ((i, len(e := exact(t)), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows), key=str
        )
        got = bpe.encoded(docs, PATH, public_tokenizers.PATTERN, with_ids=True).collect()
        assert sorted((tuple(r)[:4] for r in got), key=str) == want
        assert all(len(r.ids) == r.n_tokens for r in got)
    assert bpe.encoded(none, PATH, public_tokenizers.PATTERN).count() == 0


def test_bounded_cache(coder, exact, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    for text in ("some words of one text " * 3, " ".join(f"w{k}" for k in range(300)), "some words again"):
        ids, _ = coder.encode_batch([text])
        assert ids.tolist() == exact(text)
