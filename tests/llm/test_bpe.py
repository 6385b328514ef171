import hashlib

import numpy as np
import pytest

pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from conftest_llm import ODD  # noqa: E402
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from quartier.llm.bpe import Encoder, digests, encode, load  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
OWN = Encoder(load(PATH))
HARD = [
    "", "Hello, World's   IT'S we'll don't 123 ½ ²", "aaaaaaaaa AAAAAA abababab", "\x1c\x85\xa0 x᠎y​z",
    "ΣΑΣ Σ İstanbul ẞ", "é <|endoftext|> b<|startoftext|><|endoftext|>c", "日本語 한국어 🙂🙂 \u0000", "é" * 300,
    "<|endoftext|", "ſ K Å", "!!!!!!!!!!??!!...", "ǅ ŉ",
]


def check(texts):
    for text, ids in zip(texts, OWN.encode(texts)):
        assert ids.tolist() == LIB.encode(text, add_special_tokens=False).ids, text
        assert OWN.decode(ids.tolist()).decode() == LIB.decode(ids.tolist(), skip_special_tokens=False)


def test_equals_library():
    check(HARD)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcthein A'1sé.\n🙂"), max_size=40), max_size=4))
def test_equals_library_on_any_text(texts):
    check(texts)


def test_odd_rows_and_empty_table(make_docs):
    got = digests(make_docs(ODD), PATH).collect()
    assert len(got) == len(ODD)
    want = sorted(
        (str(i), (e := LIB.encode(t or "", add_special_tokens=False)).ids.__len__(), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIB.decode(e.ids, skip_special_tokens=False).encode()).hexdigest())
        for i, t in ODD
    )
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    assert digests(make_docs([]), PATH).count() == 0
    assert encode(make_docs(ODD[:1]), PATH).collect()[0].ids == []
