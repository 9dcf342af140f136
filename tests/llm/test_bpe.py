import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import bpe, counts, pretokens

from .conftest import HARD

HERE = os.path.dirname(bpe.TOKENIZER)
needs = pytest.mark.skipif(not os.path.exists(bpe.TOKENIZER), reason="no vocabulary files here")
pytestmark = needs
TEXTS = [t for _, t in HARD if t and len(t) < 1000] + ["aaaaaaaaaaaaaaaaaaaaaa", "   three   blanks  ", "lower UPPER Mixed1Case2", "https://x.y/z?a=b&c=d", "\n\n \n", "ééééé", "don't I'll"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.TOKENIZER)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def ids_of(text, path=bpe.TOKENIZER):
    return bpe.encode_texts([text], bpe.automaton(path))[0].tolist()


@pytest.mark.parametrize("text", TEXTS)
def test_same_as_the_library(library, text):
    assert ids_of(text) == library(text)


def test_random_texts_same_as_the_library(library):
    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=60))
    def check(text):
        got = ids_of(text)
        assert got == library(text)
        assert bpe.automaton(bpe.TOKENIZER).decode(got).decode() == text
        assert counts.count_texts([text], bpe.automaton(bpe.TOKENIZER))[0][0] == len(got)

    check()


def test_ranks_file(library):
    import tiktoken

    path = f"{HERE}/byte_bpe_multi_50k.tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    auto = bpe.MergeAutomaton(*bpe.load(path))
    enc = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    for word in ("hello", "überraschung", "ñandú", "aaaaaaaaaa", "漢字", "1234567"):
        assert auto.encode(word.encode()) == enc.encode_ordinary(word)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 256])
def test_chunks_compose(size):
    """The prefix scan gives the same words whatever the chunks."""
    import numpy as np

    text = " ".join(TEXTS) + pretokens.BREAK
    kinds = pretokens.classes()[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)].copy()
    kinds[-1] = pretokens.END
    assert (pretokens.starts(kinds, size) == pretokens.starts(kinds, len(kinds))).all()


def test_hard_rows(hard, none):
    rows = bpe.encode(hard).collect()
    assert len(rows) == len(HARD) and all(r["round_trip"] in (True, None) for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["tokens"] is None and by[3]["n_tokens"] is None and by[2]["tokens"] == [] and by[2]["round_trip"]
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(hard)).collect()}
    assert {k: back[k] for k, _ in HARD} == dict(HARD)
    assert bpe.encode(none).count() == 0 and bpe.decode(bpe.encode(none)).count() == 0


def test_counts_are_the_tokens_number(hard, none):
    a = sorted((str(r["doc_id"]), r["n_tokens"] or 0) for r in bpe.encode(hard).collect())
    rows = counts.count_tokens(hard).collect()
    assert a == sorted((str(r["doc_id"]), r["n_tokens"] or 0) for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["n_tokens"] is None and by[3]["n_bytes"] is None and (by[2]["n_tokens"], by[2]["n_words"], by[2]["n_bytes"]) == (0, 0, 0)
    assert counts.count_tokens(none).count() == 0


def test_long_words_and_new_tables():
    """A long word without blanks, and a table that begins anew again and again, give the same tokens."""
    auto = bpe.automaton(bpe.TOKENIZER)
    texts = ["aé漢" * 3000, "x" * 5000, "1234567890" * 400, *TEXTS]
    want = bpe.encode_texts(texts, auto)
    small = bpe.Transducer(auto, 50)
    for text, n in zip(texts, want[1].tolist()):
        stream, starts, ends, _ = pretokens.spans([text])
        assert small.counts(stream, starts, ends).sum() == n
    assert sum(map(len, map(auto.label.__getitem__, want[0].tolist()))) == sum(len(t.encode()) for t in texts)
