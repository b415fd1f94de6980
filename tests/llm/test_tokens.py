import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillstack.llm.tokens import default_vocabulary, encoder, slices

LIBRARY = Tokenizer.from_file(default_vocabulary())


def check(texts):
    ids, bounds = encoder(default_vocabulary()).encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == LIBRARY.encode(t or "", add_special_tokens=False).ids, t


def test_known():
    check(["It's 12 can't!! don't''s", None, "", " a\tb\x0bc ", "ÉCOLE Ñandú Straße İ ŉ", "x<|endoftext|>y <|startoftext|", "é ①½漢字", "\x85a\xa0b c \x1cd", "'re 're''re !'s"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), st.text(alphabet="abcÉé'srtlmvd .,!19\t\n<|>", max_size=40)), max_size=6))
def test_any_text(texts):
    check(texts)


def test_slices_hold_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 50, 1, 0, 90)] + [None])], ["text"])
    parts = list(slices(batch, "text", 40))
    assert len(parts) > 1 and [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()
