import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from quillstack.llm.piece_codec import BPE, MARK, codec, decoded, default_model, encoded, library_codec, model_type, round_trip

CODEC = codec(default_model())


def brute(text):
    """The best segmentation by trying all pieces at each place."""
    if not text:
        return []
    s = MARK + text.replace(" ", MARK)
    best = [(0.0, [])]
    for end in range(1, len(s) + 1):
        options = []
        for start in range(max(0, end - 20), end):
            piece = s[start:end]
            if piece in CODEC.pieces:
                i, score = CODEC.pieces[piece]
                options.append((best[start][0] + score, best[start][1] + [i]))
        if s[end - 1] not in CODEC.pieces:
            options.append((best[end - 1][0] + CODEC.unknown, best[end - 1][1] + [CODEC.byte[b] for b in s[end - 1].encode()]))
        top = max(o[0] for o in options)
        best.append(next(o for o in options if o[0] == top))
    return best[-1][1]


def check(texts):
    array = pa.array(texts, pa.string())
    ids, at = CODEC.encode(array)
    raw, ends = CODEC.decode(ids, at)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == brute(t), t
        assert bytes(raw[ends[i] : ends[i + 1]]).decode() == (t or "")


def test_known():
    assert max(map(len, CODEC.pieces)) <= 20
    check(["Hello world", "", None, "  two  spaces ", " ", "a\tb\nc", "é ① 漢字 ﬁ", "x" * 50, "unbelievably internationalization"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcdefgh  the."), st.characters(exclude_categories=["Cs"])), max_size=25), max_size=5))
def test_any_text(texts):
    check([t.replace(MARK, "_") for t in texts])


def test_same_scores_as_the_library_in_its_unigram_mode():
    """The library's lattice gives the same best score once the model is marked as a unigram one."""
    raw = open(default_model(), "rb").read()
    spec = raw.rindex(b"\x18\x02 \x80\xfa\x01")  # model type 2, vocabulary size 32000
    library = SentencePieceProcessor(model_proto=raw[:spec] + b"\x18\x01" + raw[spec + 2 :])
    score = lambda ids: sum(CODEC.pieces[library.id_to_piece(i)][1] for i in ids)
    for t in ["the quick brown fox", "segmentation of unusual wordings", "Straße und Bäume"]:
        own = CODEC.segment(MARK + t.replace(" ", MARK))
        assert score(own) == score(library.nbest_encode(t, nbest_size=2)[0])


def test_tables(docs, odd):
    rows = [(i, t) for i, t in odd]
    got = round_trip(docs(*rows)).collect()
    assert len(got) == len(rows) and all(r.restored for r in got)
    back = decoded(encoded(docs(*rows))).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in back))) == sorted(map(repr, ((i, t or "") for i, t in rows)))
    assert round_trip(docs()).count() == 0


LIBRARY = SentencePieceProcessor(model_file=default_model())


def test_query_gives_the_ids_of_the_library(spark, docs):
    """Whole documents of sf0.01 and the odd ones, against the library's own encode."""
    assert model_type(default_model()) == BPE
    own = ["The quick brown fox", f"a{MARK} b{MARK}{MARK}c {MARK}", " x  y ", "ab" * 5_000, "漢字 ﬁ\0\n", "Straße " * 300, "", None]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(300).collect()]
    rows += [(-1 - i, t) for i, t in enumerate(own)]
    got = {r.doc_id: r.ids for r in encoded(docs(*rows)).collect()}
    counts = {r.doc_id: r.n_pieces for r in round_trip(docs(*rows)).collect()}
    for i, t in rows:
        assert got[i] == LIBRARY.encode(t or ""), (i, t and t[:80])
        assert counts[i] == len(got[i])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdefgh  the." + MARK), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text_as_the_library(text):
    ids, _ = library_codec(default_model()).encode(pa.array([text]))
    assert ids.tolist() == LIBRARY.encode(text)
