import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillstack.llm.common import shared_path, table
from quillstack.llm.grammar import BASE, SCHEMA, Block, compress, expand, packed, round_trip, unpacked, write_ids
from quillstack.llm.tokens import END_ID, default_vocabulary, encoder


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=60), max_size=8))
def test_round_trip_and_random_access(documents):
    parts = [np.array([*d, END_ID], np.uint32) for d in documents]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    block = Block.from_bytes(Block.of(pa.array(np.arange(len(parts))), ids, bounds).to_bytes())
    assert (block.ids() == ids).all()
    for k, p in enumerate(parts):
        assert (block.document(k) == p).all()
        for a, b in ((0, 1), (1, 5), (len(p) - 1, len(p)), (3, 3)):
            assert (block.document(k, a, b) == p[a:b]).all()


def test_rules_pay_and_stay_within_documents():
    ids = np.array(([5, 6, 7, 8] * 50 + [END_ID]) * 20, np.uint32)
    grammar = compress(ids)
    assert len(grammar.left) > 2 and len(grammar.symbols) < len(ids) / 8
    assert (expand(grammar) == ids).all()
    assert END_ID not in grammar.left and END_ID not in grammar.right
    assert (grammar.lengths() >= 2).all() and (np.maximum(grammar.left, grammar.right) < BASE + np.arange(len(grammar.left))).all()


def test_files(spark, docs, odd):
    library = Tokenizer.from_file(default_vocabulary())
    rows = [*odd, (-(1 << 63), "least"), *[(i, f"text {i} " * (i % 7)) for i in range(100, 400)]]
    got = sorted(round_trip(docs(*rows)).collect(), key=lambda r: r.start)
    assert [r.doc_id is not None for r in got].index(True) == 1  # null ids first
    ids = [r.doc_id for r in got[1:]]
    assert ids == sorted(ids) and len(got) == len(rows)
    at, want = 0, {}
    for i, t in rows:
        own = [*library.encode(t or "", add_special_tokens=False).ids, END_ID]
        want.setdefault(i, []).append((len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        at += r.n_tokens
    assert round_trip(docs()).count() == 0
    path = shared_path(spark, "test-ids")
    write_ids(docs(*rows), path)
    assert spark.read.schema(SCHEMA).parquet(path).agg({"documents": "sum"}).first()[0] == len(rows)


def test_large_ids_and_widths():
    rng = np.random.default_rng(2)
    for top in (2, 70_000, 3_000_000):
        ids = np.concatenate((np.tile(rng.integers(2, top + 1, 40), 30), [END_ID])).astype(np.uint32)
        block = Block.from_bytes(Block.of(pa.array([5]), ids, np.array([0, len(ids)])).to_bytes())
        assert (block.ids() == ids).all() and (block.document(0, 7, 300) == ids[7:300]).all()
        assert block.grammar.base > top or top < BASE
    for width in (1, 7, 17, 31):
        values = rng.integers(0, 1 << width, 101)
        raw = b"xyz" + packed(values, width)
        assert all((unpacked(raw, 3, width, a, n) == values[a : a + n]).all() for a, n in ((0, 101), (13, 20), (100, 1), (50, 0)))


def plain(seq, least):
    """Re-Pair one pair at a time: (symbols, rules)."""
    seq, rules = seq.astype(np.int64), 0
    while len(seq) > 1:
        key = seq[:-1] * (1 << 32) + seq[1:]
        sound = (seq[:-1] != END_ID) & (seq[1:] != END_ID)
        pairs, n = np.unique(key[sound], return_counts=True)
        if not len(n) or n.max() < least:
            break
        hits, at = [], -2
        for h in np.flatnonzero((key == pairs[n.argmax()]) & sound).tolist():
            if h > at + 1:
                hits.append(at := h)
        if len(hits) < least:
            break
        seq[hits] = (1 << 25) + rules
        seq = np.delete(seq, np.array(hits) + 1)
        rules += 1
    return len(seq), rules


def test_rounds_come_near_plain_re_pair(spark, small):
    texts = table(spark, small, "documents").select("text").toPandas()["text"]
    ids, _ = encoder(default_vocabulary()).encode_documents(pa.array(texts, pa.string()))
    ids = ids[:40_000]
    symbols, rules = plain(ids, 4)
    grammar = compress(ids)
    assert len(grammar.symbols) + 2 * len(grammar.left) <= 1.05 * (symbols + 2 * rules)


def test_rare_pairs_leave_their_slots():
    """A pair that occurs too rarely isn't counted again: it takes no slot from a frequent one, and no more time."""
    rng = np.random.default_rng(5)
    phrases = rng.integers(2, 40_000, (3_000, 6))
    often = phrases[rng.permutation(np.repeat(np.arange(3_000), 12))].ravel()
    ids = np.concatenate((often, rng.integers(2, 40_000, 600_000), [END_ID])).astype(np.uint32)
    grammar = compress(ids)
    assert (expand(grammar) == ids).all()
    assert len(grammar.symbols) < 600_000 + len(often) / 4
