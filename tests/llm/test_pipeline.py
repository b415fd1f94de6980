import re
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from quillstack.llm import queries
from quillstack.llm.common import job, stored, table
from quillstack.llm.tokens import default_vocabulary

from .test_parity_join import brute


def test_stages_against_brute_force(spark, small):
    docs = table(spark, small, "documents")
    columns = docs.columns
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stored(stage(spark, frames[-1], small), f"test-{name}"))
    assert all(f.columns == columns for f in frames[:-1])
    rows = [{r.doc_id: r.text for r in f.collect()} for f in frames[:-1]]
    labels = {r.doc_id: r.quality for r in table(spark, small, "labels").collect()}
    clean = [i for i in rows[0] if labels.get(i) == 1]
    assert sum(i in rows[1] for i in clean) >= 0.95 * len(clean)
    assert sum(i in rows[1] for i in rows[0] if labels.get(i) == 0) <= 0.2 * sum(q == 0 for q in labels.values())
    first = {}
    for i, t in sorted(rows[1].items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    assert set(rows[2]) == set(first.values())
    assert set(rows[3]) == {i for i, (_, root) in brute(list(rows[2].items())).items() if i == root}
    assert set(rows[4]) == set(rows[3])
    secret = re.compile(r"[\w.+-]+@mail\d|token = \"[0-9a-f]{40}\"")
    for i, t in rows[4].items():
        if t != rows[3][i]:
            assert secret.search(rows[3][i]) or re.search(r"\d", rows[3][i])
        for found in secret.findall(rows[3][i]):
            assert found not in t
    library, want = Tokenizer.from_file(default_vocabulary()), set()
    for i, t in rows[4].items():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want |= {(i, k // 4096, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)}
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in frames[-1].collect()} == want


def test_queries_are_named():
    names = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries())
    assert names == list(range(1, 14)) and set(queries.oracle_sql()) <= set(queries.queries())


def test_stages_on_odd_rows_and_names(spark, small, docs, odd):
    """Nulls, empty and long texts, repeated rows and ids, and columns named like helper columns go through every stage."""
    frame = docs(*odd, (9, "call 555-123-4567 " * 3), (9, "call 555-123-4567 " * 3), (10, None))
    want = {"quality": None, "exact_dedup": 6, "near_dedup": None, "pii": None, "packing": None}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, frame, small), "test-odd")
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in frame.collect()}
        else:
            assert out.columns == frame.columns
            n = want[name]
            assert out.count() == n if n else out.count() <= frame.count()
    texts = [r.text for r in corpus_pipeline.pii_stage(spark, frame, small).collect()]
    assert len(texts) == frame.count() and sum(t is None for t in texts) == 2 and not any("555-123-4567" in (t or "") for t in texts)
    kept = corpus_pipeline.near_stage(spark, frame, small).collect()
    assert sum(r.text is None for r in kept) == 2 and sum(r.doc_id is None for r in kept) == 1


def test_stages_on_an_empty_table(spark, small, docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs(), small)
        assert out.count() == 0 and (name == "packing" or out.columns == docs().columns)


def test_run_deletes_what_it_no_longer_needs(spark, small):
    with job() as tables:
        result = corpus_pipeline.run(spark, small)
    assert tables.paths == {result._stored_at} and result.count() > 0
