import hashlib
import re
from collections import defaultdict

import pytest

from quillstack.llm.exact_dedup import deduplicated, exact_groups


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, seen = (min(known) if known else None), False
        for i in ids:
            stays = i == keep and not seen
            seen |= stays
            out.append((i, keep, len(ids), stays, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(map(repr, out))


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (1, None), (2, ""), (4, "x" * 300 + "1"), (6, "x" * 300 + "2"), (8, "x" * 300 + "1"), (7, "u"), (7, "u"), (7, "v"), (None, "a b"), (None, "z")]


@pytest.mark.parametrize("all_digests", [True, False])
def test_groups(docs, all_digests):
    got = exact_groups(docs(*ROWS), all_digests=all_digests).collect()
    want = brute(ROWS)
    if all_digests:
        assert sorted(repr(tuple(r)) for r in got) == want
    else:
        assert sorted(repr(tuple(r)[:4]) for r in got) == sorted(repr(eval(w)[:4]) for w in want)
        assert all(r.text_sha256 for r in got if r.group_size > 1)


def test_odd_and_empty(docs, odd):
    assert sorted(repr(tuple(r)) for r in exact_groups(docs(*odd)).collect()) == brute(odd)
    assert exact_groups(docs()).count() == 0


def test_deduplicated_keeps_columns(docs):
    frame = docs(*ROWS)
    got = deduplicated(frame)
    assert got.columns == frame.columns
    assert sorted(repr((r.doc_id, r.text)) for r in got.collect()) == sorted(map(repr, [(3, "a\tb"), (1, None), (4, "x" * 300 + "1"), (6, "x" * 300 + "2"), (7, "u"), (7, "v"), (None, "z")]))
    assert deduplicated(docs()).count() == 0
