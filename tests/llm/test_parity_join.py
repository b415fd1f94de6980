import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quillstack.llm import parity_join
from quillstack.llm.common import table
from quillstack.llm.parity_join import components, near_duplicates, representatives, shingles, signature_lists, signatures, sketches


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute(rows):
    sets = sets_of(rows)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def brute_rows(rows):
    """(id, size, component) of each row, ids repeated or null: sets of rows with an id are the nodes."""
    shingled = [frozenset(next(iter(sets_of([(0, t)]).values()))) for _, t in rows]
    least = {}
    for (i, _), s in zip(rows, shingled, strict=True):
        if s and i is not None:
            least[s] = min(i, least.get(s, i))
    sets = list(least)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = {}
    for k, s in enumerate(sets):
        for w in s:
            held.setdefault(w, []).append(k)
    for x, y in {(x, y) for own in held.values() for x in own for y in own if x < y}:
        both = len(sets[x] & sets[y])
        if 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
            root[max(find(x), find(y))] = min(find(x), find(y))
    groups = {}
    for k, s in enumerate(sets):
        groups[find(k)] = min(least[s], groups.get(find(k), least[s]))
    component = {s: groups[find(k)] for k, s in enumerate(sets)}
    return sorted((repr((i, len(s), component.get(s, i))) for (i, _), s in zip(rows, shingled, strict=True)))


def grouped(frame, **k):
    return sorted(repr(tuple(r)) for r in near_duplicates(frame, **k).collect())


def near_copies(seed):
    """Groups of edited copies of all lengths, chains, shared passages and words in common."""
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(400)]
    passage = rng.choices(words, k=60)
    rows, i = [], 0
    for size in [1, 3, 5, 6, 8, 9, 11, 13, 15, 20, 30, 45, 80, 150, 400] * 2:
        base = rng.choices(words, k=size)
        if size > 100:
            base[10:10] = passage
        text = list(base)
        for _ in range(6):
            rows.append((i, " ".join(text)))
            i += rng.randint(1, 3)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                k = rng.randrange(len(text))
                text[k : k + 1] = rng.choice([[], ["new"], [text[k], "x"]]) or ([] if len(text) > 1 else ["y"])
    rows += [(i + 1, None), (i + 2, ""), (i + 3, " \n"), (i + 4, rows[0][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(docs, seed):
    rows = near_copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(*rows)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("crowd", [3, 12])
def test_crowds_against_brute_force(docs, crowd):
    """Groups that hold a passage of half their words, with copies among them, and hardly any limit for a group."""
    rng = random.Random(crowd)
    words = [f"w{i}" for i in range(5_000)]
    rows, i = [], 0
    for size, share in ((120, 0.3), (120, 0.5), (40, 0.6), (300, 0.7), (9, 0.5)):
        passage = rng.choices(words, k=int(size * share))
        for _ in range(16):
            own = rng.choices(words, k=size - len(passage))
            at = rng.randrange(len(own) + 1)
            text = own[:at] + passage + own[at:]
            for _ in range(rng.choice((1, 1, 2, 3))):
                rows.append((i, " ".join(text)))
                i += 1
                text = list(text)
                text[rng.randrange(len(text))] = "edit"
    rows += near_copies(3)[:40]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(*rows), crowd=crowd).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("share", [0.3, 0.75])
def test_pairs_of_a_passage_grow_with_the_input(docs, monkeypatch, share):
    """Texts that share a passage, fewer than a crowd, and one pair of near copies: twice as many take no more than about twice the pairs."""
    stored = parity_join.stored

    def counted(frame, what):
        out = stored(frame, what)
        if what == "join-apart":
            sizes = out.groupBy([c for c in ("step", "sig") if c in out.columns]).count().collect()
            compared.append(sum(r["count"] * (r["count"] - 1) // 2 for r in sizes))
        return out

    monkeypatch.setattr(parity_join, "stored", counted)
    compared = []
    for n in (100, 200, 400):
        rng = random.Random(n)
        words = [f"w{i}" for i in range(20_000)]
        passage = rng.choices(words, k=int(240 * share))
        rows = [(i, " ".join(rng.choices(words, k=240 - len(passage)) + passage)) for i in range(n)]
        rows.append((n, rows[7][1].replace(passage[-20], "edit")))
        got = {r.doc_id: r.component_id for r in near_duplicates(docs(*rows)).collect()}
        assert got == {i: i for i in range(n)} | {n: 7}
    few, more, most = compared
    assert most <= 2.5 * max(more, 2_000) and more <= 2.5 * max(few, 1_000), compared


@pytest.mark.parametrize("times, crowd", [(1, 20), (2, 3), (6, 20), (20, 3)])
def test_crowds_of_repeated_rows(docs, times, crowd):
    """Pairs with a few words of their own beside a passage, each row several times: no link is lost."""
    rng = random.Random(times)
    passage = [f"p{i}" for i in range(78)]
    rows = []
    for pair in range(60):
        shared = [f"s{pair}x{i}" for i in range(6)]
        for one in range(2):
            own = [f"o{pair}y{one}z{i}" for i in range(8)]
            rows.append((2 * pair + one, " ".join(own + shared + passage if pair % 2 else own + passage + shared)))
    rows = [r for r in rows for _ in range(times)]
    rng.shuffle(rows)
    got = grouped(docs(*rows), crowd=crowd)
    assert got == brute_rows(rows)
    assert len({eval(r)[2] for r in got}) == 60


@pytest.mark.parametrize("crowd", [3, 512])
def test_repeated_and_clashing_ids(docs, crowd):
    rng = random.Random(crowd)
    rows = near_copies(5)[:90]
    rows = [(i % 25 if i % 4 else i, t) for i, t in rows] + [(None, rows[3][1]), (None, "an own text without an id")]
    rows = [r for r in rows for _ in range(rng.choice((1, 1, 3)))]
    assert grouped(docs(*rows), crowd=crowd) == brute_rows(rows)


def test_representatives_of_clashing_ids(docs):
    a = "the quick brown fox jumps over the lazy dog and runs away from it all the same today"
    own = "something else entirely that nobody has written in any other of these rows"
    got = sorted(tuple(r)[:2] for r in representatives(docs((1, a), (2, a + " yes"), (2, own))).collect())
    assert got == [(1, a), (2, own)]
    # one row of a group stays, even where its id stands on several of the group, or the row itself repeats
    got = [tuple(r)[:2] for r in representatives(docs((4, a), (4, a + " yes"), (4, a), (7, a), (4, own), (4, own))).collect()]
    assert sorted(got) in ([(4, own), (4, a)], [(4, own), (4, a + " yes")])


def test_tables_of_a_job_are_its_own(spark, docs):
    from quillstack.llm.common import job, stored

    frame = docs((1, "a"))
    outside = stored(frame, "outside")
    with job() as tables:
        inside = stored(frame, "inside")
        with job() as inner:
            within = stored(frame, "within")
            assert inner.paths == {within._stored_at}
        tables.forget(spark, inside)
        assert tables.paths == {inside._stored_at}
    assert outside.count() == inside.count() == 1
    with pytest.raises(Exception, match="within"):
        within.count()


def test_any_order_of_signatures_keeps_similar_sets_together():
    """Whatever is put last, the first needed ones of two similar sets have one in common."""
    rng = np.random.default_rng(4)
    for n in [*range(4, 60, 3), 200, 900]:
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        b = np.sort(rng.permutation(a)[: len(a) - len(a) // 5])
        owner, kind, rank, need, sig = signature_lists(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        last = set(sig[rng.random(len(sig)) < 0.6].tolist())
        first = [set(), set()]
        for o in (0, 1):
            for k in np.unique(kind[owner == o]):
                own = np.flatnonzero((owner == o) & (kind == k))
                turn = sorted(own, key=lambda i: (sig[i] in last, rank[i]))
                first[o] |= {sig[i] for i in turn[: need[own[0]]]}
        assert first[0] & first[1] or len(a) == len(b)


def test_small_table_against_brute_force(spark, small):
    frame = table(spark, small, "documents")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame).collect()}
    assert got == brute([(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()])


def test_similar_sets_share_a_signature():
    """No pair at 0.8 or more is without a common signature, whatever the sizes; equal sets are classes already."""
    rng = np.random.default_rng(3)
    for n in [*range(4, 60), 100, 333, 1000]:
        for _ in range(4):
            a = np.unique(rng.integers(0, 2**64, n, np.uint64))
            drop = rng.integers(0, len(a) // 5 + 1)
            add = rng.integers(0, max(1, int((len(a) - drop) / 0.8 - len(a)) + 1))
            b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 2**64, add, np.uint64))))
            both = len(np.intersect1d(a, b))
            if 5 * both < 4 * (len(a) + len(b) - both) or len(a) == len(b) == both:
                continue
            h, bounds = np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)])
            sig, at = signatures(h, bounds)
            assert len(np.intersect1d(sig[: at[1]], sig[at[1] :])), (n, len(a), len(b), both)
            short, _, _ = sketches(h, bounds)
            assert sum(int(x).bit_count() for x in (short[0] ^ short[1]).view(np.uint64)) <= len(a) + len(b) - 2 * both


def test_brief_shingles_keep_similar_sets_together():
    """In any order of shingles the brief ones of the set that isn't larger meet the needed ones of the other."""
    rng = np.random.default_rng(6)
    for n in [*range(1, 60), 200, 900]:
        for larger in (n, n + n // 8, n * 5 // 4):
            b = np.unique(rng.integers(0, 2**64, larger, np.uint64))
            both = max(-(-4 * (n + larger) // 9), 1)
            a = np.unique(np.concatenate((rng.permutation(b)[:both], rng.integers(0, 2**64, n - both, np.uint64))))
            owner, _, _, need, brief, sig = parity_join.shingle_lists(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
            for last in (set(sig[np.isin(np.concatenate((a, b)), a) & np.isin(np.concatenate((a, b)), b)].tolist()), set(sig[rng.random(len(sig)) < 0.6].tolist())):
                first = []
                for o, most in ((0, brief), (1, need)):
                    own = sorted(np.flatnonzero(owner == o), key=lambda i: (sig[i] in last, sig[i]))
                    first.append({sig[i] for i in own[: most[own[0]]]})
                assert first[0] & first[1], (n, larger)


def test_crowded_blocks_fall_back():
    """Sets whose hashes all fall into one block still share a signature."""
    low = np.arange(1, 41, dtype=np.uint64)
    a, b = low[:36], low[1:38]
    sig, at = signatures(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
    assert len(np.intersect1d(sig[: at[1]], sig[at[1] :]))


def test_shingles_of_any_part():
    texts = pa.array(["A b C d e f", None, "x", "", "a B c D E F", "p q r s t p q r s t p q r s t"])
    h, at = shingles(texts)
    assert np.diff(at).tolist() == [2, 0, 1, 0, 2, 5]
    assert (h[at[0] : at[1]] == h[at[4] : at[5]]).all()


def test_odd_rows_and_components(spark, docs, odd):
    got = near_duplicates(docs(*odd)).collect()
    assert len(got) == len(odd) and {(r.doc_id, r.n_shingles) for r in got} >= {(1, 0), (2, 0), (3, 0), (4, 1), (7, 1)}
    assert all(r.component_id == (4 if r.doc_id is None else r.doc_id) for r in got)
    assert near_duplicates(docs()).count() == 0
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 90), (90, 100), (7, 7)], "a long, b long")
    assert {(r.node, r.root) for r in components(edges).collect() if r.node != r.root} == {(i, 0) for i in range(1, 51)} | {(100, 90)}
    frame = docs((9, "a b c d e f g h i j k"), (3, "a b c d e f g h i j k"), (5, "other words here"), (None, "no id"))
    assert sorted((r.doc_id or 0, r.text) for r in representatives(frame).collect()) == [(0, "no id"), (3, "a b c d e f g h i j k"), (5, "other words here")]
