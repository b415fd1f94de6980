import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstack.llm.license_scan import TEMPLATES, Scanner, license_finds, license_report, patience


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=20), st.lists(st.integers(0, 5), max_size=12))
def test_alignment_is_common_and_rising(text, template):
    got = patience(text, template)
    assert all(text[i] == template[j] for i, j in got)
    assert all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:], strict=False))


def test_alignment_crosses_gaps():
    template = "permission is granted to use copy and sell the software".split()
    text = "well permission is hereby granted to all to use and copy and sell copies of the software now".split()
    assert len(patience(text, template)) == len(template)
    assert patience(list("abcxdef"), list("abcdef")) == [(0, 0), (1, 1), (2, 2), (4, 3), (5, 4), (6, 5)]


def scan(text, coverage=0.8):
    return {(name, first, last, round(share, 2)) for _, name, first, last, share in Scanner(TEMPLATES, coverage).scan(pa.array([text]))}


def test_finds():
    assert scan("some words. Released under the MIT License. more") == {("MIT notice", 2, 7, 1.0)}
    assert ("Apache-2.0 notice", 1, 8, 1.0) in scan("x LICENSED under THE Apache*** License,$$$ version 2.0.!! y")
    twice = scan("Released under the MIT License. Released under the MIT License.")
    assert {x[1:3] for x in twice} == {(0, 5), (5, 10)}
    assert scan("the license of the under was released to mit") == set()
    mit = TEMPLATES["MIT"].split()
    changed = [w for i, w in enumerate(mit) if i % 11]
    changed[30:30] = "an inserted run of words".split()
    assert {x[0] for x in scan(" ".join(["before"] * 40 + changed + ["after"] * 40))} == {"MIT"}
    assert {x[0] for x in scan(" ".join(mit[: len(mit) // 2]))} == set()


def test_tables(docs, odd):
    rows = [*odd, (20, "Licensed under CC BY-NC 4.0."), (20, "Licensed under CC BY-NC 4.0."), (21, "word " * 30_000 + "Released under the MIT License.")]
    got = license_report(docs(*rows)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_finds, r.licenses, r.coverage) for r in got if r.n_finds} == {(20, 1, "CC-BY-NC-4.0 notice", 1.0), (21, 1, "MIT notice", 1.0)}
    assert sorted((r.doc_id, r.first_word, r.last_word) for r in license_finds(docs(*rows)).collect()) == [(20, 0, 5), (20, 0, 5), (21, 30_000, 30_005)]
    assert license_report(docs()).count() == 0


def test_planted_notices(spark, small):
    from quillstack.llm.common import table

    frame = table(spark, small, "documents")
    want = {r.doc_id for r in frame.filter("text like '%Released under the MIT License.%' or text like '%Licensed under the Apache License, Version 2.0.%' or text like '%Licensed under CC BY-NC 4.0.%' or text like '%This work is licensed under the GNU General Public License, version 3.%'").collect()}
    got = {r.doc_id for r in license_report(frame).filter("n_finds > 0").collect()}
    assert want <= got and len(got) <= len(want) + 2


def test_neighbouring_licences():
    names = lambda text: {x[0] for x in scan(f"some words before. {text} and words behind")}
    assert names("Licensed under CC BY-SA 4.0.") == {"CC-BY-SA-4.0 notice"}
    assert names("Licensed under CC BY-ND 4.0.") == {"CC-BY-ND-4.0 notice"}
    assert names("Licensed under CC BY-NC 4.0.") == {"CC-BY-NC-4.0 notice"}
    for other in ("Licensed under CC BY-NC 3.0.", "Licensed under CC BY-NC-SA 4.0.", "Released under the BSD License.", "Released under the MIT No Attribution License.", "Licensed under the GNU License, Version 2.0.", "Licensed under the Apache License, Version 1.1.", "This work is licensed under the GNU General Public License, version 2.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License.", TEMPLATES["MPL-2.0"].replace("v. 2.0", "v. 1.1"), TEMPLATES["GPL-3.0"].replace("version 3", "version 2")):
        assert names(other) == set(), other
    lesser = "This work is licensed under the GNU Lesser General Public License, version 3."
    assert names(lesser) == {"LGPL-3.0 notice"} and names(lesser.replace("Lesser", "Affero")) == {"AGPL-3.0 notice"}
    for text in ("This work is licensed under the GNU General Public License (GPL), version 3.0.", "This work is licenced under the GNU General Public License, version 3."):
        assert names(text) == {"GPL-3.0 notice"}
    assert names(TEMPLATES["GPL-3.0"].replace("General", "Affero General")) == {"AGPL-3.0"}
    assert names(TEMPLATES["BSD-3-Clause"]) == {"BSD-3-Clause"} and names(TEMPLATES["BSD-2-Clause"]) == {"BSD-2-Clause"}
    assert all(name in names(text) for name, text in TEMPLATES.items())


def test_comments_and_insertions():
    lines = TEMPLATES["BSD-2-Clause"].split(". ")
    for mark in ("//", " *", "#", "dnl", "REM", "--"):
        text = "\n".join(f"{mark} {line}." for line in lines)
        assert {(x[0], x[3]) for x in scan(text)} == {("BSD-2-Clause", 1.0)}, mark
    words = TEMPLATES["ISC"].split()
    wide = [x for w in words for x in (w, "and", "more")]
    assert {x[0] for x in scan(" ".join(wide))} == set()
    got = Scanner({"ISC": TEMPLATES["ISC"]}, 0.8, spread=4.0).scan(pa.array([" ".join(wide)]))
    assert [(name, share) for _, name, _, _, share in got] == [("ISC", 1.0)]


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(row[j] + 1 if x == y else max(row[j + 1], now[j]))
        row = now
    return row[-1]


@settings(max_examples=100, deadline=None)
@given(st.permutations(range(9)), st.lists(st.integers(20, 30), max_size=4), st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=9))
def test_coverage_against_common_subsequences(order, strange, text, template):
    """The longest one where all words are unique; never more than the longest one."""
    unique = [*order[:5], *dict.fromkeys(strange), *order[5:]]
    assert len(patience(unique, list(range(9)))) == common(unique, list(range(9)))
    assert len(patience(text, template)) <= common(text, template)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefxyz"), max_size=40), min_size=1, max_size=3))
def test_scan_against_all_stretches(texts):
    """Aligning the stretch from every word of every text finds nothing that the scan has not, and the other way round."""
    template, coverage = "a b c d e f", 0.6
    got = Scanner({"t": template}, coverage).scan(pa.array([" ".join(t) for t in texts]))
    want = []
    for k, t in enumerate(texts):
        found = []
        for start in range(len(t)):
            match = patience(t[start : start + 12], template.split())
            if t[start] in template.split() and len(match) >= 0.6 * 6 - 1e-9:
                a, b = start + match[0][0], start + match[-1][0] + 1
                found.append((-len(match) / 6, b - a, a, b))
        taken = []
        for share, _, a, b in sorted(set(found)):
            if all(b <= c or d <= a for c, d in taken):
                taken.append((a, b))
                want.append((k, "t", a, b, -share))
    assert sorted(got) == sorted(want)
