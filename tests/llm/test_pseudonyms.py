import hashlib
import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from quillstack.llm.pseudonyms import FOUND, feistel, pseudonymised

CARD = "4111 1111 1111 1111"
KEY = "k"
CASES = {
    "call +1 (372) 555-7739, 372-555-7739": ("n_phones", 2, r"call \+1 \(\d{3}\) \d{3}-\d{4}, \d{3}-\d{3}-\d{4}"),
    f"pay {CARD} now": ("n_cards", 1, r"pay \d{4} \d{4} \d{4} \d{4} now"),
    "pay 4111111111111112 now": ("n_cards", 0, "pay 4111111111111112 now"),
    "ip 7.88.85.226!!": ("n_ips", 1, r"ip \d+\.\d+\.\d+\.\d+!!"),
    "no 999.1.1.1 or 1.2.3.4.5": ("n_ips", 0, r"no 999\.1\.1\.1 or 1\.2\.3\.4\.5"),
    "born 1999-12-31": ("n_dates", 1, r"born (19|20)\d\d-\d\d-\d\d"),
    "on 31/12/1999 and 01.02.2003": ("n_dates", 2, r"on \d\d/\d\d/\d{4} and \d\d\.\d\d\.\d{4}"),
    "not 1999-02-30": ("n_dates", 0, "not 1999-02-30"),
    "due 12/31/1999 and 05/06/2001": ("n_dates", 2, r"due (0[1-9]|1[0-2])/(1[3-9]|2\d|3[01])/\d{4} and \d\d/\d\d/\d{4}"),
    "no 45.99.1234 13/13/1999 31.02.2000 01/01/2100 30.02.1999": ("n_dates", 0, r"no 45\.99\.1234 13/13/1999 31\.02\.2000 01/01/2100 30\.02\.1999"),
    "ring +44 20 7946 0958 or (012) 345-6789": ("n_phones", 2, r"ring \+44 \d\d \d{4} \d{4} or \([01]\d\d\) \d{3}-\d{4}"),
    "ssn 123-45-6789 000-12-3456": ("n_ssns", 1, r"ssn \d{3}-\d\d-\d{4} 000-12-3456"),
    "mail ñu.b+c@mail1.example.com, x@y": ("n_emails", 1, r"mail u[0-9a-f]{16}@mail\.invalid, x@y"),
    'token = "40d78a45c418324758e099eb7cb89bc0f5fa9f62"###': ("n_secrets", 1, r'token = "[0-9a-f]{40}"###'),
}


def luhn(digits):
    each = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in each) % 10


@pytest.fixture(scope="module")
def got(spark):
    frame = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    return {r.doc_id: r for r in pseudonymised(frame, KEY).collect()}


def test_formats(got):
    for i, (text, (kind, n, shape)) in enumerate(CASES.items()):
        assert got[i][kind] == n and re.fullmatch(shape, got[i].text), (text, got[i])
        assert (got[i].text == text) == (n == 0 and kind != "n_ssns")
    assert luhn(re.sub(r"\D", "", got[1].text)) == 0


def test_equal_values_stay_linked_and_others_apart(spark):
    numbers = [f"{4000000000000000 + i * 37:016d}" for i in range(3000)]
    cards = [n for n in numbers if luhn(n) == 0]
    frame = spark.createDataFrame([(i, f"{c} x {c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]}") for i, c in enumerate(cards)], "doc_id long, text string")
    out = [r.text.split(" x ") for r in pseudonymised(frame, KEY).collect()]
    assert all(a == b.replace("-", "") and luhn(a) == 0 for a, b in out)
    assert len({a for a, _ in out}) == len(cards)
    other = {r.text.split(" x ")[0] for r in pseudonymised(frame, key="other").collect()}
    assert other != {a for a, _ in out}


def test_permutations(spark):
    rows = spark.range(0, 35).select(feistel(F.col("id"), F.lit(5), F.lit(7), "k", "t").alias("v")).collect()
    assert sorted(r.v for r in rows) == list(range(35))
    days = spark.range(0, 73_049, 61).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    out = [r.text for r in pseudonymised(days, KEY, counts=False).collect()]
    assert len(set(out)) == days.count() and all(date(1900, 1, 1) <= date.fromisoformat(d) <= date(2099, 12, 31) for d in out)


def test_odd_rows_and_columns(docs, odd, spark):
    frame = docs(*odd, (9, "9" * 100_000), (10, "a" * 100_000 + "@"), (11, "x@y.zz " * 5_000))
    got = pseudonymised(frame, KEY)
    assert got.columns[: len(frame.columns)] == frame.columns
    rows = got.collect()
    assert sorted(repr((r.doc_id, r.text)) for r in rows if r.doc_id != 11) == sorted(repr((r.doc_id, r.text)) for r in frame.collect() if r.doc_id != 11)
    assert next(r for r in rows if r.doc_id == 11).n_emails == 5_000
    assert pseudonymised(docs(), KEY).count() == 0
    clash = spark.createDataFrame([("1.2.3.4", 7)], "text string, n_ips int")
    assert pseudonymised(clash, KEY).first().n_ips == 1


BESIDE = {
    f"{CARD} 12/25": ({"cards": 1}, r"(?!4111 1111 1111 1111)\d{4} \d{4} \d{4} \d{4} 12/25"),
    "4111111111111111 123": ({"cards": 1}, r"(?!4111111111111111)\d{16} 123"),
    "2023 555-123-4567": ({"phones": 1}, r"2023 (?!555-123-4567)\d{3}-\d{3}-\d{4}"),
    "2023 123-45-6789": ({"ssns": 1}, r"2023 (?!123-45-6789)\d{3}-\d\d-\d{4}"),
    f"{CARD} 555-123-4567": ({"cards": 1, "phones": 1}, r"(?!4111)\d{4} \d{4} \d{4} \d{4} (?!555-123)\d{3}-\d{3}-\d{4}"),
    f"{CARD} 5500 0000 0000 0004": ({"cards": 2}, r"(?!4111 1111)\d{4}( \d{4}){3} (?!5500 0000)\d{4}( \d{4}){3}"),
    f"{CARD}-123-45-6789": ({"cards": 1, "ssns": 1}, r"(?!4111 1111)\d{4}( \d{4}){3}-(?!123-45)\d{3}-\d\d-\d{4}"),
    "12345678901 10.20.30.40": ({"ips": 1}, r"12345678901 (?!10\.20\.30\.40)\d+\.\d+\.\d+\.\d+"),
    "1234567890123 555.123.4567": ({"phones": 1}, r"1234567890123 (?!555\.123)\d{3}\.\d{3}\.\d{4}"),
    "12345678901 31/12/1999": ({"dates": 1}, r"12345678901 (?!31/12/1999)\d\d/\d\d/\d{4}"),
    "12345 1999-12-31 77": ({"dates": 1}, r"12345 (?!1999-12-31)\d{4}-\d\d-\d\d 77"),
    "1234567890 123": ({}, "1234567890 123"),
    "(" + "7" * 40 + ")": ({}, r"\(7{40}\)"),
    "1 " * 12 + "1": ({}, "(1 ){12}1"),
}


def test_numbers_beside_each_other(spark):
    frame = spark.createDataFrame(list(enumerate(BESIDE)), "doc_id long, text string")
    out = {r.doc_id: r for r in pseudonymised(frame, KEY).collect()}
    for i, (text, (counts, shape)) in enumerate(BESIDE.items()):
        got = {k: out[i][f"n_{k}"] for k in FOUND if out[i][f"n_{k}"]}
        assert got == counts and re.fullmatch(shape, out[i].text), (text, out[i])


def test_long_runs(spark):
    text = "1 2 3 45 " * 5_000
    got = pseudonymised(spark.createDataFrame([(1, text.strip() + f"  {CARD}")], "doc_id long, text string"), KEY).first()
    assert got.n_cards >= 1 and len(got.text) == len(text.strip()) + 2 + len(CARD) and not got.text.endswith(CARD)


# brute force: the same permutations in plain Python


def drawn(what, i, half, modulus):
    return int(hashlib.sha256(f"{KEY}|{what}|{i}|{half}".encode()).hexdigest()[:15], 16) % modulus


def permuted(index, a, b, what):
    l, r = divmod(index, b)  # noqa: E741
    for i in range(10):
        if i % 2 == 0:
            l = (l + drawn(what, i, r, a)) % a  # noqa: E741
        else:
            r = (r + drawn(what, i, l, b)) % b
    return l * b + r


def halves(digits, what, front):
    """The digits permuted, ``front`` of them in the first half."""
    rest = len(digits) - front
    return f"{permuted(int(digits), 10**front, 10**rest, what):0{len(digits)}d}"


def card(t):
    d = re.sub(r"\D", "", t)
    body = halves(d[:-1], "card", len(d) - 1 - len(d) // 2)
    return shaped(t, body + next(c for c in "0123456789" if luhn(body + c) == 0))


def phone(t):
    d = re.sub(r"\D", "", t)
    if t.startswith("+") and not t.startswith("+1"):
        return shaped(t, d[:2] + halves(d[2:], "phone abroad", len(d) - 2 - (len(d) - 2) // 2))
    area, exchange, line = int(d[-10:-7]), int(d[-7:-4]), int(d[-4:])
    what, a, b, fa, fe, n = ("phone area", 40_000, 50_000, 0, 0, 1000) if area < 200 else ("phone exchange", 40_000, 40_000, 200, 0, 200) if exchange < 200 else ("phone", 80_000, 80_000, 200, 200, 800)
    v = permuted(((area - fa) * n + exchange - fe) * 10_000 + line, a, b, what)
    return shaped(t, d[:-10] + f"{v // (n * 10_000) + fa:03d}{v // 10_000 % n + fe:03d}{v % 10_000:04d}")


def ip(t):
    v = permuted(int.from_bytes(bytes(map(int, t.split("."))), "big"), 65_536, 65_536, "ip")
    return ".".join(map(str, v.to_bytes(4, "big")))


def ssn(t):
    areas = [x for x in range(1, 900) if x != 666]
    a, g, n = map(int, t.split("-"))
    v = permuted((areas.index(a) * 99 + g - 1) * 9999 + n - 1, 898 * 99, 9999, "ssn")
    return f"{areas[v // (9999 * 99)]:03d}-{v // 9999 % 99 + 1:02d}-{v % 9999 + 1:04d}"


DAYS = [date(1900, 1, 1) + timedelta(i) for i in range(73_049)]
LATE = {
    "late day": (192, 200, [d for d in DAYS if 13 <= d.day <= 28]),
    "month end": (22, 200, [d for d in DAYS if d.day in (29, 30) and d.month != 2]),
    "31st": (7, 200, [d for d in DAYS if d.day == 31]),
    "leap day": (7, 7, [d for d in DAYS if (d.month, d.day) == (2, 29)]),
}


def any_day(d):
    n = (d - DAYS[0]).days
    return DAYS[permuted(n, 365, 200, "date") if n < 73_000 else 73_000 + permuted(n - 73_000, 7, 7, "last days")]


def american(d):
    what, (a, b, days) = next((k, v) for k, v in LATE.items() if d in v[2])
    return days[permuted(days.index(d), a, b, what)]


def shaped(t, digits):
    left = iter(digits)
    return re.sub(r"\d", lambda _: next(left), t)


def valid_cards(rng):
    d = "".join(rng.choices("0123456789", k=rng.randint(12, 18)))
    return d + next(c for c in "0123456789" if luhn(d + c) == 0)


def planted(rng):
    """(a value, its pseudonym) of a random kind."""
    n = lambda k: "".join(rng.choices("0123456789", k=k))
    kind = rng.choice(("card", "phone", "abroad", "ip", "ssn", "iso", "slashed", "american", "mail"))
    if kind == "card":
        t = valid_cards(rng)
        return t, card(t)
    if kind == "phone":
        t = rng.choice((f"({n(3)}) {n(3)}-{n(4)}", f"+1 {n(3)}.{n(3)}.{n(4)}", f"{n(3)}-{n(3)}-{n(4)}"))
        return t, phone(t)
    if kind == "abroad":
        t = f"+{rng.randint(2, 9)}{n(1)} {n(3)} {n(rng.randint(3, 6))}"
        return t, phone(t)
    if kind == "ip":
        t = ".".join(str(rng.randint(0, 255)) for _ in range(4))
        return t, ip(t)
    if kind == "ssn":
        t = f"{rng.choice([x for x in range(1, 900) if x != 666]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
        return t, ssn(t)
    if kind == "mail":
        t = f"Ab.{n(3)}@mail{n(2)}.example"
        return t, f"u{hashlib.sha256(f'{KEY}|email|{t.lower()}'.encode()).hexdigest()[:16]}@mail.invalid"
    d = rng.choice(DAYS)
    if kind == "iso":
        return d.isoformat(), any_day(d).isoformat()
    if kind == "slashed":
        form = rng.choice(("%d/%m/%Y", "%d.%m.%Y"))
        return d.strftime(form), any_day(d).strftime(form)
    d = rng.choice([x for v in LATE.values() for x in v[2][:: max(1, len(v[2]) // 49)]])
    return d.strftime("%m/%d/%Y"), american(d).strftime("%m/%d/%Y")


def test_brute_force_and_text_around(spark):
    """Values are what plain Python makes of them, and everything else stays as it is."""
    rng = random.Random(5)
    plain = ["word", "x.y", "45.99.1234", "12:30", "§ 7", "31/02/1999", "a/b", "1,000.50", "999.1.1.1", "ñ é", "\n", "666-12-3456", "12345"]
    rows, want = [], {}
    for i in range(400):
        parts = [(w := rng.choice(plain), w) if rng.random() < 0.5 else planted(rng) for _ in range(rng.randint(1, 7))]
        sign = rng.choice((" word ", "; ", " | ", ", x "))
        rows.append((i, sign.join(a for a, _ in parts)))
        want[i] = sign.join(b for _, b in parts)
    got = {r.doc_id: r.text for r in pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), KEY, counts=False).collect()}
    wrong = [(rows[i][1], got[i], want[i]) for i in want if got[i] != want[i]]
    assert not wrong, wrong[:3]


def test_month_first_dates_keep_apart(spark):
    days = [d for what in ("month end", "31st", "leap day") for d in LATE[what][2]]
    rows = [(i, d.strftime("%m/%d/%Y")) for i, d in enumerate(days)]
    out = [r.text for r in pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), KEY, counts=False).collect()]
    assert len(set(out)) == len(days) and all(int(t[3:5]) > 28 for t in out)


def test_key_is_needed_and_names_may_clash(spark):
    frame = spark.createDataFrame([("1.2.3.4", "f", "p", "m", "t")], "text string, found string, parts string, made string, fresh string")
    with pytest.raises(ValueError):
        pseudonymised(frame, "")
    row = pseudonymised(frame, KEY).first()
    assert (row.found, row.parts, row.made, row.fresh) == ("f", "p", "m", "t") and row.text == ip("1.2.3.4")
