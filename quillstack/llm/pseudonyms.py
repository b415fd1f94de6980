"""Format-preserving pseudonyms for personal data, in DataFrame expressions only.

Numbers and dates found in a text are checked (Luhn digit, octets, areas, calendar) and then
permuted within their format by a keyed Feistel network over the two halves of their index,
so that equal values stay equal across documents, different ones stay different, and the
result passes the same check:

* card numbers of 13 to 19 digits with a right Luhn digit; separators and length stay; in a run of
  groups of digits each group may start one, the longest valid, unless it would cut a telephone
  number, social security number or date in two;
* telephone numbers in North American form, written with parentheses or separators, those that
  can be dialled and those that can't each among themselves; others with a plus and 8 to 14 digits;
* social security numbers; IPv4 addresses; calendar dates from 1900 to 2099, in ISO form, or
  slashed or dotted, day first, or month first where the day-first reading is no date;
* e-mail addresses and quoted or assigned secrets of hexadecimal digits have no numeric
  format; they become keyed digests in the same shape.

A number that fails its check stays as it is, and what it holds or touches is looked at on its
own.  Where two valid card numbers of a run overlap by chance, the first is taken.  A text without a finding comes back
unchanged.  Work is one pass per row: no shuffle, and a hot source or a long text is only its
own length of work.

Edge cases: a null text stays null with no findings; an empty one stays empty; an empty table
gives an empty result; other columns go through unchanged, whatever their names, but for one with the
name of a count, which the count replaces; repeated rows give equal rows.  IPv6 addresses, account
numbers of banks and names of people have no pattern here and stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names

ROUNDS = 10
PIECE = 200  # groups of a long run of digits that are handled together
FOUND = {
    "emails": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "secrets": r"(?<=[\"'=:\s])[0-9a-fA-F]{32,64}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])AKIA[0-9A-Z]{16}(?![\p{L}\p{N}])",
    "ips": r"(?<![\p{N}.])\d{1,3}(?:\.\d{1,3}){3}(?![\p{N}]|\.\d)",
    "dates": r"(?<![\p{N}/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\p{N}/-])",
    "ssns": r"(?<![\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{N}]|-\d)",
    "phones": r"(?<![\p{N}+])\+[2-9]\d(?:[ .-]?\d){6,12}(?![\p{N}])|(?<![\p{N}+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\p{N}])",
    "cards": r"(?<![\p{N}])(?!\d{20})(?=\d(?:[ -]?\d){12})\d[\d -]*(?<=\d" + r"[ -]?\d" * 12 + r")(?![\p{N}])"
    # a run of groups ends before an address, date or telephone number that goes on with dots or slashes
    r"(?!(?<=(?<!\d)\d{1,3})(?:\.\d{1,3}){3}(?![\p{N}]|\.\d))"
    r"(?!(?<=(?<!\d)\d{2})(?:/\d{2}/|\.\d{2}\.)\d{4}(?![\p{N}/-]))"
    r"(?!(?<=(?<!\d)\d{3})(?:\.\d{3}[ .-]|[ -]\d{3}\.)\d{4}(?![\p{N}]))"
    r"(?!(?<=(?<!\d)\d{3}[ -]\d{3})\.\d{4}(?![\p{N}]))",
}
ANY = "|".join(FOUND.values())
CARD = r"^\d(?:[ -]?\d){12,18}$"
_OTHERS = (
    r"(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\p{N}-])|(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?!\p{N}|-\d)",
    r"(?:1[ -]?)?\d{3}[ -]\d{3}[ -]\d{4}(?!\p{N})",
)


def _draw(key: str, what: str, i: Column, half: Column, modulus: Column) -> Column:
    text = F.concat_ws("|", F.lit(key), F.lit(what), i.cast("string"), half.cast("string"))
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long"), modulus)


def feistel(index: Column, a: Column, b: Column, key: str, what: str) -> Column:
    """A keyed permutation of 0 .. a*b - 1: ten rounds, each adding a keyed draw from one half to the other."""
    start = F.struct(F.floor(index / b).cast("long").alias("l"), F.pmod(index, b).cast("long").alias("r"), a.cast("long").alias("a"), b.cast("long").alias("b"))
    return _feistel(start, key, what)


def _feistel(start: Column, key: str, what: str) -> Column:
    def step(s: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        left = F.when(even, F.pmod(s["l"] + _draw(key, what, i, s["r"], s["a"]), s["a"])).otherwise(s["l"])
        right = F.when(even, s["r"]).otherwise(F.pmod(s["r"] + _draw(key, what, i, s["l"], s["b"]), s["b"]))
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"), s["a"].alias("a"), s["b"].alias("b"))

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step, lambda s: s["l"] * s["b"] + s["r"])


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _reshaped(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced by others, one by one."""
    parts = F.split(F.regexp_replace(shape, r"\d", "0\u0001"), "\u0001")
    last = F.size(parts)
    filled = F.transform(parts, lambda p, i: F.when(i + 1 < last, F.concat(F.regexp_replace(p, "0$", ""), F.substring(digits, i + 1, F.lit(1)))).otherwise(p))
    return F.array_join(filled, "")


def _luhn(digits: Column, with_check: bool) -> Column:
    """The Luhn sum of a string of digits; without its check digit, the sum as if a 0 followed."""
    each = F.transform(F.split(F.reverse(digits), "(?!$)"), lambda c, i: _let(c.cast("int") * F.when(F.pmod(i + (0 if with_check else 1), F.lit(2)) == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(each, F.lit(0), lambda a, v: a + v)


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _card(m: Column, key: str) -> Column:
    def permuted(d: Column) -> Column:
        size = F.length(d)
        body = F.substring(d, F.lit(1), size - 1)
        half = F.floor(size / 2).cast("int")
        start = F.struct(F.substring(body, F.lit(1), size - 1 - half).cast("long").alias("l"), F.substring(body, size - half, half).cast("long").alias("r"), _power(size - 1 - half).alias("a"), _power(half).alias("b"))
        fresh = F.lpad(_feistel(start, key, "card").cast("string"), size - 1, "0")
        checked = _let(fresh, lambda x: F.concat(x, F.pmod(10 - F.pmod(_luhn(x, False), F.lit(10)), F.lit(10)).cast("string")))
        return F.when((size >= 13) & (size <= 19) & (F.pmod(_luhn(d, True), F.lit(10)) == 0), _reshaped(m, checked))

    return _let(_digits(m), permuted)


def _in_run(run: Column) -> Column:
    """array<struct(plain, t)>: a run of groups of digits cut into numbers to replace and what lies between."""
    count = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"(\d+)"), 0))

    def joined(parts: Column, start: Column, n: Column | int) -> Column:
        return F.array_join(F.slice(parts, start + 1, n), "")

    def other(parts: Column, i: Column, after_dash: bool) -> Column:
        """Groups of the date, social security or telephone number that starts with group i, or 0."""
        pattern = rf"^{'[ -]*' if after_dash else ' *'}(?:{_OTHERS[0]})|^[ -]*(?:{_OTHERS[1]})"
        return count(F.regexp_extract(joined(parts, i, 5), pattern, 0))

    def card(parts: Column, sizes: Column, others: Column, i: Column) -> Column:
        """Groups of the longest card number that starts with group i, or 0."""
        def valid(n: Column) -> Column:
            whole = F.forall(F.transform(F.slice(others, i + 1, n), lambda o, k: (k == 0) | (k + o <= n)), lambda x: x)
            return _let(F.regexp_replace(joined(parts, i, n), r"^[ -]+", ""), lambda t: F.when(t.rlike(CARD), (F.pmod(_luhn(_digits(t), True), F.lit(10)) == 0) & whole).otherwise(False))

        # only so many groups as have 13 to 19 digits together are looked at
        none = F.struct(F.lit(0).alias("digits"), F.lit(0).alias("low"), F.lit(0).alias("high"))
        ends = F.aggregate(F.slice(sizes, i + 1, 19), none, lambda a, n: _let(a["digits"] + n, lambda d: F.struct(d.alias("digits"), (a["low"] + (d < 13).cast("int")).alias("low"), (a["high"] + (d <= 19).cast("int")).alias("high"))))
        wanted = lambda e: F.when(e["high"] > e["low"], F.sequence(e["low"] + 1, e["high"])).otherwise(F.array().cast("array<int>"))
        return F.coalesce(F.array_max(F.filter(_let(ends, wanted), valid)), F.lit(0))

    def taken(steps: Column) -> Column:
        """The numbers to replace, from left to right. Those of a piece of the run are appended to a list of the
        piece's own, and the lists to one of lists, as appending copies: a run costs in proportion to its length."""
        kind = "array<struct<i:int,n:int>>"
        none = lambda at: F.struct(at.alias("at"), F.array().cast(kind).alias("out"))

        def step(acc: Column, s: Column) -> Column:
            n = F.when(s["i"] < acc["at"], 0).when((s["i"] == acc["at"]) & (s["i"] > 0), s["behind"]).otherwise(s["n"])
            return _let(n, lambda n: F.when(n > 0, F.struct((s["i"] + n).alias("at"), F.concat(acc["out"], F.array(F.struct(s["i"].alias("i"), n.alias("n")))).alias("out"))).otherwise(acc))

        def piece(acc: Column, first: Column) -> Column:
            own = F.aggregate(F.slice(steps, first, PIECE), none(acc["at"]), step)
            return _let(own, lambda o: F.struct(o["at"].alias("at"), F.concat(acc["out"], F.array(o["out"])).alias("out")))

        pieces = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.size(steps), F.lit(PIECE)), pieces, piece, lambda acc: F.flatten(acc["out"]))

    def cut(parts: Column, found: Column) -> Column:
        plain = lambda t: F.struct(F.lit(True).alias("plain"), t.alias("t"))
        end = lambda k: F.when(k > 0, F.get(found, k - 1)["i"] + F.get(found, k - 1)["n"]).otherwise(0)

        def pair(x: Column, k: Column) -> Column:
            front = F.concat(joined(parts, end(k), x["i"] - end(k)), F.regexp_extract(F.get(parts, x["i"]), "^[ -]*", 0))
            return F.array(plain(front), F.struct(F.lit(False).alias("plain"), F.regexp_replace(joined(parts, x["i"], x["n"]), "^[ -]+", "").alias("t")))

        last = end(F.size(found))
        return F.concat(F.flatten(F.transform(found, pair)), F.array(plain(joined(parts, last, F.size(parts) - last))))

    def solved(parts: Column) -> Column:
        groups = F.sequence(F.lit(0), F.size(parts) - 1)
        others = F.transform(groups, lambda i: F.struct(i.alias("i"), other(parts, i, False).alias("n"), other(parts, i, True).alias("behind")))

        sizes = F.transform(parts, lambda p: F.length(F.regexp_replace(p, "^[ -]+", "")))

        def steps(o: Column, sizes: Column) -> Column:
            def one(x: Column) -> Column:
                return _let(F.when((x["n"] > 0) & (x["behind"] > 0), 0).otherwise(card(parts, sizes, o["behind"], x["i"])), lambda c: F.struct(x["i"].alias("i"), F.when(x["n"] > 0, x["n"]).otherwise(c).alias("n"), F.when(x["behind"] > 0, x["behind"]).otherwise(c).alias("behind")))

            return F.transform(o, one)

        return _let(_let(_let(sizes, lambda sz: _let(others, lambda o: steps(o, sz))), taken), lambda found: cut(parts, found))

    return _let(F.regexp_extract_all(run, F.lit(r"([ -]*\d+)"), 0), solved)


def _phone(m: Column, key: str) -> Column:
    """North American numbers are permuted in three sets, so that what can be dialled stays so: area and
    exchange from 200 on; areas below 200; exchanges below 200.  Of other international numbers the
    first two digits stay."""

    def north_american(d: Column) -> Column:
        area, exchange, line = (F.substring(d, *at).cast("long") for at in ((-10, 3), (-7, 3), (-4, 4)))
        shown = lambda x, y, z: F.concat(F.lpad(x.cast("string"), 3, "0"), F.lpad(y.cast("string"), 3, "0"), F.lpad(z.cast("string"), 4, "0"))

        def within(what: str, a: int, b: int, first_area: int, first_exchange: int, exchanges: int) -> Column:
            index = ((area - first_area) * exchanges + exchange - first_exchange) * 10_000 + line
            part = lambda v, by: F.floor(v / F.lit(by)).cast("long")
            return _let(feistel(index, F.lit(a), F.lit(b), key, what), lambda v: shown(part(v, exchanges * 10_000) + first_area, F.pmod(part(v, 10_000), F.lit(exchanges)) + first_exchange, F.pmod(v, F.lit(10_000))))

        sets = (within("phone", 80_000, 80_000, 200, 200, 800), within("phone area", 40_000, 50_000, 0, 0, 1_000), within("phone exchange", 40_000, 40_000, 200, 0, 200))
        return F.when(area < 200, sets[1]).when(exchange < 200, sets[2]).otherwise(sets[0])

    def international(d: Column) -> Column:
        size = F.length(d) - 2
        half = F.floor(size / 2).cast("int")
        start = F.struct(F.substring(d, F.lit(3), size - half).cast("long").alias("l"), F.substring(d, size - half + 3, half).cast("long").alias("r"), _power(size - half).alias("a"), _power(half).alias("b"))
        return F.concat(F.substring(d, 1, 2), F.lpad(_feistel(start, key, "phone abroad").cast("string"), size, "0"))

    def permuted(d: Column) -> Column:
        home = _reshaped(m, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), north_american(d)))
        return F.when(m.rlike(r"^\+[2-9]"), _reshaped(m, international(d))).when(F.length(d).between(10, 11), home)

    return _let(_digits(m), permuted)


def _ip(m: Column, key: str) -> Column:
    def permuted(o: Column) -> Column:
        valid = F.forall(o, lambda x: x <= 255)
        index = ((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3]
        fresh = _let(feistel(index, F.lit(65_536), F.lit(65_536), key, "ip"), lambda v: F.concat_ws(".", *[F.pmod(F.floor(v / F.lit(256**k)), F.lit(256)).cast("long").cast("string") for k in (3, 2, 1, 0)]))
        return F.when(valid, fresh)

    return _let(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), permuted)


def _ssn(m: Column, key: str) -> Column:
    def permuted(p: Column) -> Column:
        area, group, serial = p[0], p[1], p[2]
        valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
        index = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
        fresh = _let(feistel(index, F.lit(898 * 99), F.lit(9999), key, "ssn"), lambda v: _let(F.struct((F.floor(v / F.lit(9999 * 99)).cast("long") + 1).alias("a"), (F.pmod(F.floor(v / F.lit(9999)).cast("long"), F.lit(99)) + 1).alias("g"), (F.pmod(v, F.lit(9999)) + 1).alias("s")), lambda t: F.concat_ws("-", F.lpad((t["a"] + F.when(t["a"] >= 666, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad(t["g"].cast("string"), 2, "0"), F.lpad(t["s"].cast("string"), 4, "0"))))
        return F.when(valid, fresh)

    return _let(F.transform(F.split(m, "-"), lambda x: x.cast("long")), permuted)


def _date(m: Column, key: str) -> Column:
    """Days from 1900 to 2099. Slashed and dotted dates are read day first, and month first only where
    that is no date; those of the second kind are permuted among themselves, so both stay what they are."""
    iso = F.when(m.contains("-"), m).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))
    american = F.when(~m.contains("-"), F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2)))
    sign = F.when(m.contains("/"), "/").otherwise(".")

    def shown(d: Column, *order: tuple[int, int]) -> Column:
        """Null for null; the parts of an ISO date in another order."""
        one, two, three = (F.substring(d, *at) for at in order)
        return F.concat(one, sign, two, sign, three)

    year, month, day = (1, 4), (6, 2), (9, 2)
    usual = _let(_let(_day(iso), lambda v: _any_day(v, key)), lambda d: F.when(m.contains("-"), d).otherwise(shown(d, day, month, year)))
    return F.coalesce(usual, _let(_let(_day(american), lambda v: _late_day(v, key)), lambda d: shown(d, month, day, year)))


def _day(iso: Column) -> Column:
    """A date, or null where there is none or it is out of range."""
    found = F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")
    return _let(found, lambda d: F.when(F.year(d).between(1900, 2099), d))


def _any_day(day: Column, key: str) -> Column:
    """ISO form of another day: 365 x 200 days from 1900-01-01; the 49 left over go among themselves."""
    n = F.datediff(day, F.lit("1900-01-01").cast("date")).cast("long")
    fresh = F.when(n < 73_000, feistel(n, F.lit(365), F.lit(200), key, "date")).otherwise(73_000 + feistel(n - 73_000, F.lit(7), F.lit(7), key, "last days"))
    return F.when(day.isNotNull(), F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), fresh.cast("int")), "yyyy-MM-dd"))


_LONG_MONTHS = (1, 3, 5, 7, 8, 10, 12)


def _late_day(day: Column, key: str) -> Column:
    """ISO form of another day from the 13th on: the 13th to 28th of any month, the 29th and 30th of
    months other than February, the 31st, and February 29th are permuted each among themselves."""
    y, mon, d = F.year(day).cast("long") - 1900, F.month(day).cast("long"), F.dayofmonth(day).cast("long")
    iso = lambda y_, m_, d_: F.concat_ws("-", (y_ + 1900).cast("string"), F.lpad(m_.cast("string"), 2, "0"), F.lpad(d_.cast("string"), 2, "0"))
    part = lambda v, by, of: F.pmod(F.floor(v / F.lit(by)).cast("long"), F.lit(of))
    whole = lambda v, by: F.floor(v / F.lit(by)).cast("long")
    long_months = F.array(*map(F.lit, _LONG_MONTHS))
    usual = _let(feistel((y * 12 + mon - 1) * 16 + d - 13, F.lit(192), F.lit(200), key, "late day"), lambda v: iso(whole(v, 192), part(v, 16, 12) + 1, part(v, 1, 16) + 13))
    no_february = F.when(mon == 1, 0).otherwise(mon - 2)
    ends = _let(feistel((y * 11 + no_february) * 2 + d - 29, F.lit(22), F.lit(200), key, "month end"), lambda v: _let(part(v, 2, 11), lambda k: iso(whole(v, 22), F.when(k == 0, 1).otherwise(k + 2), part(v, 1, 2) + 29)))
    lasts = _let(feistel(y * 7 + F.array_position(long_months, mon.cast("int")) - 1, F.lit(7), F.lit(200), key, "31st"), lambda v: iso(whole(v, 7), F.element_at(long_months, (part(v, 1, 7) + 1).cast("int")), F.lit(31)))
    leap = _let(feistel(whole(y - 4, 4), F.lit(7), F.lit(7), key, "leap day"), lambda v: iso(v * 4 + 4, F.lit(2), F.lit(29)))
    return F.when(d.between(13, 28), usual).when((d == 29) & (mon == 2), leap).when(d.between(29, 30), ends).when(d == 31, lasts)


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(m)), 256), 1, 16), F.lit("@mail.invalid"))


def _secret(m: Column, key: str) -> Column:
    fresh = F.substring(F.concat(*[F.sha2(F.concat(F.lit(f"{key}|secret{k}|"), m), 256) for k in (1, 2)]), F.lit(1), F.length(m))
    return F.when(m.startswith("AKIA"), F.concat(F.lit("AKIA"), F.upper(F.substring(fresh, 1, 16)))).when(F.upper(m) == m, F.upper(fresh)).otherwise(fresh)


def _pseudonym(m: Column, key: str) -> Column:
    """struct(kind, fresh): what was found in a match, null where a check fails, and what stands in for it."""
    digits = F.length(_digits(m))
    kind = (
        F.when(m.contains("@"), "emails")
        .when(m.rlike(rf"^(?:AKIA[0-9A-Z]{{16}}|[0-9a-fA-F]{{32,64}})$"), "secrets")
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ips")
        .when(m.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})$"), "dates")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssns")
        .when(m.startswith("+") | digits.between(10, 11), "phones")
        .otherwise("cards")
    )
    made = {"emails": _email, "secrets": _secret, "ips": _ip, "dates": _date, "ssns": _ssn, "phones": _phone, "cards": _card}

    def chosen(k: Column) -> Column:
        out = None
        for name, f in made.items():
            out = F.when(k == name, f(m, key)) if out is None else out.when(k == name, f(m, key))
        return _let(out, lambda v: F.struct(F.when(v.isNotNull(), k).alias("kind"), F.coalesce(v, m).alias("fresh")))

    return _let(kind, chosen)


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", counts: bool = True) -> DataFrame:
    """The documents with pseudonyms in their texts and, with ``counts``, a column n_<kind> for each kind.

    Who has ``key`` can undo the permutations, so it has no default: draw it at random and keep it."""
    if not key:
        raise ValueError("pseudonyms need a secret key")
    text = F.col(text_col)
    found, parts_, each, made, fresh = free_names(docs, "found", "parts", "each", "made", "fresh")
    with_found = docs.withColumn(found, F.when(text.rlike(r"[0-9@]"), F.regexp_extract_all(text, F.lit(f"({ANY})"), 0)).otherwise(F.array().cast("array<string>")))
    run = lambda m: m.rlike(r"^\d[\d -]+$") & (F.length(_digits(m)) >= 13) & ~m.rlike(r"^\d{32,64}$")
    as_is = lambda m: F.array(F.struct(F.lit(False).alias("plain"), m.alias("t")))
    with_parts = with_found.withColumn(parts_, F.transform(F.col(found), lambda m: F.when(run(m), _in_run(m)).otherwise(as_is(m))))
    unchanged = lambda t: F.struct(F.lit(None).cast("string").alias("kind"), t.alias("fresh"))
    with_each = with_parts.withColumn(each, F.transform(F.col(parts_), lambda parts: F.transform(parts, lambda x: F.when(x["plain"], unchanged(x["t"])).otherwise(_pseudonym(x["t"], key)))))
    with_made = with_each.withColumn(made, F.flatten(F.col(each)))
    gaps = F.split(text, ANY, -1)
    whole = F.array_join(F.flatten(F.zip_with(gaps, F.col(each), lambda g, e: F.array(g, F.coalesce(F.array_join(e["fresh"], ""), F.lit(""))))), "")
    out = with_made.withColumn(fresh, F.when(F.size(F.col(found)) == 0, text).otherwise(whole))
    counted = {f"n_{k}" for k in FOUND} if counts else set()
    columns = [F.col(fresh).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in counted]
    if counts:
        columns += [F.coalesce(F.size(F.filter(F.col(made), lambda m: m["kind"] == k)), F.lit(0)).alias(f"n_{k}") for k in FOUND]
    return out.select(*columns)
