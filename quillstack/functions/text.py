"""Cleaning, keys and small grammars over text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it; Java's \s and Spark's trim know less. Most characters are told apart by the first range.
SPACE = r"[^!-~]&&[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def trim_ws(c: Column | str) -> Column:
    """Without white space at both ends; null counts as empty."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), f"^[{SPACE}]+|[{SPACE}]+$", "")


def squeeze(c: Column | str) -> Column:
    """Runs of white space as one space, trimmed."""
    return trim_ws(F.regexp_replace(F.coalesce(col(c), F.lit("")), f"[{SPACE}]+", " "))


def first_filled(*cs: Column | str) -> Column:
    """The first that isn't blank, else empty."""
    return F.coalesce(*[F.nullif(trim_ws(c), F.lit("")) for c in cs], F.lit(""))


def name_key(c: Column | str) -> Column:
    return F.lower(trim_ws(c))


def compact_key(c: Column | str) -> Column:
    """Lower-case letters and digits only, so that spelling of spaces and hyphens doesn't matter."""
    return F.regexp_replace(name_key(c), "[^a-z0-9]+", "")


def loosely_same(a: Column, b: Column, stem: int = 3) -> Column:
    """Compact keys that are equal, or the shorter, of ``stem`` characters at least, starts the longer."""
    short, long_ = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (a != "") & (b != "") & ((a == b) | ((F.length(short) >= stem) & F.startswith(long_, short)))


def number_or_zero(c: Column | str) -> Column:
    """A number written with thousands commas; anything else, and NaN, is 0."""
    v = F.regexp_replace(trim_ws(c), ",", "").try_cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(v)


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))


# several values in one field

VALUE_JOIN = " / "


def split_values(c: Column | str) -> Column:
    """Values parted by slashes or commas, blanks dropped; a field of separators only is one value."""
    whole = trim_ws(c)
    parts = F.filter(F.transform(F.split(whole, r"\s*/\s*|,\s*"), trim_ws), lambda x: x != "")
    return F.when(whole == "", F.array().cast("array<string>")).when(F.size(parts) == 0, F.array(whole)).otherwise(parts)


def join_values(c: Column | str) -> Column:
    return F.array_join(split_values(c), VALUE_JOIN)


def number_spec(c: Column | str) -> Column:
    """Numbers of a list with ranges, as "1, 3-5"; a falling range gives its first number only."""

    def one(p: Column) -> Column:
        # a cast that fails costs more than a match, so only digits are cast
        ends = F.transform(F.split(p, r"\s*-\s*"), lambda x: x.try_cast("int"))
        range_ = let(ends, lambda e: F.when(e[0].isNull() | e[1].isNull(), F.array().cast("array<int>")).when(e[0] <= e[1], F.sequence(e[0], e[1])).otherwise(F.array(e[0])))
        return F.when(p.rlike(r"^\d+$"), F.array(p.try_cast("int"))).when(p.rlike(r"^\d+\s*-\s*\d+$"), range_).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(F.transform(F.split(squeeze(c), ","), trim_ws), one))


def assign_one_to_one(values: Column, orders: Column, assigned: Column) -> Column:
    """assigned (map<int,string>, from 0) with the last pair that is left over filled in, where it
    can be deduced: as many values as can be paired with orders, and one of each still open."""
    many, of = F.size(values), F.size(orders)
    pairs = F.when((many <= 1) | (of <= 1), 0).otherwise(F.least(many, of))
    numbers = F.when(pairs > 0, F.sequence(F.lit(0), pairs - 1)).otherwise(F.array().cast("array<int>"))

    def completed(sound: Column) -> Column:
        """Each step is worked out once a row, not once an element of the next."""
        taken = F.struct(F.map_keys(sound).alias("values"), F.transform(F.map_values(sound), trim_ws).alias("orders"))
        left = lambda t: F.struct(F.filter(numbers, lambda i: ~F.array_contains(t["values"], i)).alias("values"), F.filter(orders, lambda o: ~F.array_contains(t["orders"], o)).alias("orders"))
        deduced = lambda x: (F.size(x["values"]) == 1) & (F.size(x["orders"]) == 1)
        return let(let(taken, left), lambda x: F.when(deduced(x), F.map_concat(sound, F.map_from_arrays(x["values"], x["orders"]))).otherwise(sound))

    return let(F.map_filter(assigned, lambda i, v: (i >= 0) & (i < pairs) & (trim_ws(v) != "")), completed)


# keys of records and files


def preset_key(kind: Column | str, name: Column | str) -> Column:
    return F.concat_ws("::", col(kind), trim_ws(name))


def preset_key_parts(key: Column | str, default_kind: str = "shipping") -> Column:
    """struct(kind, name) of a stored key; a key without a kind has the default one."""
    k = col(key)
    has = F.instr(k, "::") > 0
    return F.struct(F.when(has, F.substring_index(k, "::", 1)).otherwise(default_kind).alias("kind"), F.when(has, F.regexp_replace(k, "^.*?::", "")).otherwise(k).alias("name"))


#: File-name tokens of document kinds.
FILE_TOKENS = {"shipping": "SL", "receiving": "RL", "bol": "BOL", "bulk": "BL"}


def file_name(kind: Column | str, order: Column | str, extension: str = "pdf") -> Column:
    token = F.element_at(F.create_map(*[F.lit(x) for kv in FILE_TOKENS.items() for x in kv]), col(kind))
    return F.concat(token, F.lit("-"), F.regexp_replace(trim_ws(order), r'[\\/:*?"<>|\s]+', "_"), F.lit(f".{extension}"))


def base36(c: Column | str) -> Column:
    return F.lower(F.conv(col(c).cast("string"), 10, 36))


def serial_label(c: Column | str, prefix: str = "SW") -> Column:
    """A serial number with four digits, of which the last four stay."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.lpad(col(c).cast("string"), F.greatest(F.length(col(c).cast("string")), F.lit(4)), F.lit("0")), -4, 4))


#: Fixed value: endings that mark a copy of a file.
COPY_ENDING = r"(?i)(\(\d+\)|_\d+_?|-copy(?:\s*\(\d+\))?|_restored(?:_hr)?|_copy)$"


def file_stem(c: Column | str, rounds: int = 6) -> Column:
    """Name without folder, extension and up to ``rounds`` copy endings, compact."""
    stem = name_key(F.regexp_replace(F.element_at(F.split(col(c), r"[/\\]"), -1), r"(?<=.)\.[^.]*$", ""))
    for _ in range(rounds):
        stem = F.trim(F.regexp_replace(stem, COPY_ENDING, ""))
    return F.regexp_replace(stem, "[^a-z0-9]+", "")


def is_clutter(c: Column | str) -> Column:
    return col(c).rlike(r"(?i)(\(\d+\)|_\d+_|- copy|history_|_restored)")


def stems_related(a: Column, b: Column) -> Column:
    """Stems that are equal, or of four characters at least with one inside the other."""
    inside = (F.length(a) >= 4) & (F.length(b) >= 4) & (F.contains(a, b) | F.contains(b, a))
    return (a != "") & (b != "") & ((a == b) | inside)


def sizes_match(a: Column, b: Column, ratio: float = 0.12) -> Column:
    return (a > 0) & (b > 0) & (F.abs(a - b) / F.greatest(a, b) <= ratio)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def version_struct(c: Column | str) -> Column:
    """Major, minor, patch, build of "v1.2.3+4", comparable as a struct."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(trim_ws(c), r"^[vV]?(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:\+(\d+))?", i), F.lit("")).try_cast("int"), F.lit(0))
    return F.struct(*[part(i).alias(n) for i, n in enumerate(("major", "minor", "patch", "build"), 1)])


# URLs


def url_key(c: Column | str) -> Column:
    """Scheme, host and path in lower case; what doesn't parse is its own key."""
    u = col(c)
    scheme, host = F.try_parse_url(u, F.lit("PROTOCOL")), F.try_parse_url(u, F.lit("HOST"))
    return F.lower(F.when(scheme.isNull() | host.isNull(), u).otherwise(F.concat(scheme, F.lit("://"), host, F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")))))


def url_host(c: Column | str) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(col(c), F.lit("HOST")), F.lit("")))


# dates, dimensions, kinds


def display_date(c: Column | str) -> Column:
    """Date of "Jan 5, 2024"; other forms are null."""
    return F.try_to_timestamp(trim_ws(c), F.lit("MMM d, yyyy")).cast("date")


def shown_date(c: Column | str) -> Column:
    return F.date_format(col(c), "MMM d, yyyy")


#: Spellings of units.
UNITS = {"in": ("in", "inch", "inches"), "ft": ("ft", "foot", "feet"), "cm": ("cm", "centimeter", "centimeters", "centimetre", "centimetres"), "m": ("m", "meter", "meters", "metre", "metres"), "mm": ("mm", "millimeter", "millimeters", "millimetre", "millimetres")}


def unit(c: Column | str) -> Column:
    """A unit's short form; blank and unknown ones are inches."""
    u = name_key(c)
    out = F.lit("in")
    for short, spellings in UNITS.items():
        out = F.when(u.isin(*spellings), F.lit(short)).otherwise(out)
    return out


def dimensions(c: Column | str) -> Column:
    """struct(length, width, height, length_unit, width_unit, height_unit) of "48x40x48", "6 in x 6 in x 21 ft"
    or "12 x 8 x 10 cm"; an axis without a unit takes the first unit that is written, or inches; other text is
    the length, as it stands."""
    s = trim_ws(c)
    words = "|".join(sorted((w for ws in UNITS.values() for w in ws), key=len, reverse=True))
    axis = rf"([0-9]*\.?[0-9]+)\s*({words})?"
    pattern = rf"(?i)^{axis}\s*[x×]\s*{axis}\s*[x×]\s*{axis}$"
    part = lambda i: F.regexp_extract(s, pattern, i)
    any_unit = F.coalesce(*[F.nullif(part(i), F.lit("")) for i in (2, 4, 6)], F.lit("in"))
    fits = s.rlike(pattern)
    numbers = [F.when(fits, part(i)).otherwise(s if i == 1 else F.lit("")) for i in (1, 3, 5)]
    units = [F.when(fits, unit(F.coalesce(F.nullif(part(i), F.lit("")), any_unit))).otherwise("in") for i in (2, 4, 6)]
    return F.struct(*[x.alias(n) for x, n in zip([*numbers, *units], ("length", "width", "height", "length_unit", "width_unit", "height_unit"), strict=True)])


def shown_dimensions(d: Column) -> Column:
    dash = lambda x: F.when(trim_ws(x) == "", "—").otherwise(trim_ws(x))
    blank = (trim_ws(d["length"]) == "") & (trim_ws(d["width"]) == "") & (trim_ws(d["height"]) == "")
    return F.when(blank, "").otherwise(F.concat_ws(" × ", *[F.concat(dash(d[a]), F.lit(" "), d[f"{a}_unit"]) for a in ("length", "width", "height")]))


#: Container kinds with their plurals and default units.
ITEM_PLURALS = {"Pallet": "Pallets", "Crate": "Crates", "Box": "Boxes", "Pipe": "Pipes", "Bundle": "Bundles", "Other": "Other"}
ITEM_UNITS = {"Pallet": ("ft", "ft", "ft"), "Crate": ("ft", "ft", "ft"), "Box": ("in", "in", "in"), "Pipe": ("in", "in", "ft"), "Bundle": ("in", "in", "ft")}


def item_type(c: Column | str) -> Column:
    """A kind in its singular and proper case; other text stays."""
    t = trim_ws(c)
    out = t
    for one, many in ITEM_PLURALS.items():
        out = F.when(F.lower(t).isin(one.lower(), many.lower()), one).otherwise(out)
    return out


def item_plural(c: Column | str) -> Column:
    """The category that totals go by."""
    t = item_type(c)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ITEM_PLURALS.items() for x in kv]), t), t)


def item_shown(c: Column | str, quantity: Column) -> Column:
    return F.when(quantity <= 1, item_type(c)).otherwise(item_plural(c))


def item_units(c: Column | str) -> Column:
    known = F.create_map(*[x for k, v in ITEM_UNITS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.element_at(known, item_type(c))


#: Freight terms with the spellings that mean them and how they are shown.
FREIGHT_TERMS = {
    "prepaid": (("prepaid",), "Prepaid"),
    "collect": (("collect",), "Collect"),
    "third_party": (("third_party", "3rd party", "third party"), "Third Party"),
    "customer_pickup": (("customer_pickup", "customer pick-up", "customer pickup", "cust. pick-up", "cust pick-up", "pick-up", "pickup"), "Customer Pick-Up"),
}


def freight_term(c: Column | str) -> Column:
    """The term that a text means, or empty."""
    t = name_key(c)
    out = F.lit("")
    for term, (spellings, _) in FREIGHT_TERMS.items():
        out = F.when(t.isin(*spellings), term).otherwise(out)
    return out


def freight_shown(c: Column | str) -> Column:
    """A term as it is printed; other text as it is."""
    t = trim_ws(c)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for term, (_, shown) in FREIGHT_TERMS.items() for x in (term, shown)]), t), t)


def prefer(current: Column | str, incoming: Column | str) -> Column:
    """The current value unless it is blank or the incoming one continues it."""
    a, b = trim_ws(current), trim_ws(incoming)
    longer = F.startswith(F.lower(b), F.lower(a)) & (F.length(b) > F.length(a))
    return F.when(b == "", a).when((a == "") | longer, b).otherwise(a)


def differs(current: Column | str, incoming: Column | str) -> Column:
    a, b = trim_ws(current), trim_ws(incoming)
    return (a != "") & (b != "") & (F.lower(a) != F.lower(b))


def json_map(c: Column | str) -> Column:
    """A JSON object as a map of strings; null where it doesn't parse."""
    return F.from_json(col(c), "map<string,string>", {"mode": "PERMISSIVE"})


def json_in_text(c: Column | str) -> Column:
    """The JSON object or array inside noisy or fenced text."""
    return F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(?s)(\{.*\}|\[.*\])", 1)


# companies

#: Words that say nothing about which company it is.
COMPANY_NOISE = ("ltd", "inc", "corp", "llc", "llp", "lp", "co", "limited", "incorporated")


def company_tokens(c: Column | str) -> Column:
    words = F.filter(F.split(F.regexp_replace(name_key(c), "[^a-z0-9]+", " "), " "), lambda w: (w != "") & ~w.isin(*COMPANY_NOISE))
    return F.array_distinct(F.when(F.size(words) > 1, F.concat(words, F.array(F.array_join(words, "")))).otherwise(words))


def search_queries(c: Column | str, domain: Column | str) -> Column:
    """Search texts for a company's mark, the domain's first if it has one."""
    name, d = trim_ws(c), trim_ws(domain)
    out = F.array(F.when(d != "", F.concat(F.lit("site:"), d, F.lit(" logo"))), F.concat(name, F.lit(" logo")), F.concat(name, F.lit(" company logo png")), F.concat(name, F.lit(" logo vector")))
    return F.array_compact(out)
