"""Fill-in-the-middle transformation by escaped marker injection, in column expressions only.

1. *Escape.*  A control character is the delimiter and another one escapes it, so that the
   delimiter stands nowhere in an escaped text.
2. *Inject.*  ``regexp_replace`` appends the delimiter after each unit: code point, word with the
   white space after it, or line with its end.  An escaped character is one code point here.
3. *Count and cut.*  The number of delimiters is the number of units.  Two ranks come from a hash
   of the id; ``substring_index`` takes what stands before the first, between them and after the
   second.
4. *Assemble.*  Delimiters go, escapes are undone, and the parts are put together with the three
   markers: prefix-suffix-middle or suffix-prefix-middle.

``restored`` cuts an output at its markers and gives the exact text back: a text that holds a
marker is left plain, and markers begin with a character that stands nowhere else in them, so
none arises where parts meet.

Each row is worked out by itself: no shuffle, no Python, memory for a few copies of one text.

Edge cases: a null text counts as empty; an empty text is plain with no units; a null id counts as
empty in the hash; repeated rows come out alike, and so do rows of one id up to their lengths; the
delimiter and the escape character may stand in a text; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

DELIMITER, ESCAPE = "\x1e", "\x1b"
MARKERS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
#: what a unit is, over escaped text; each pattern's matches cover the whole text
UNITS = {
    "character": rf"(?s){ESCAPE}.|[^{ESCAPE}]",
    "word": r"(?s)[^ \t-\r]+[ \t-\r]*|[ \t-\r]+",
    "line": r"(?s)[^\n]*\n|[^\n]+",
}


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}e")), F.lit(DELIMITER), F.lit(f"{ESCAPE}d"))


def unescaped(part: Column) -> Column:
    """A run of units as it stood in the text."""
    plain = F.replace(part, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(plain, F.lit(f"{ESCAPE}d"), F.lit(DELIMITER)), F.lit(f"{ESCAPE}e"), F.lit(ESCAPE))


def injected(text: Column, unit: str = "character") -> Column:
    """The escaped text with a delimiter after each unit."""
    return F.regexp_replace(escaped(text), F.lit(UNITS[unit]), F.lit(f"$0{DELIMITER}"))


def units_in(marked: Column) -> Column:
    return F.length(marked).cast("long") - F.length(F.replace(marked, F.lit(DELIMITER), F.lit("")))


def before_rank(marked: Column, rank: Column) -> Column:
    """The first ``rank`` units, without the last delimiter."""
    return F.call_function("substring_index", marked, F.lit(DELIMITER), rank.cast("int"))


def after_rank(marked: Column, rank: Column, n: Column) -> Column:
    """The units after the first ``rank`` of n; a marked text ends with a delimiter."""
    return F.call_function("substring_index", marked, F.lit(DELIMITER), (rank - n - 1).cast("int"))


def hashed(id_: Column, seed: int, group: int) -> Column:
    """An unsigned number from a group of eight digits of the id's SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text again, from the output and its form alone."""
    p, s, m = markers
    head = lambda x, marker: F.substring_index(x, marker, 1)
    tail = lambda x, marker: F.substring_index(x, marker, -1)
    psm = F.concat(tail(head(output, s), p), tail(output, m), head(tail(output, s), m))
    spm = F.concat(head(tail(output, p), m), tail(output, m), tail(head(output, p), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "character", seed: int = 1, percent: int = 90, spm_percent: int = 20, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """doc_id, text, n (units), form (plain, psm, spm), prefix, middle, suffix (null if plain) and output.

    ``percent`` of the texts are transformed, and of these ``spm_percent`` begin with the suffix; both go
    by the id's hash, so a document has the same form wherever and whenever it is worked out."""
    if len({x[:1] for x in markers}) != 1 or any(markers[0][0] in x[1:] for x in markers) or len(set(markers)) != 3:
        raise ValueError("markers must differ and begin with one character that stands nowhere else in them")
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    rows = rows.select("doc_id", "text", injected(F.col("text"), unit).alias("marked"))
    h = [hashed(F.col("doc_id"), seed, i) for i in (1, 2, 3, 4)]
    has_marker = F.lit(False)
    for x in markers:
        has_marker = has_marker | F.contains("text", F.lit(x))
    plain = (F.col("text") == "") | has_marker | (h[2] % 100 >= percent)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "marked", units_in(F.col("marked")).alias("n"), form.alias("form"))
    a, b = (x % (F.col("n") + 1) for x in h[:2])
    rows = rows.select("*", F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
    low, high, n, marked = (F.col(x) for x in ("low", "high", "n", "marked"))
    cut = lambda part: F.when(F.col("form") != "plain", unescaped(part))
    middle = after_rank(F.concat(before_rank(marked, high), F.lit(DELIMITER)), low, high)
    rows = rows.select("doc_id", "text", "n", "form", cut(before_rank(marked, low)).alias("prefix"), cut(F.when(high > low, middle).otherwise("")).alias("middle"), cut(after_rank(marked, high, n)).alias("suffix"))
    p, s, m = (F.lit(x) for x in markers)
    psm, spm = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    return rows.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")))


def middle_report(docs: DataFrame) -> DataFrame:
    """Forms, sizes and digests of ``fill_in_middle``, and of the texts rebuilt from its outputs."""
    found = fill_in_middle(docs)
    back = restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
