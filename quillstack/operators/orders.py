"""Order documents as text: line notes to rows, identities, header references, and their review.

A document's notes part its text: what stands before a note holds its quantity and description,
what follows it, up to the next one, its identity.  All of it is expressions over one exploded
row per note; only the aggregates that pick first rows shuffle, by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import differs, first_filled, let, number_spec, prefer, squeeze, trim_ws
from ..plans.components import kept

# How notes and references are written.
LINE_NOTE = r"(?i)Order\s+Line\s+Notes:\s*CPO\s*(?:LINES?\s*)?#?\s*([0-9]+(?:\s*[-,]\s*[0-9]+)*)"
IDENTITY_NOTE = r"(?im)Order\s+Line\s+Notes:\s*(TAG|PART|ITEM)\s*#\s*(.+)$"
IDENTITY_LOOSE = r"(?im)^\s*(TAG|PART|ITEM)\s*#\s*(.+?)\s*$"
REFERENCE = r"(?:P\d{4,}|(?:[A-Z]{1,6}-)?\d{3,}(?:[.\-/][A-Z0-9]+)*)"
ANY_QUANTITY = r"(?i)EA\s*\d+\.\d|\d+\.\d+\s+EA\b"
LAST_QUANTITY = r"(?is)^.*(?:EA\s*(\d+\.\d+)|(?<!\d)(\d+\.\d+)\s+EA\b)(.*)$"
NO_IDENTITY = r"(?i)^Order\s+Line\s+Notes:|^(Rev|Page|Subtotal|GST|Total)\b|^\d{1,3}$|\d\s*EA\s*\d|\bEA\b"
LINE_PO = rf"(?im)^\s*PO\s*#\s*({REFERENCE})\s*$"
LOOK_BACK = 400
_LEAST = 20  # characters that any note has


def _text(c: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\r\n?", "\n")


def notes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per line note: key, ordinal, spec, quantity (null without one), description, back, note, after.

    A document is cut where its notes begin, in one pass; quantities are looked for in the piece before a note, and only where it
    has none in the last one before that has. A row carries the text up to the next note and the last characters before it, so
    a document with many notes isn't copied for each."""

    def one(pieces: Column, marked: Column) -> Column:
        def row(piece: Column, i: Column) -> Column:
            before, from_ = F.get(pieces, i), F.array_max(F.slice(marked, F.lit(1), i + 1))
            # a note follows, so EA at the end of a piece is none if the note is written right behind it
            counted = F.concat(F.get(pieces, from_), F.lit("O"))
            group = lambda n: F.regexp_extract(counted, LAST_QUANTITY, n)
            rest = let(group(3), lambda r: F.substring(r, F.lit(1), F.length(r) - 1))
            between = F.when(from_ < i, F.array_join(F.slice(pieces, from_ + 2, i - from_), "")).otherwise("")
            back = F.when(F.length(before) >= LOOK_BACK, before).otherwise(F.array_join(F.slice(pieces, F.greatest(i + 1 - LOOK_BACK // _LEAST, F.lit(1)), F.least(i + 1, F.lit(LOOK_BACK // _LEAST + 1))), ""))
            return let(
                F.regexp_extract(piece, f"^{LINE_NOTE}", 0),
                lambda note: F.struct(
                    i.alias("ordinal"), squeeze(F.regexp_extract(note, LINE_NOTE, 1)).alias("spec"),
                    F.when(from_.isNotNull(), F.concat(group(1), group(2)).try_cast("double")).alias("quantity"),
                    F.when(from_.isNull(), "").otherwise(_description(F.concat(rest, between))).alias("description"),
                    let(back, lambda x: F.substring(x, F.greatest(F.length(x) - LOOK_BACK + 1, F.lit(1)), F.lit(LOOK_BACK))).alias("back"),
                    note.alias("note"), F.substring(piece, F.length(note) + 1, F.length(piece)).alias("after"),
                ),
            )

        return F.transform(F.slice(pieces, F.lit(2), F.size(pieces) - 1), row)

    # a character before the text keeps a note at its start from being its first piece
    cut = F.split(F.concat(F.lit("\n"), _text(text)), f"(?={LINE_NOTE})", -1)
    pieces = lambda c: F.transform(c, lambda p, i: F.when(i == 0, F.substring(p, F.lit(2), F.length(p))).otherwise(p))
    marked = lambda c: F.transform(c, lambda p, i: F.when(F.concat(p, F.lit("O")).rlike(ANY_QUANTITY), i))
    found = let(let(cut, pieces), lambda c: let(marked(c), lambda m: one(c, m)))
    # outer, so that no filter is made of the size of what is exploded, which would work it out twice
    return documents.select(key, F.explode_outer(found).alias("n")).filter(F.col("n").isNotNull()).select(key, "n.*")


def _description(slice_: Column) -> Column:
    lines = F.filter(F.transform(F.split(slice_, "\n"), trim_ws), lambda x: (x != "") & ~x.rlike(r"^\d+$"))
    return let(F.array_join(F.slice(lines, 1, 3), " "), lambda text: F.when(F.length(text) > 120, F.concat(F.substring(text, 1, 117), F.lit("…"))).otherwise(text))


def _identity(back: Column, note: Column, after: Column) -> Column:
    """struct(kind, value) from the note behind, the nearest one around, a loose mark, or the first line."""
    around = F.concat(back, note, after)
    pair = lambda kind, value: F.when(kind != "", F.struct(F.lower(kind).alias("kind"), squeeze(value).alias("value")))
    behind = pair(F.regexp_extract(after, IDENTITY_NOTE, 1), F.regexp_extract(after, IDENTITY_NOTE, 2))
    last = F.coalesce(F.try_element_at(F.regexp_extract_all(around, F.lit(IDENTITY_NOTE), F.lit(0)), F.lit(-1)), F.lit(""))
    near = let(last, lambda x: pair(F.regexp_extract(x, IDENTITY_NOTE, 1), F.regexp_extract(x, IDENTITY_NOTE, 2)))
    loose_value = squeeze(F.regexp_extract(after, IDENTITY_LOOSE, 2))
    cut = trim_ws(F.split(loose_value, r"\bEA\b").getItem(0))
    loose = pair(F.regexp_extract(after, IDENTITY_LOOSE, 1), first_filled(cut, loose_value))
    first = F.coalesce(F.try_element_at(F.filter(F.transform(F.split(after, "\n"), trim_ws), lambda x: x != ""), F.lit(1)), F.lit(""))
    bare = F.when((first != "") & ~first.rlike(NO_IDENTITY), F.struct(F.lit("part").alias("kind"), squeeze(first).alias("value")))
    return F.coalesce(behind, near, loose, bare)


def all_lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every line note as a line, repeats included: key, ordinal, line_no, cpo_display, cpo_numbers, quantity,
    counted, description, id_kind, id_value, line_po, reason. reason is empty for complete lines; a
    missing quantity is 1, and counted tells whether there was one."""
    rows = notes(documents, key, text).withColumn("cpo_numbers", number_spec("spec")).filter(F.size("cpo_numbers") > 0)
    rows = rows.withColumn("i", _identity(F.col("back"), F.col("note"), F.col("after")))
    value = F.coalesce(F.col("quantity"), F.lit(0.0))
    quantity = F.when(value > 0, F.greatest(F.round(value), F.lit(1.0))).otherwise(1.0).cast("int")
    reason = F.when(F.col("i").isNull(), "Missing TAG# / PART# / ITEM#").when(F.col("i.value") == "", F.concat(F.lit("Empty "), F.upper("i.kind"), F.lit("#"))).otherwise("")
    line_po = trim_ws(F.regexp_extract("after", LINE_PO, 1))
    return rows.select(key, "ordinal", F.get("cpo_numbers", F.lit(0)).alias("line_no"), F.col("spec").alias("cpo_display"), "cpo_numbers", quantity.alias("quantity"), F.col("quantity").isNotNull().alias("counted"), "description", F.coalesce("i.kind", F.lit("")).alias("id_kind"), F.coalesce("i.value", F.lit("")).alias("id_value"), line_po.alias("line_po"), reason.alias("reason"))


def first_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of repeated references the first complete line, or else the first incomplete one."""
    order = F.struct((F.col("reason") != "").alias("open"), F.col("ordinal").alias("o"))
    rest = [c for c in lines.columns if c not in (key, "cpo_display")]
    one = lines.groupBy(key, "cpo_display").agg(F.min_by(F.struct(*rest), order).alias("r"))
    return one.select(key, "cpo_display", "r.*").select(lines.columns)


def parsed_lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``first_lines`` of ``all_lines``: what labels are printed from."""
    return first_lines(all_lines(documents, key, text), key).drop("counted")


def document_po(documents: DataFrame, lines: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, po_number (the header's, else the first beside a line), header_po, line_pos (those beside lines, in order)."""
    beside = lines.filter("line_po <> ''").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "line_po"))).alias("p"))
    pos = F.coalesce(F.transform("p", lambda x: x["line_po"]), F.array().cast("array<string>"))
    header = header_references(documents, key, text).select(key, F.col("po_number").alias("header_po"))
    return header.join(beside, key, "left").select(key, first_filled("header_po", F.get(pos, F.lit(0))).alias("po_number"), "header_po", pos.alias("line_pos"))


def warnings(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, kind, detail: what a reader of a document should know.

    no_notes; no_quantity, duplicate and duplicate_incomplete with the reference; nothing_parsed; no_po; and
    po_differs with the numbers beside the lines where one isn't the header's."""
    lines = kept(all_lines(documents, key, text))
    of_line = lines.filter("not counted").select(key, F.lit("no_quantity").alias("kind"), F.col("cpo_display").alias("detail"))
    seen = lines.join(first_lines(lines, key).select(key, "cpo_display", F.col("ordinal").alias("first"), (F.col("reason") == "").alias("complete")), [key, "cpo_display"]).filter("ordinal <> first")
    repeated = seen.select(key, F.when(F.col("reason") == "", "duplicate").otherwise("duplicate_incomplete").alias("kind"), F.col("cpo_display").alias("detail"))
    has_note = documents.select(key, _text(text).rlike(LINE_NOTE).alias("noted"))
    counts = has_note.join(lines.groupBy(key).agg(F.count("*").alias("n")), key, "left")
    po = document_po(documents, lines, key, text)
    other = F.exists("line_pos", lambda p: F.upper(p) != F.upper("header_po"))
    of_document = [
        counts.filter("not noted").select(key, F.lit("no_notes").alias("kind"), F.lit("").alias("detail")),
        counts.filter("n is null").select(key, F.lit("nothing_parsed").alias("kind"), F.lit("").alias("detail")),
        po.filter("po_number = ''").select(key, F.lit("no_po").alias("kind"), F.lit("").alias("detail")),
        po.filter((F.col("header_po") != "") & other).select(key, F.lit("po_differs").alias("kind"), F.array_join(F.array_distinct("line_pos"), ", ").alias("detail")),
    ]
    out = of_line.unionByName(repeated)
    for rows in of_document:
        out = out.unionByName(rows)
    return out


def header_references(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, po_number, order_number, document_kind: the first of several ways to write them that is found."""
    from .headers import document_kind, reference_row

    t = _text(text)
    find = lambda p, i=1: F.nullif(trim_ws(F.regexp_extract(t, p, i)), F.lit(""))
    po = F.coalesce(F.nullif(reference_row(t)["po"], F.lit("")), find(rf"(?i)PO\s*Number\s*[:#]?\s*({REFERENCE})"), find(rf"(?i)PO\s*Number[^\n]*\n\s*({REFERENCE})"), find(rf"(?i)PO\s*Number[\s\S]{{0,80}}?\b({REFERENCE})\b"), find(r"\b(P\d{5,})\b"), F.lit(""))
    order = F.coalesce(find(r"(?i)ORDER\s+ACKNOWLEDGEMENT\s*\n\s*(\d{5,})"), find(r"(?i)Order\s*Number\s*(\d{5,})"), find(r"(?i)Order\s*Number\s*\n(?:[^\n]*\n){0,16}?(\d{6,})"), F.lit(""))
    return documents.select(key, po.alias("po_number"), order.alias("order_number"), document_kind(t).alias("document_kind"))


def carrier_of(freight: Column) -> Column:
    """The carrier in a freight line, without terms of payment."""
    return squeeze(F.regexp_replace(freight, r"(?i)\b(freight|collect|prepaid|pre-paid|third party|bill|via|ship)\b|[:;,]", " "))


def payment_of(freight: Column) -> Column:
    return F.when(freight.rlike(r"(?i)\bcollect\b"), "collect").when(freight.rlike(r"(?i)\bpre-?paid\b"), "prepaid").otherwise("")


def resolved(lines: DataFrame, action: str) -> DataFrame:
    """Lines after the choice for incomplete ones: proceed (kept blank), skip (dropped), cancel (as they are)."""
    if action == "cancel":
        return lines
    if action == "skip":
        return lines.filter("reason = ''")
    if action == "proceed":
        return lines.withColumn("missing_identity", F.col("reason") != "").withColumn("reason", F.lit(""))
    raise ValueError(action)


def replaced_lines(lines: DataFrame, updates: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines with id_kind and id_value of an update of their line number."""
    u = updates.select(key, "line_no", F.col("id_kind").alias("__k"), F.col("id_value").alias("__v"))
    return lines.join(u, [key, "line_no"], "left").withColumn("id_kind", F.coalesce("__k", "id_kind")).withColumn("id_value", F.coalesce("__v", "id_value")).drop("__k", "__v")


def reviewed_lines(lines: DataFrame, reviews: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines beside the first review of their reference: status agrees, differs, unmatched, filled or open.

    A parsed identity is never replaced; an incomplete line takes the review's, marked as missing_identity.
    reviews: key, ordinal, cpo, id_kind, id_value, confidence, reasoning."""
    norm = lambda c: F.upper(F.regexp_replace(c, r"\s+", ""))
    r = reviews.withColumn("__cpo", norm("cpo")).filter("__cpo <> ''").groupBy(key, "__cpo").agg(F.min_by(F.struct("id_kind", "id_value", "confidence", "reasoning"), "ordinal").alias("r"))
    r = r.select(key, "__cpo", F.col("r.id_kind").alias("__k"), trim_ws("r.id_value").alias("__v"), "r.confidence", "r.reasoning", F.lit(True).alias("__met"))
    j = lines.withColumn("__cpo", norm("cpo_display")).join(r, [key, "__cpo"], "left")
    open_ = F.col("reason") != ""
    fills = open_ & F.coalesce(F.col("__k").isNotNull() & (F.col("__v") != ""), F.lit(False))
    agrees = (F.col("__k") == F.col("id_kind")) & (F.lower("__v") == F.lower(trim_ws("id_value")))
    status = F.when(fills, "filled").when(open_, "open").when(F.col("__met").isNull(), "unmatched").when(F.coalesce(agrees, F.lit(False)), "agrees").otherwise("differs")
    out = j.withColumn("status", status).withColumn("missing_identity", fills)
    out = out.withColumn("id_kind", F.when(fills, F.col("__k")).otherwise(F.col("id_kind"))).withColumn("id_value", F.when(fills, F.col("__v")).otherwise(F.col("id_value"))).withColumn("reason", F.when(fills, "").otherwise(F.col("reason")))
    return out.drop("__cpo", "__k", "__v", "__met")


def reconciled_header(parsed: DataFrame, reviewed: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """The better of two readings of each field, with notes where they disagree."""
    j = parsed.join(reviewed.select(key, *[F.col(f).alias(f"__{f}") for f in fields]), key, "left")
    notes_ = F.array_compact(F.array(*[F.when(differs(f, F.coalesce(F.col(f"__{f}"), F.lit(""))), F.concat(F.lit(f"{f}: "), F.col(f), F.lit(" / "), F.col(f"__{f}"))) for f in fields]))
    return j.withColumn("notes", notes_).select(key, *[prefer(f, f"__{f}").alias(f) for f in fields], "notes")
