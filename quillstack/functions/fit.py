"""Text that has to fit: widths, greedy line breaks, and the largest size at which a text fits.

A font is a table of widths, in thousandths of its size, by character, with one for all others; it is a parameter,
as no font comes with this library.  Widths are whole numbers, so breaks don't depend on rounding.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, trim_ws

STEP = 0.5  # sizes are tried this far apart


class Font:
    def __init__(self, widths: Mapping[str, int], other: int):
        self.known = F.create_map(*(F.lit(x) for kv in widths.items() for x in kv)) if widths else None
        self.other = other

    def _each(self, text: Column) -> Column:
        """struct(c, w) of each character."""
        width = lambda c: F.coalesce(F.try_element_at(self.known, c), F.lit(self.other)) if self.known is not None else F.lit(self.other)
        chars = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))
        return F.transform(chars, lambda c: F.struct(c.alias("c"), width(c).alias("w")))

    def width(self, text: Column) -> Column:
        """The width of one line, in thousandths of the font's size."""
        return F.aggregate(self._each(text), F.lit(0), lambda a, x: a + x["w"])

    def _chunks(self, word: Column, most: Column) -> Column:
        """array<struct(t, w, whole)>: a word that is too wide cut where it must be, one character at least in each part;
        all parts but the last are lines of their own (whole)."""
        part = lambda t, w, whole: F.struct(t.alias("t"), w.alias("w"), F.lit(whole).alias("whole"))
        none = F.struct(F.lit("").alias("t"), F.lit(0).alias("w"), F.array().cast("array<struct<t:string,w:int,whole:boolean>>").alias("out"))

        def step(a: Column, x: Column) -> Column:
            full = (a["t"] != "") & (a["w"] + x["w"] > most)
            return F.when(full, F.struct(x["c"].alias("t"), x["w"].alias("w"), F.concat(a["out"], F.array(part(a["t"], a["w"], True))).alias("out"))).otherwise(F.struct(F.concat(a["t"], x["c"]).alias("t"), (a["w"] + x["w"]).alias("w"), a["out"].alias("out")))

        cut = F.aggregate(self._each(word), none, step, lambda a: F.concat(a["out"], F.array(part(a["t"], a["w"], False))))
        return let(self.width(word), lambda w: F.when(w <= most, F.array(part(word, w, False))).otherwise(cut))

    def lines(self, text: Column, width: Column, size: Column) -> Column:
        """The lines of a text at a size: each word goes on the line if it fits. Line ends of the text stay,
        and a word that is wider than a line is cut. A blank text has no lines."""
        blank = self.width(F.lit(" "))
        most = width * 1000 / size

        def paragraph(p: Column) -> Column:
            parts = F.flatten(F.transform(F.split(p, " "), lambda w: self._chunks(w, most)))
            none = F.struct(F.lit("").alias("t"), F.lit(0).alias("w"), F.array().cast("array<string>").alias("out"))
            line = lambda t, w, out: F.struct(t.alias("t"), w.cast("int").alias("w"), out.alias("out"))
            closed = lambda a: F.when(a["t"] != "", F.concat(a["out"], F.array(a["t"]))).otherwise(a["out"])

            def step(a: Column, x: Column) -> Column:
                whole = line(F.lit(""), F.lit(0), F.concat(closed(a), F.array(x["t"])))
                fresh = line(x["t"], x["w"], closed(a))
                longer = line(F.concat(a["t"], F.lit(" "), x["t"]), a["w"] + blank + x["w"], a["out"])
                return F.when(x["whole"], whole).when((a["t"] == "") | (a["w"] + blank + x["w"] > most), fresh).otherwise(longer)

            return F.when(p == "", F.array(F.lit(""))).otherwise(F.aggregate(parts, none, step, closed))

        return let(trim_ws(text), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.flatten(F.transform(F.split(t, "\n"), paragraph))))

    def one_line_size(self, text: Column, width: Column, preferred: float, least: float) -> Column:
        """The preferred size less as many steps as make the text fit on one line, not further than to the least size."""
        most_steps = F.lit(max(0.0, -(-(preferred - least) // STEP)))
        need = let(self.width(trim_ws(text)), lambda w: F.when(w > 0, F.ceil((preferred - width * 1000 / w) / STEP)).otherwise(0))
        return F.lit(preferred) - F.greatest(F.lit(0.0), F.least(need.cast("double"), most_steps)) * STEP

    def wrapped_size(self, text: Column, width: Column, preferred: float, least: float, most_lines: int) -> Column:
        """The largest size, from the preferred one down, at which the text has at most so many lines, else the least."""
        steps = int(max(0.0, -(-(preferred - least) // STEP)))
        tried = F.array(*(F.lit(preferred - i * STEP) for i in range(steps)), F.lit(float(least)))
        fits = lambda s: F.size(self.lines(text, width, s)) <= most_lines
        # later sizes aren't looked at once one fits
        return F.coalesce(F.aggregate(tried, F.lit(None).cast("double"), lambda a, s: F.when(a.isNotNull(), a).when(fits(s), s)), F.lit(float(least)))
