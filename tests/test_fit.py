"""Line breaks and sizes against loops that follow the definition."""

import random

from pyspark.sql import functions as F

from quillstack.functions.fit import Font

WIDTHS = {"i": 200, "m": 900, " ": 250}


def wide(t):
    return sum(WIDTHS.get(c, 500) for c in t)


def broken(text, width, size):
    fits = lambda t: wide(t) * size <= width * 1000
    out = []
    for p in text.strip(" \t\n\r").split("\n") if text.strip() else []:
        line = ""
        for word in p.split(" "):
            while not fits(word) and len(word) > 1:
                k = 1
                while k < len(word) and fits(word[: k + 1]):
                    k += 1
                if line:
                    out.append(line)
                    line = ""
                out.append(word[:k])
                word = word[k:]
            joint = f"{line} {word}" if line else word
            if line and not fits(joint):
                out.append(line)
                line = word
            else:
                line = joint
        if line or not p:
            out.append(line)
    return out


def test_against_loops(spark):
    rng = random.Random(1)
    texts = ["", "  ", "m", "mmmmmmmmmmmmmmmmmm", "a\n\nb", "one  two   three", "é" * 40]
    texts += ["".join(rng.choice("im ab  \n") for _ in range(rng.randint(1, 70))) for _ in range(150)]
    font = Font(WIDTHS, 500)
    frame = spark.createDataFrame([(i, t, rng.choice([5, 20, 33, 60])) for i, t in enumerate(texts)], "id int, t string, w int")
    t, w = F.col("t"), F.col("w")
    got = frame.select("*", font.lines(t, w, F.lit(8.0)).alias("lines"), font.wrapped_size(t, w, 10.0, 5.0, 3).alias("size"), font.one_line_size(t, w, 10.0, 5.0).alias("one")).collect()
    for r in got:
        assert r.lines == broken(r.t, r.w, 8.0), repr(r.t)
        size = 10.0
        while size > 5.0 and len(broken(r.t, r.w, size)) > 3:
            size -= 0.5
        assert r["size"] == size
        one = 10.0
        while one > 5.0 and wide(r.t.strip(" \t\n\r")) * one > r.w * 1000:
            one -= 0.5
        assert r.one == one
