import json

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstack.functions import address as A
from quillstack.functions import text as T
from quillstack.operators import expand, layout, marks, raster, resolve, restore, sync
from quillstack.plans.hamming_join import hamming_pairs
from quillstack.plans.prefix_join import prefix_join
from quillstack.sources import sinks
from quillstack.sources import tables as S
from quillstack.streaming import latest as L


def rows(frame):
    return sorted(map(repr, map(tuple, frame.collect())))


def test_sync_is_idempotent_and_never_resurrects(spark):
    now = F.lit("2024-01-09").cast("timestamp_ntz")
    day = lambda d: F.lit(f"2024-01-0{d}").cast("timestamp_ntz")
    local = spark.createDataFrame([(" Ann ",), ("ann",), ("Bob",), ("",), (None,), ("Gone",)], "name string")
    remote = spark.createDataFrame([("Cy", 3), ("GONE", 4), ("Di", 3)], "name string, d int").select("name", F.when(F.col("d") == 3, day(3)).otherwise(day(4)).alias("last_used_at"))
    dead = spark.createDataFrame([("gone",)], "name_key string")
    once = sync.sync_names(local, remote, dead, now)
    assert [r.name_key for r in once.orderBy("position").collect()] == ["ann", "bob", "cy", "di"]
    twice = sync.sync_names(local, once.select("name", "last_used_at"), dead, now)
    assert rows(twice) == rows(once)


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.integers(0, 5), st.tuples(st.integers(0, 3), st.sampled_from("ab")), max_size=5), st.dictionaries(st.integers(0, 5), st.tuples(st.integers(0, 3), st.sampled_from("xy")), max_size=5))
def test_last_writer_laws(spark, a, b):
    table = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()], "k int, updated_at int, v string")
    got = {r.k: (r.updated_at, r.v, r.push) for r in sync.last_writer(table(a), table(b), "k").collect()}
    want = {}
    for k in a.keys() | b.keys():
        mine = k in a and (k not in b or a[k][0] > b[k][0])
        want[k] = (*(a[k] if mine else b[k]), mine)
    assert got == want


def test_upsert_keeps_missing_columns(spark):
    t = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, v string, w int")
    n = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert rows(sync.upsert(t, n, "k")) == ["(1, 'a', 5)", "(2, 'B', 6)", "(3, 'C', None)"]
    assert rows(sync.upsert(sync.upsert(t, n, "k"), n, "k")) == rows(sync.upsert(t, n, "k"))


def test_collapse_is_idempotent_and_merges(spark):
    schema = "address_key string, ship_to_name string, address string, carrier string, account_numbers string, last_used_at int"
    book = spark.createDataFrame(
        [("a", "Zed Ltd", "5 Oak St", "Fast", "A1", 5), ("b", "zed", "5 Oak Street, Calgary AB", "FAST", "", 9), ("c", "", "5 oak st", "fast", "a 1; B2", 7), ("d", "Zed", "5 Oak St", "Fast", "A1", 8), ("e", "Zed", "", "Fast", "A1", 8)], schema
    )
    got = resolve.collapse(book)
    assert rows(got.select("ship_to_name", "address", "account_numbers", "last_used_at", "rows")) == sorted(["('zed', '5 Oak Street, Calgary AB', 'A1', 9, 3)", "('', '5 oak st', 'a 1, B2', 7, 1)"])
    again = resolve.collapse(got.drop("rows"))
    assert rows(again.drop("rows")) == rows(got.drop("rows"))


def test_keys(spark):
    one = lambda c, *v: [r[0] for r in spark.createDataFrame([(x,) for x in v], "x string").select(c).collect()]
    assert one(T.trim_ws("x"), "\t a\n", " b　", None) == ["a", "b", ""]
    assert one(T.number_or_zero("x"), "1,200", "", None, "NaN", "x", " 7.5 ") == [1200.0, 0.0, 0.0, 0.0, 0.0, 7.5]
    assert one(A.row_key("x", F.lit(" Fast  Co "), F.lit("A 1")), "5 Oak St", "") == ["5 oak st::fast co::a1", ""]
    assert one(A.formatted(A.filled(A.parts("x"), A.parts(F.lit("?, Calgary, AB T2P 1A1")))), "5 Oak St, Calgary", "9 Elm Rd") == ["5 Oak St, Calgary, AB T2P1A1", "9 Elm Rd, Calgary, AB T2P1A1"]
    assert one(T.json_in_text("x"), '```json\n{"a": 1}\n```', "none") == ['{"a": 1}', ""]
    assert one(F.array_join(T.company_tokens("x"), " "), "Zed Yards Ltd.") == ["zed yards zedyards"]
    assert one(F.size(T.search_queries("x", F.lit("zed.example"))), "Zed") == [4]


def test_blocked_joins_equal_the_plain_ones(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63 - 1, 12)
    hashes = [int(b) ^ int(sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 14), replace=False))) for b in base for _ in range(8)]
    h = spark.createDataFrame(list(enumerate(hashes)), "id int, h long")
    got = {(r.a, r.b, r.distance) for r in hamming_pairs(h, "id", "h", 10).collect()}
    dist = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    assert got == {(i, j, dist(x, y)) for i, x in enumerate(hashes) for j, y in enumerate(hashes) if i < j and dist(x, y) <= 10}
    near = {(r.a, r.b) for r in hamming_pairs(h, "id", "h", 3).collect()}
    assert near == {(i, j) for i, j, d in got if d <= 3}
    names = ["ab", "abc", "abcd", "abd", "", "a", "ab", "xyz", "xy"]
    k = spark.createDataFrame([(n,) for n in names], "a string")
    pairs = sorted((r.a, r.b) for r in prefix_join(k, k.withColumnRenamed("a", "b"), "a", "b").collect())
    loose = lambda a, b: a and b and (a == b or min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a)))
    assert pairs == sorted((a, b) for a in names for b in names if loose(a, b))


def test_pages_and_layout(spark):
    plans = spark.createDataFrame([(1, 2, 1, False), (2, 0, 0, False), (3, 5, 5, True), (4, None, 1, None)], "so int, pallet_crates int, boxes int, is_undetermined boolean")
    assert rows(expand.piece_pages(plans).select("so", "page", "pages", "unit")) == sorted(["(1, 1, 3, 'pallet')", "(1, 2, 3, 'pallet')", "(1, 3, 3, 'box')", "(2, 0, 0, '')", "(3, 0, 0, '')", "(4, 1, 1, 'box')"])
    items = spark.createDataFrame([("r", 50.0, 1.0), ("r", 70.0, 1.0)], "row string, width double, scale double")
    assert [round(r.shown, 3) for r in layout.scaled(items, "row", 100.0, 10.0).orderBy("width").collect()] == [37.5, 52.5]
    assert layout.shrink(items, "row", 100.0, 10.0).first().factor == 0.75


def test_arrays_per_image(spark):
    mask = np.zeros((12, 16), bool)
    mask[1:4, 1:4] = mask[6:10, 5:14] = True
    mask[4, 4] = True
    assert len(np.unique(raster.labelled(mask))) - 1 == 3 and len(np.unique(raster.labelled(mask, True))) - 1 == 2
    spiral = np.zeros((9, 9), bool)
    spiral[0, :] = spiral[:, 8] = spiral[8, :] = spiral[2:9, 0] = spiral[2, 0:7] = spiral[2:7, 6] = True
    assert len(np.unique(raster.labelled(spiral))) - 1 == 1
    bone = raster.skeleton(mask)
    assert bone.sum() < mask.sum() and (bone <= mask).all()
    g = np.zeros((20, 20, 4), np.int32)
    g[..., :3], g[..., 3] = 250, 255
    g[5:15, 5:15, :3] = [200, 10, 10]
    clear = raster.without_background(g)
    assert (clear[5:15, 5:15, 3] == 255).all() and clear[..., 3].sum() == 100 * 255
    clear[0:2, 0:1, :3], clear[0:2, 0:1, 3] = 5, 255
    assert raster.without_corner_marks(clear)[..., 3].sum() == 100 * 255
    g[7, 7, :3] = [198, 12, 9]
    assert (raster.flattened(g)[7, 7, :3] == [200, 10, 10]).all()
    y, x = np.indices((20, 20)).reshape(2, -1)
    table = spark.createDataFrame([("a", int(i), int(j), *map(int, g[j, i])) for i, j in zip(x, y, strict=True)], raster.PIXEL)
    assert raster.per_image(table, raster.without_background).filter("a > 0").count() == 100
    assert raster.background(table).first().br == 250
    assert raster.rim_punched(table).count() == 400 and raster.signature_ink(table).count() == 100
    assert raster.cropped(table, 0.25, 0.25, 0.5, 0.5).count() == 100
    assert 355 < raster.hue_anchor(table).first().hue or raster.hue_anchor(table).first().hue < 5


def test_mark_cleanup_against_brute_force(spark):
    """Clusters by mark or name, greedy versions and the keeper of each, as a loop over all files would have them."""
    rng = np.random.default_rng(6)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 8)]
    rows = []
    for i in range(60):
        k = int(rng.integers(0, 8))
        h = base[k] ^ int(sum(1 << int(j) for j in rng.choice(63, rng.integers(0, 9), replace=False)))
        name = f"{rng.choice(['Mark', 'old', 'X'])}{k if rng.random() < 0.5 else 100 + i}{rng.choice(['.png', '(2).png', '_restored.png', ' copy.png'])}"
        rows.append((i, h, 1 + k / 8 + float(rng.choice([0, 0.1, 0.6])), int(rng.integers(50, 90)), int(rng.choice([100, 110, 160])), 100, 1000, name))
    frame = spark.createDataFrame(rows, "id long, h long, aspect double, ink int, width int, height int, bytes int, name string")
    bits = lambda a, b: ((a[1] ^ b[1]) & (2**64 - 1)).bit_count()
    gap = lambda a, b: abs(a - b) / max(a, b)
    stem = {r.id: r.stem for r in frame.select("id", T.file_stem("name").alias("stem")).collect()}
    score = {r.id: r.s for r in frame.select("id", restore.keep_score(F.col("name"), F.col("ink"), F.col("width"), F.col("height"), F.lit(False)).alias("s")).collect()}
    root = list(range(60))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in rows:
        for b in rows[: a[0]]:
            s, t = stem[a[0]], stem[b[0]]
            named = s and t and (s == t or min(len(s), len(t)) >= 4 and (s in t or t in s))
            if named or bits(a, b) <= 10 and gap(a[2], b[2]) <= 0.22 and gap(a[3], b[3]) <= 0.55:
                x, y = find(a[0]), find(b[0])
                root[max(x, y)] = min(x, y)
    want = {}
    for r in range(60):
        own = [row for row in rows if find(row[0]) == r]
        seeds = []
        for row in own:
            if all(bits(row, s) > 10 or gap(row[2], s[2]) > 0.28 or gap(row[4] / row[5], s[4] / s[5]) > 0.18 or gap(row[3], s[3]) > 0.28 for s in seeds):
                seeds.append(row)
        groups = {}
        for row in own:
            groups.setdefault(min(range(len(seeds)), key=lambda i: (bits(row, seeds[i]), i)), []).append(row[0])
        for ids in groups.values():
            keep = min(ids, key=lambda i: (-score[i], i))
            want |= {i: keep for i in ids if i != keep}
    assert {r.id: r.cluster for r in marks.clusters(frame).collect()} == {i: find(i) for i in range(60)}
    assert {r.id: r.keep for r in marks.cleanup(frame).collect()} == want


def test_files(spark, tmp_path):
    presets = {"bol::Zed": {"fields": {"a": "1"}, "logos": ["x.png"]}, "Old": {"fields": {}, "logo": "y.png"}}
    (tmp_path / "presets.json").write_text(json.dumps(presets, indent=1))
    assert rows(S.presets_file(spark, str(tmp_path / "presets.json")).select("kind", "name", F.array_join("logos", ","))) == ["('bol', 'Zed', 'x.png')", "('shipping', 'Old', 'y.png')"]
    (tmp_path / "names.json").write_text('[" Ann", "ann", "", "Bo"]')
    assert [r.name for r in S.list_file(spark, str(tmp_path / "names.json")).collect()] == ["Ann", "Bo"]
    (tmp_path / "store/bol/7").mkdir(parents=True)
    (tmp_path / "store/bol/7/form.json").write_text("{}")
    (tmp_path / "store/bol/7/a.png").write_bytes(b"123")
    assert rows(S.stored_objects(spark, str(tmp_path / "store"))) == ["('bol', '7', 'a.png', 3)", "('bol', '7', 'form.json', 2)"]
    assert S.images(spark, str(tmp_path / "store")).count() == 1
    cases = spark.createDataFrame([("r", "c1", True, 0.5)], "run_id string, case_id string, ok boolean, composite double")
    for _ in range(2):
        sinks.append_log(cases, str(tmp_path / "log"))
    assert S.run_log(spark, str(tmp_path / "log")).filter("ok and composite = 0.5").count() == 2
    assert sinks.map_json(spark.createDataFrame([("b", "2"), ("a", "1")], "k string, v string"), "k", "v").first().json == '{"a":"1","b":"2"}'
    sinks.snapshot(cases, str(tmp_path / "snap"), "run_id")
    sinks.csv(cases, str(tmp_path / "csv"))
    assert S.parquet(spark, str(tmp_path / "snap"), "case_id").count() == 1 and spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 1


def test_payloads(spark):
    one = spark.range(1)
    feed = F.lit('{"tag_name": "v1", "assets": [{"name": "App-Setup.exe", "browser_download_url": "u"}, {"name": "a.apk", "browser_download_url": "w"}]}')
    assert [tuple(x) for x in one.select(S.release_assets(feed)).first()[0]] == [("v1", "App-Setup.exe", "u", "installer"), ("v1", "a.apk", "w", "android")]
    hits = F.lit('[{"display_name": "d", "address": {"house_number": "5", "road": "Oak", "town": "T", "postcode": "P"}}]')
    assert [tuple(x) for x in one.select(S.geocoder_hits(hits)).first()[0]] == [(0, "5 Oak", "T", "", "P", "d")]


def test_stream_keeps_the_latest(spark, tmp_path, small):
    events = spark.read.parquet(f"{small}/events.parquet").select("user_id", "ts", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    done = []

    def write(frame, number):
        frame.write.mode("overwrite").parquet(str(tmp_path / f"out/{number}"))
        done.append(number)

    read = lambda: spark.read.parquet(str(tmp_path / f"out/{done[-1]}")) if done else None
    L.latest_into(stream, ["user_id"], "ts", read, write, str(tmp_path / "cp")).awaitTermination()
    assert len(done) == 3
    assert rows(read()) == rows(sync.latest_per_key(events, "user_id", "ts", "value").select("user_id", "ts", "value"))


def test_daily_gate(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    r = spark.range(1).select(L.due_daily(ts("2024-01-02 23:00"), ts("2024-01-01 23:00")), L.due_daily(ts("2024-01-02 20:00"), ts("2024-01-01 23:00")), L.due_daily(ts("2024-01-02 23:30"), ts("2024-01-02 22:30")), L.due_daily(ts("2024-01-02 23:30"), F.lit(None).cast("timestamp"))).first()
    assert tuple(r) == (True, False, False, True)


def test_png_files(spark, tmp_path):
    import struct
    import zlib

    from quillstack.sources import png

    rng = np.random.default_rng(1)
    g = rng.integers(0, 256, (7, 5, 4)).astype(np.int32)
    assert (png.decode(png.encode(g)) == g).all() and png.decode(b"no") is None
    raw = g.astype(np.uint8)
    lines = []
    for y in range(7):  # every filter of the format
        how = y % 5
        line = bytearray([how])
        for x in range(5):
            for c in range(4):
                left = int(raw[y, x - 1, c]) if x else 0
                up = int(raw[y - 1, x, c]) if y else 0
                corner = int(raw[y - 1, x - 1, c]) if x and y else 0
                p = left + up - corner
                paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                line.append((int(raw[y, x, c]) - (0, left, up, (left + up) // 2, paeth)[how]) % 256)
        lines.append(bytes(line))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 7, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert (png.decode(data) == g).all()
    (tmp_path / "a.png").write_bytes(data)
    (tmp_path / "b.png").write_bytes(b"broken")
    table = png.pixels(S.images(spark, str(tmp_path)))
    assert table.count() == 35 and table.agg(F.sum("r")).first()[0] == int(g[..., 0].sum())


def test_arrays_resized_layered_and_outlined():
    g = np.zeros((8, 8, 4), np.int32)
    g[2:6, 2:6] = [200, 0, 0, 255]
    g[3:5, 3:5] = [250, 250, 250, 255]
    half = raster.resized(g, 4, 4)
    assert half.shape == (4, 4, 4) and half[0, 0, 3] == 0 and half[1, 1, 3] == 255 and half[1, 1, 0] > 200
    assert raster.resized(g, 8, 8) is g
    centres, label = raster.colour_layers(g, 2)
    assert sorted(centres[:, 1].round().tolist()) == [0, 250] and (label[g[..., 3] == 0] == -1).all()
    ring = raster.outlined(g, 1, (1, 2, 3))
    assert (ring[1, 1] == [1, 2, 3, 255]).all() and (ring[2:6, 2:6] == g[2:6, 2:6]).all() and (ring[..., 3] > 0).sum() == 36
    assert raster.holes_punched(g)[3, 3, 3] == 0 and raster.holes_punched(g)[2, 2, 3] == 255
    plate = np.full((20, 20, 4), 255, np.int32)
    plate[5:15, 5:15, 1:3] = 0
    plate[8:12, 8:12, 1:3] = 255
    seen = raster.visible(plate)
    assert seen.shape == (10, 10, 4) and seen[0, 0, 3] == 255 and seen[5, 5, 3] == 0


def test_edges_outlines_and_remnants(spark):
    g = np.zeros((12, 12, 4), np.int32)
    g[2:10, 2:10] = [200, 30, 30, 255]
    g[2, 2:10] = [10, 10, 10, 255]
    g[5, 9] = [90, 90, 90, 120]
    y, x = np.indices((12, 12)).reshape(2, -1)
    table = spark.createDataFrame([("a", int(i), int(j), *map(int, g[j, i])) for i, j in zip(x, y, strict=True)], raster.PIXEL)
    soft = raster.hardened(table).filter("x = 9 and y = 5").first()
    assert (soft.r, soft.g, soft.b, soft.a) == (200, 30, 30, 255)
    line = raster.outline_colour(table).first()
    assert (line.r, line.g, line.b) == (10, 10, 10)
    plate = np.full((16, 16, 4), 255, np.int32)
    plate[6:10, 6:10, :3] = 0
    kept = raster.without_remnants(plate, (255, 255, 255))
    assert kept[0, 0, 3] == 0 and kept[5, 5, 3] == 255 and kept[7, 7, 3] == 255 and kept[2, 2, 3] == 0
    y, x = np.indices((16, 16)).reshape(2, -1)
    white = spark.createDataFrame([("p", int(i), int(j), *map(int, plate[j, i])) for i, j in zip(x, y, strict=True)], raster.PIXEL)
    assert raster.protected(white, raster.background(white)).count() == 16
