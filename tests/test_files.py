"""File sources and sinks, round trips through a folder."""

import json

import pytest
from pyspark.sql import functions as F

from kerbside.functions import urls
from kerbside.operators import boxes, curation
from kerbside.sources import files


def test_site_documents(spark, tmp_path):
    line = lambda label, *xy: {"label": label, "start": xy[:2], "end": xy[2:], **({"junction_side": "right"} if label == "S" else {})}
    doc = {"site_id": "a-1", "roi_polygon": [[0, 0], [10, 0], [10, 10]], "entry_exit_lines": {"south": line("S", 0.0, 9.0, 9.0, 9.0), "north": line("N", 0.0, 1.0, 9.0, 1.0)}}
    bad = {"site_id": "b", "roi_polygon": [[0, 0]], "entry_exit_lines": {"x": line("L", 0.0, 0.0, 1.0, 1.0), "y": line("L", 0.0, 0.0, 1.0, 1.0)}}
    for d in (doc, bad):
        (tmp_path / f"{d['site_id']}.json").write_text(json.dumps(d, indent=1))
    sites, arms = files.read_sites(spark, str(tmp_path)), files.read_arms(spark, str(tmp_path))
    assert {r.site_id: len(r.roi) for r in sites.collect()} == {"a-1": 3, "b": 1}
    got = [(r.arm_id, r.arm_ord, r.junction_side, r.y1) for r in arms.where("site_id = 'a-1'").orderBy("arm_ord").collect()]
    assert got == [("south", 0, "right", 9.0), ("north", 1, "left", 1.0)]
    assert {(r.site_id, r.reason) for r in files.invalid_sites(sites, arms).collect()} == {("b", "roi"), ("b", "labels")}
    assert [r.site_id for r in files.list_sites(spark, str(tmp_path)).collect()] == ["a-1", "b"]
    assert files.site_path("d", "a-1") == "d/a-1.json"
    with pytest.raises(ValueError):
        files.site_path("d", "../a")


def test_labels_and_predictions(spark, tmp_path):
    own = spark.createDataFrame([("accepted", "s", "f1", 2, 0.5, 0.25, 0.125, 1.0)], "bin string, site string, stem string, class_id int, cx double, cy double, w double, h double")
    files.write_labels(own, f"{tmp_path}/out")
    (tmp_path / "labels/s").mkdir(parents=True)
    (tmp_path / "labels/s/f1.txt").write_text("2 0.500000 0.250000 0.125000 1.000000\n\nbroken line\n1 2 3\n")
    got = files.read_labels(spark, f"{tmp_path}/labels").collect()
    assert [(r.site, r.stem, r.class_id, r.cx, r.h) for r in got] == [("s", "f1", 2, 0.5, 1.0)]
    pred = {"teacher": "t", "site": "s", "stem": "f1", "image_hw": [10, 20], "boxes_xywhn": [[0.5, 0.5, 1, 1]], "confs": [0.9], "class_ids": [2], "inference_ms": 1.0}
    (tmp_path / "p.json").write_text(json.dumps(pred) + "\n" + json.dumps({**pred, "stem": "f2", "boxes_xywhn": [], "confs": [], "class_ids": []}))
    rows = files.read_predictions(spark, f"{tmp_path}/p.json").orderBy("stem").collect()
    assert [(r.stem, r.box, r.confidence) for r in rows] == [("f1", 0, 0.9), ("f2", None, None)]
    (tmp_path / "names.txt").write_text("car\n\ntruck\n")
    assert [tuple(r) for r in files.read_class_names(spark, f"{tmp_path}/names.txt").collect()] == [(0, "car"), (1, "truck")]
    files.write_manifest(spark.range(1), f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m").columns == ["generated_at", "id"]


def test_parsing_functions(spark):
    one = spark.createDataFrame([("1.5GiB", "12.5%", "https://youtu.be/x?y", "/d/video.01.mp4", " Big PICKUP ")], "m string, p string, u string, f string, l string")
    got = one.select(
        urls.megabytes(F.col("m")), urls.percent(F.col("p")), urls.kind(F.col("u")), urls.stem(F.col("f")), curation.keyword_class(F.col("l")), urls.kind(F.col("f"))
    ).first()
    assert tuple(got) == (1536.0, 12.5, "video", "video.01", "truck", "file")


def test_box_round_trip_and_agreement_ties(spark):
    own = spark.createDataFrame([(0.5, 0.5, 0.2, 0.4)], "cx double, cy double, w double, h double")
    got = boxes.to_normalised(boxes.to_corners(own, 200, 100), 200, 100).first()
    assert [round(got[k], 9) for k in ("ncx", "ncy", "nw", "nh")] == [0.5, 0.5, 0.2, 0.4]
    box = lambda *rows: spark.createDataFrame([("s", 1, i, *map(float, b)) for i, b in rows], "site string, pic int, box int, x1 double, y1 double, x2 double, y2 double")
    same = (0, 0, 10, 10)
    pairs = boxes.agreement(box((0, same), (1, same)), box((0, same), (1, same), (2, (50, 50, 60, 60))), ["site", "pic"]).collect()
    assert sorted((r.box_a, r.box_b) for r in pairs) == [(0, 0), (1, 1)]


def test_histogram_bounds(spark):
    rows = spark.createDataFrame([(-1.0,), (0.0,), (50.0,), (490.0,), (491.0,)], "v double")
    assert [r.n for r in curation.histogram(rows, "v").orderBy("bucket").collect()] == [1, 1, 0, 0, 0, 1]


def test_label_values_round_as_six_places_of_the_exact_value(spark):
    import random

    rng = random.Random(1)
    values = [3 / 1920, 0.0000005, 0.1234565, 0.9999995, 1.0, 0.0, *[k / 1920 for k in range(0, 1920, 3)], *[rng.random() for _ in range(500)]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    from kerbside.operators import curation

    got = [r.line for r in df.select(curation.label_line(F.lit(2), *[F.col("v")] * 4).alias("line")).collect()]
    assert got == ["2 " + " ".join([f"{v:.6f}"] * 4) for v in values]


def test_catalog_names_all_missing_videos(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "videos").mkdir()
    for name in ("a.mp4", "b c.mp4"):
        (tmp_path / "videos" / name).write_bytes(b"x")
    catalog = tmp_path / "sites.yaml"
    catalog.write_text("sites:\n  north:\n    display_name: 'North & East'\n    videos: [a.mp4, b c.mp4]\n  south:\n    display_name: South\n    videos:\n      - a.mp4\n")
    found = files.read_catalog(spark, str(catalog), str(tmp_path / "videos"))
    assert sorted((r.site, r.display_name, r.video) for r in found.collect()) == [("north", "North & East", "a.mp4"), ("north", "North & East", "b c.mp4"), ("south", "South", "a.mp4")]
    catalog.write_text("sites:\n  north:\n    display_name: N\n    videos: [x.mp4, a.mp4]\n  south:\n    display_name: S\n    videos: [y.mp4]\n")
    with pytest.raises(FileNotFoundError, match=r"north: x.mp4\n  south: y.mp4"):
        files.read_catalog(spark, str(catalog), str(tmp_path / "videos"))


def test_written_labels_take_no_file_for_each_frame(spark, tmp_path):
    import glob

    own = spark.range(300, numPartitions=3).select(
        F.when(F.col("id") % 3 == 0, "accepted").otherwise("flagged").alias("bin"), F.format_string("%03d", F.col("id") % 7).alias("site"), F.format_string("0%d", "id").alias("stem"),
        F.lit(2).alias("class_id"), *[(F.col("id") / 300).alias(c) for c in ("cx", "cy", "w", "h")])
    files.write_labels(own, f"{tmp_path}/out")
    assert len(glob.glob(f"{tmp_path}/out/**/part-*", recursive=True)) <= 6
    sides = {b: files.read_written_labels(spark, f"{tmp_path}/out", b).collect() for b in ("accepted", "flagged", "none")}
    assert {b: len(s) for b, s in sides.items()} == {"accepted": 100, "flagged": 200, "none": 0}
    # names that look like numbers stay as they are
    assert {(r.site, r.stem, r.class_id, r.cx) for s in sides.values() for r in s} == {(f"{k % 7:03d}", f"0{k}", 2, round(k / 300, 6)) for k in range(300)}


def test_written_sites_and_predictions_take_no_file_for_each_site(spark, tmp_path):
    import glob

    line = lambda label: F.struct(F.lit(label).alias("label"), F.array(F.lit(0.0), F.col("id") * 1.0).alias("start"), F.array(F.lit(9.0), F.lit(9.0)).alias("end"), F.lit("right").alias("junction_side"))
    corners = F.array(*[F.array(F.lit(float(x)), F.lit(1.0)) for x in range(3)])
    sites = spark.range(200, numPartitions=3).select(
        F.when(F.col("id") == 7, "../out").otherwise(F.format_string("0%d", "id")).alias("site_id"), corners.alias("roi"), F.create_map(F.lit("s"), line("S"), F.lit("n"), line("N")).alias("lines"))
    files.write_sites(sites, f"{tmp_path}/sites")
    want = {f"0{k}" for k in range(200) if k != 7}
    assert len(glob.glob(f"{tmp_path}/sites/**/part-*", recursive=True)) <= 3
    listed, read, arms = (f(spark, f"{tmp_path}/sites", files.WRITTEN) for f in (files.list_sites, files.read_sites, files.read_arms))
    assert [r.site_id for r in listed.collect()] == sorted(want)
    assert {r.site_id: len(r.roi) for r in read.collect()} == dict.fromkeys(want, 3)
    assert {(r.site_id, r.arm_id, r.arm_ord, r.y1) for r in arms.collect()} == {(s, a, k, float(s)) for s in want for k, a in enumerate("sn")}
    shape = "teacher string, site string, stem string, box long, cx double, cy double, w double, h double, confidence double, class_id int"
    frames = [("t", f"0{k}", f"f{n}", *((n, 0.5, 0.5, 0.1, 0.1, 0.9, 2) if n else (None,) * 7)) for k in range(100) for n in range(2)]
    files.write_predictions(spark.createDataFrame(frames, shape), f"{tmp_path}/predictions")
    assert len(glob.glob(f"{tmp_path}/predictions/**/part-*", recursive=True)) <= 4
    found = files.read_predictions(spark, f"{tmp_path}/predictions").collect()
    assert {(r.teacher, r.site, r.stem, r.cx) for r in found} == {f[:3] + (f[4],) for f in frames} and len(found) == 200
