"""The jobs: as queries against SQL, over growing input, in parts, after a crash, and from the command line."""

from __future__ import annotations

import glob
import os
import shutil
import subprocess
import sys

import pytest
from conftest import ROOT, SF, compared
from pyspark.sql import functions as F

from jobs import common, registry, slice_report, upload_registry
from meshlake.streaming import uploads


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_job_matches_its_sql(spark, duck, name):
    before = dict(spark.conf.getAll)
    compared(spark, duck, registry.QUERIES[name], registry.ORACLES[name])
    assert dict(spark.conf.getAll) == before


def rows(df):
    return sorted(map(str, df.collect()))


def test_slices_of_some_bands_replace_only_these(spark, tmp_path):
    parts, out = f"{SF}/part.parquet", str(tmp_path / "out")
    slice_report.run(spark, parts, out)
    whole, cuts = rows(spark.read.parquet(f"{out}/report")), rows(spark.read.parquet(f"{out}/segments"))
    kept = {f for f in glob.glob(f"{out}/*/band=*/*.parquet") if "band=1" not in f}
    assert kept and len(whole) > 1
    slice_report.run(spark, parts, out, bands=[1])
    assert rows(spark.read.parquet(f"{out}/report")) == whole and rows(spark.read.parquet(f"{out}/segments")) == cuts
    assert {f for f in glob.glob(f"{out}/*/band=*/*.parquet") if "band=1" not in f} == kept
    slice_report.run(spark, parts, out, slice_report.Settings(layer_height=20.0, layers_per_band=1))  # another height: nothing old stays
    assert {r.z % 20 for r in spark.read.parquet(f"{out}/report").select("z").collect()} == {spark.read.parquet(f"{out}/report").agg(F.min("z")).first()[0] % 20}


def test_report_of_a_cube_and_of_nothing(spark):
    """A unit cube's side walls at half height: a square of area 1, length 4, watertight; without one wall it has two open ends."""
    columns = "band int, layer long, object_id long, tri_id long, z double, x1 double, y1 double, x2 double, y2 double"
    square = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]  # clockwise: outside is on the left of none of them
    sides = [(0, 0, 1, k, 0.5, *square[k], *square[(k + 1) % 4]) for k in range(4)]
    cut = slice_report.report(spark.createDataFrame(sides, columns), 6).first()
    assert (cut.n_segments, cut.cut_length, abs(cut.area), cut.open_ends) == (4, 4.0, 1.0, 0)
    assert slice_report.report(spark.createDataFrame(sides[:3], columns), 6).first().open_ends == 2
    assert slice_report.report(spark.createDataFrame([], columns), 6).count() == 0


def grown(spark, folder, k, data):
    made = f"{folder}/made-{k}"
    spark.createDataFrame(data, "doc_id long, source string, text string, url string").coalesce(1).write.parquet(made)
    os.makedirs(f"{folder}/table", exist_ok=True)
    shutil.copy(glob.glob(f"{made}/*.parquet")[0], f"{folder}/table/{k}.parquet")


def test_uploads_over_growing_input(spark, tmp_path):
    source, out, mark = f"{tmp_path}/table", f"{tmp_path}/out", f"{tmp_path}/mark"
    run = lambda: upload_registry.run(spark, source, out, mark)
    found = lambda: {(r.upload_id, r.batch): (r.status, r.first_id) for r in uploads.records(spark, out).collect()}
    grown(spark, tmp_path, 0, [(10, "a/b.TXT?x=1", "same", "u"), (9, "c", "same", "u"), (11, "d", None, "u"), (12, "e", "", "u"), (13, "f", "own", "u")])
    run()
    first = {("10", 0): ("known", "9"), ("9", 0): ("new", "9"), ("11", 0): ("rejected", None), ("12", 0): ("rejected", None), ("13", 0): ("new", "13")}
    assert found() == first
    assert {(r.upload_id, r.name, r.format, r.reason) for r in uploads.records(spark, out).where("upload_id < 13 AND upload_id <> '9'").collect()} == {("10", "b.TXT", "txt", None), ("11", "d", "", "no content"), ("12", "e", "", "empty")}
    run()
    assert found() == first  # nothing new
    grown(spark, tmp_path, 1, [(1, "z", "same", "u"), (2, "y", "fresh", "u"), (3, "y", "fresh", "u"), (4, "w", "", "u")])
    run()
    second = first | {("1", 1): ("known", "9"), ("2", 1): ("new", "2"), ("3", 1): ("known", "2"), ("4", 1): ("rejected", None)}
    assert found() == second
    for name in ("1", ".1.crc"):  # as if the job had died after its output
        os.remove(f"{mark}/commits/{name}")
    run()
    assert found() == second and uploads.records(spark, out).count() == 9


def test_records_of_odd_batches(spark):
    schema = "id long, path string, body string, status string"
    batch = spark.createDataFrame([(None, None, "x", "s"), (None, None, "x", "s"), (5, "p", "y", "s"), (5, "p", "y", "s"), (5, None, "y", "s"), (6, "a.b", "z" * 100, "s"), (7, "a.amf", "z", "s"), (8, "q.amf", "q", "s")], schema)
    told = uploads.described(batch, "id", "path", "body", ["AMF", ""], 50)
    earlier = spark.createDataFrame([(r.content_hash, "old") for r in told.where("upload_id = '8'").collect()], "content_hash string, first_id string")
    got = sorted((r.upload_id or "", r.status, r.reason or "", r.first_id or "") for r in uploads.recorded(told, earlier).collect())
    assert got == [("", "known", "", ""), ("", "new", "", ""), ("5", "known", "", "5"), ("5", "known", "", "5"), ("5", "new", "", "5"), ("6", "rejected", "format: b", ""), ("7", "new", "", "7"), ("8", "known", "", "old")]
    assert uploads.recorded(told.limit(0), earlier).count() == 0


def test_a_drop_folder_across_restarts(spark, tmp_path):
    """The same content under two names, in two runs; another format."""
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    put = lambda name, text: (inbox / name).write_text(text)
    put("one.amf", "<amf/>")
    put("note.doc", "<amf/>")
    run = lambda: uploads.stream(uploads.folder(spark, str(inbox)), f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination()
    run()
    put("two.AMF", "<amf/>")
    put("three.amf", "<amf></amf>")
    run()
    assert {r.name: (r.status, r.batch) for r in uploads.records(spark, f"{tmp_path}/out").collect()} == {"one.amf": ("new", 0), "note.doc": ("rejected", 0), "two.AMF": ("known", 1), "three.amf": ("new", 1)}


def test_settings(tmp_path):
    assert common.settings(slice_report.Settings, None, "slice_report") == slice_report.Settings()
    assert common.settings(upload_registry.Settings, None, "upload_registry") == upload_registry.Settings()
    for text in ("layer_heigth = 1.0", 'layer_height = "7"', "layer_height = 0.0"):
        (tmp_path / "c.toml").write_text(text)
        with pytest.raises(ValueError):
            common.settings(slice_report.Settings, str(tmp_path / "c.toml"), "slice_report")
    (tmp_path / "c.toml").write_text("layer_height = 5\n")
    assert common.settings(slice_report.Settings, str(tmp_path / "c.toml"), "slice_report").layer_height == 5.0


def test_command_line(spark, tmp_path):
    out = f"{tmp_path}/out"
    done = subprocess.run([sys.executable, "-m", "jobs.slice_report", "--parts", f"{SF}/part.parquet", "--output", out], cwd=ROOT, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "wrote" in done.stderr and "open ends" in done.stderr
    assert spark.read.parquet(f"{out}/report").count() > 0
