"""Folders of images written here, through catalog, decoding, hashing, scores, verdicts, manifest and copies."""

import functools
import struct
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluicebox.operators import video
from sluicebox.plans import curation
from sluicebox.sources import frames, media, sinks


def png(path, rgb):
    h, w = rgb.shape[:2]
    gray = rgb.ndim == 2
    raw = b"".join(b"\0" + row.tobytes() for row in rgb.astype(np.uint8))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if gray else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("frames")
    rng = np.random.default_rng(0)
    scenes = [np.kron(rng.integers(0, 256, (8, 8, 3)), np.ones((8, 8, 1))) for _ in range(9)]
    for i, scene in enumerate(scenes):
        png(out / f"shot_{i * 2 + 1}.png", scene)
        png(out / f"shot_{i * 2 + 2}.png", np.clip(scene + rng.integers(-2, 3, scene.shape), 0, 255))
    png(out / "shot_100.PNG", np.full((64, 64), 90))
    (out / "shot_5000.jpg").write_bytes(b"not an image")
    (out / "notes.txt").write_text("x")
    (out / "sub").mkdir()
    png(out / "sub" / "deep.png", scenes[0])
    return out


def test_catalog_and_pixels(spark, folder):
    got = media.image_catalog(spark, str(folder), batch=8).orderBy("idx").collect()
    assert [r.name for r in got] == [f"shot_{i}.png" for i in range(1, 19)] + ["shot_100.PNG", "shot_5000.jpg"]
    assert [r.batch for r in got] == [i // 8 for i in range(20)]
    assert media.training_catalog(spark, str(folder)).count() == 21
    png(folder / "sub" / "rgb.png", np.array([[[200, 100, 7]]]))
    row = media.images(spark, str(folder / "sub")).filter("height = 1").first()
    assert list(row.data) == [7, 100, 200]
    (folder / "sub" / "rgb.png").unlink()


def test_listings(spark, tmp_path, monkeypatch):
    """What Spark's reader of files finds, without an entry for every file on the driver."""
    names = ["a b.jpg", "100%.png", "ü.JPG", "_x.jpg", ".x.jpg", "_k=1.jpg", "_metadata.jpg", "x.jpg._COPYING_", "n.txt", "empty.jpg", "x\ny.png"]
    for below in ("", "s", "s/deep", "_s", "_metadata_s", "_k=v", ".s", "dir.jpg", *(f"w{i}" for i in range(9))):
        (tmp_path / "in" / below).mkdir(parents=True)
        for name in names if below[:1] != "w" else [f"{k}.jpg" for k in range(30)]:
            (tmp_path / "in" / below / name).write_text("" if "empty" in name else "x")
    (tmp_path / "in" / "gone.jpg").symlink_to(tmp_path / "no-such")
    (tmp_path / "in" / "ring.jpg").symlink_to(tmp_path / "in" / "ring.jpg")
    (tmp_path / "in" / "file-link.jpg").symlink_to(tmp_path / "in" / "a b.jpg")
    (tmp_path / "in" / "folder-link").symlink_to(tmp_path / "in" / "s")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.media.link./in", f"file://{tmp_path}/in")
    ends = ("jpg", "png", "JPG")
    folders = f"{tmp_path}/in", f"file://{tmp_path}/in", "viewfs://media/in", f"{tmp_path}/in/[sw]*", f"{tmp_path}/in/*b.jpg"
    for most, some in ((3, folders[:1]), (media.WALK, folders[1:])):
        monkeypatch.setattr(media, "WALK", most)
        for folder in some:
            for recursive, listing in ((True, media.training_catalog), (False, media.image_catalog)):
                read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
                want = sorted(r.path for r in read.collect() if r.path.endswith(ends))
                if not recursive:
                    want = [p for p in want if folder.endswith("jpg") or p[p.index("/in") :].count("/") == (3 if "*" in folder else 2)]
                got = listing(spark, folder)
                assert sorted(r.path for r in got.collect()) == want
                assert len(want) > 1 or folder.endswith("jpg") and len(want) == 1
                if len(want) > 200:
                    assert len(got.inputFiles()) < len(want) / 2
    (tmp_path / "none").mkdir()
    assert media.video_catalog(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        media.video_catalog(spark, str(tmp_path / "no-such"))


def test_curate(spark, folder, tmp_path):
    made = curation.curate(spark, str(folder), threshold=10)
    got = {r.name: r for r in made.collect()}
    assert got["shot_5000.jpg"].fate == "unreadable" and len(got) == 20
    # The second picture of each scene is a near copy of the first.
    assert all(got[f"shot_{2 * i + 2}.png"].fate == "duplicate" for i in range(9))
    assert all(got[f"shot_{2 * i + 1}.png"].fate in ("kept", "outlier") for i in range(9))
    # Without a detail anywhere, an image is an outlier among others.
    assert got["shot_100.PNG"].fate == "outlier" and got["shot_100.PNG"].ghost == 0
    line = curation.report(made).first()
    assert (line.total, line.after_dedup) == (20, 10) and line.removal_pct == round((20 - line.retained) * 5, 2)
    # A new batch begins with an empty queue.
    again = curation.curate(spark, str(folder), threshold=10, batch=3)
    assert again.filter("fate in ('kept', 'outlier')").count() > 10
    whole = {r.name: (r.fate, r.keep) for r in curation.curate(spark, str(folder), threshold=10, batch=None).collect()}
    assert whole == {n: (r.fate, r.keep) for n, r in got.items()}
    bad = curation.bad_frames(spark, str(folder))
    assert [r.name for r in bad.collect()].count("shot_100.PNG") == 1
    sinks.write_manifest(made.filter("keep"), str(tmp_path / "manifest"), "batch")
    kept = spark.read.parquet(str(tmp_path / "manifest"))
    status = sinks.copy_files(kept.select(media.plain_path(F.col("path")).alias("src"), F.concat(F.lit(f"{tmp_path}/out/"), "name").alias("dst")))
    assert sinks.copy_counts(status).first()[:] == (line.retained, 0)
    sinks.require_copied(status)
    lost = sinks.copy_files(spark.createDataFrame([("/no/such", f"{tmp_path}/x"), (None, "y")], "src string, dst string"))
    assert sinks.copy_counts(lost).first()[:] == (0, 2)
    with pytest.raises(OSError):
        sinks.require_copied(lost)


def test_videos(spark, tmp_path):
    def probe(path):
        if path.endswith("broken.avi"):
            raise OSError("unreadable")
        return "Duration: 00:00:02.50, Stream #0:0: Video: H264 (High), 10 fps"

    def command(path, folder, start, decoder, more=0):
        names = f"[open('{folder}/%011d.jpg' % n, 'w').close() for n in range({start}, {start} + 25 + {more if 'a.MOV' in path else 0})]"
        return [sys.executable, "-c", names if "broken" not in path else "raise SystemExit('no video')"]

    (tmp_path / "in" / "b").mkdir(parents=True)
    for name in ("z.mp4", "b/a.MOV", "b/broken.avi", "b/notes.txt"):
        (tmp_path / "in" / name).write_text("x")  # empty files are not listed
    plan = curation.plan_videos(spark, str(tmp_path / "in"), gpu=True, probe=probe).orderBy("start_frame")
    got = [(r.path.rsplit("/", 1)[1], r.route, r.frames, r.start_frame, r.first_file) for r in plan.collect()]
    assert got == [("a.MOV", "gpu", 25, 1, "00000000001.jpg"), ("z.mp4", "gpu", 25, 126, "00000000126.jpg"), ("broken.avi", "cpu", None, 251, "00000000251.jpg")]
    done = sinks.extract_frames(plan, str(tmp_path / "out"), command)
    found = {r.path.rsplit("/", 1)[1]: (r.frames, r.ok, r.error) for r in done.collect()}
    assert found["a.MOV"] == found["z.mp4"] == (25, True, None) and found["broken.avi"][:2] == (0, False) and "no video" in found["broken.avi"][2]
    # A video that has a few frames more than was estimated keeps them, and one that outgrows its numbers is an error.
    for more, made in ((100, 125), (101, 0)):
        out = tmp_path / f"out{more}"
        grown = {r.path.rsplit("/", 1)[1]: (r.frames, r.ok) for r in sinks.extract_frames(plan, str(out), functools.partial(command, more=more)).collect()}
        assert grown["a.MOV"] == (made, made > 0) and grown["z.mp4"] == (25, True)
        assert sorted(p.name for p in out.glob("*.jpg")) == [f"{n:011}.jpg" for n in (*range(1, 1 + made), *range(126, 151))]
    again = video.failed(plan, done.filter("ok"), "path").collect()
    assert [r.path.rsplit("/", 1)[1] for r in again] == ["broken.avi"]


def test_pixels_do_not_move(spark, folder, monkeypatch):
    """Whatever may be broadcast, no exchange carries pixels; beyond the bound on paths results are the same."""
    plans = []
    write = curation.park

    def watched(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(curation, "park", watched)
    monkeypatch.setattr(curation, "MOST_PATHS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.name: (r.fate, r.bytes, r.blur) for r in curation.curate(spark, str(folder), threshold=10).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert any("PythonUDF" in p or "ArrowEvalPython" in p for p in plans)
    for plan in plans:
        scan = plan.find("image")
        assert not any("data#" in line for line in plan.split("\n") if "Exchange" in line), plan[scan : scan + 500]
    monkeypatch.undo()
    assert got == {r.name: (r.fate, r.bytes, r.blur) for r in curation.curate(spark, str(folder), threshold=10).collect()}


def test_tools(monkeypatch):
    assert media.tool_versions("no-such-tool") == {"no-such-tool": None}
    with pytest.raises(RuntimeError, match="no-such-tool"):
        media.require_tools("no-such-tool")
    monkeypatch.setattr(media.shutil, "which", lambda name: None)
    with pytest.raises(RuntimeError):
        media.gpu_decoders()


DECODER = """#!{python}
import sys
name = sys.argv[sys.argv.index("-i") + 1].rsplit("/", 1)[1]
if name == "none.mp4":
    sys.exit(0)
for k in range(7):
    sys.stdout.buffer.write(b"P6\\n3 2\\n255\\n" + bytes([k, 10, 32] * 6))
if name == "cut.mp4":
    sys.stdout.buffer.write(b"P6 3 2 255 " + bytes(5))
if name == "broken.avi":
    sys.exit("no key frame")
"""


def test_frames(spark, tmp_path):
    """Pixels of any values, white space among them, from a stand-in for the decoder."""
    tool, videos = tmp_path / "decoder", tmp_path / "in"
    tool.write_text(DECODER.format(python=sys.executable))
    tool.chmod(0o755)
    (videos / "below").mkdir(parents=True)
    for name in ("a.MP4", "below/b.mkv", "none.mp4", "cut.mp4", "below/broken.avi", "notes.txt"):
        (videos / name).write_text("x")
    frames.register(spark)
    for tasks, every in ((10_000, 1), (2, 3)):
        read = spark.read.format("frames").option("tool", str(tool)).option("tasks", tasks).option("every", every)
        got = read.load(str(videos)).collect()
        rows = sorted((r.path.rsplit("/", 1)[1], r.frame) for r in got if r.error is None)
        assert rows == sorted((n, k) for n in ("a.MP4", "b.mkv", "cut.mp4", "broken.avi") for k in range(0, 7, every))
        assert all((r.height, r.width, bytes(r.data)) == (2, 3, bytes([32, 10, r.frame] * 6)) for r in got if r.error is None)
        failed = {r.path.rsplit("/", 1)[1]: (r.frame, r.data, r.error.strip()) for r in got if r.error is not None}
        assert failed == {"cut.mp4": (None, None, "the last frame is cut off"), "broken.avi": (None, None, "no key frame")}
    (tmp_path / "empty").mkdir()
    assert spark.read.format("frames").load(str(tmp_path / "empty")).collect() == []
    with pytest.raises(Exception, match="no-such-decoder"):
        spark.read.format("frames").option("tool", "no-such-decoder").load(str(videos)).collect()
