"""What decides in a folder: videos beside pictures, equal pixels, verdicts and limits, unknown kinds of files."""

import shutil

import pytest

from keepset import __main__ as cli
from keepset.sources import records
from tests.test_sources import picture


def planned(spark, folder, **more):
    job = cli.analyse(spark, str(folder), **more)
    rows = records.read(spark, f"{folder}/_keepset/{job}/plan", "plan").collect()
    return {r["file"].rpartition("/")[2]: (r["verdict"], r["why"], r["why_inferior"]) for r in rows}


def test_the_file_with_its_video_stays(spark, tmp_path):
    picture(spark, tmp_path / "a.jpg", 0.9)
    shutil.copy(tmp_path / "a.jpg", tmp_path / "b.jpg")
    (tmp_path / "a.mov").write_bytes(b"moving")
    for name in ("c.webp", "d.webp", "e.heic"):
        (tmp_path / name).write_bytes(b"RIFF\x10\0\0\0WEBPVP8 same bytes in both" if name < "e" else b"\0\0\0\x18ftypheic")
    got = planned(spark, tmp_path)
    assert got["a.jpg"][0] == "KEEP" and got["b.jpg"] == ("REDUNDANT", "duplicate", "no Live Photo video")
    assert sorted((got[n][0], got[n][1]) for n in ("c.webp", "d.webp")) == [("KEEP", None), ("REDUNDANT", "duplicate")] and "e.heic" not in got


def test_equal_pixels_and_verdicts(spark, tmp_path):
    picture(spark, tmp_path / "a.jpg", 0.9)
    data = (tmp_path / "a.jpg").read_bytes()
    (tmp_path / "same.jpg").write_bytes(data[:2] + b"\xff\xfe\x00\x06note" + data[2:])  # a remark more
    picture(spark, tmp_path / "worse.jpg", 0.35)
    got = planned(spark, tmp_path)
    assert {got[n][:2] for n in ("a.jpg", "same.jpg")} == {("KEEP", None), ("REDUNDANT", "identical")} and "worse.jpg" not in got
    name = lambda n: f"file:{tmp_path}/{n}"
    (tmp_path / "verdicts.csv").write_text("file_a,file_b,scene,block,ratio,shift,zoom,rot,b_in_a,a_in_b,lum_off,contrast\n" + "".join(f"{name(n)},{name('worse.jpg')},same,0.1,2.0,,,,,,,\n" for n in ("a.jpg", "same.jpg")))
    got = planned(spark, tmp_path, verdicts=str(tmp_path / "verdicts.csv"))
    assert got["worse.jpg"] == ("REDUNDANT", "resave", "more compressed")
    assert "worse.jpg" not in planned(spark, tmp_path, verdicts=str(tmp_path / "verdicts.csv"), block=5.0)


@pytest.mark.parametrize("bad", [b"", b"\xff\xd8", b"BM"])
def test_unreadable_files_do_not_stop_a_run(spark, tmp_path, bad):
    (tmp_path / "x.jpg").write_bytes(bad)
    picture(spark, tmp_path / "y.jpg", 0.9)
    assert planned(spark, tmp_path) == {}
