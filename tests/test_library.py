"""A folder of pictures from scan to undo, and the CSV records."""

import shutil

import pytest

from keepset import __main__ as cli
from keepset import actions
from keepset.operators import journal
from keepset.sources import records
from tests.test_sources import picture


@pytest.fixture
def folder(spark, tmp_path):
    picture(spark, tmp_path / "a.jpg", 0.9)
    shutil.copy(tmp_path / "a.jpg", tmp_path / "b.jpg")
    (tmp_path / "a.xmp").write_text("x")
    picture(spark, tmp_path / "c.jpg", 0.5, seed=3)
    (tmp_path / "broken.jpg").write_bytes(b"\xff\xd8")
    return tmp_path


def test_from_scan_to_undo(spark, folder):
    (folder / "pairs.csv").write_text(f"file_a,file_b\nfile:{folder}/a.jpg,file:{folder}/c.jpg\nfile:{folder}/b.jpg,file:{folder}/a.jpg\n")
    job = cli.analyse(spark, str(folder), audit=str(folder / "pairs.csv"))
    fates = records.read(spark, f"{folder}/_keepset/{job}/fates", "fates").collect()
    assert {r["file_b"].rpartition("/")[2]: (r["stage"], r["detail"]) for r in fates} == {"c.jpg": ("rejected on the sketch", "culled"), "b.jpg": ("within limits", "culled")}
    plan = records.read(spark, f"{folder}/_keepset/{job}/plan", "plan").collect()
    assert sorted((r["file"].rpartition("/")[2], r["verdict"], r["why"]) for r in plan) == [("a.jpg", "REDUNDANT", "duplicate"), ("b.jpg", "KEEP", None)]
    assert [r["why_inferior"] for r in plan if r["verdict"] == "REDUNDANT"] == ["the same by every measure"]
    assert cli.apply(spark, str(folder)) == job and cli.apply(spark, str(folder)) is None
    assert not (folder / "a.jpg").exists() and not (folder / "a.xmp").exists() and (folder / "b.jpg").exists()
    totals = cli.dashboard(spark, str(folder))
    assert [t[:3] for t in totals if t[0] == "all"] == [("all", 1, 1)]
    assert "<td>all</td><td>1</td><td>1</td>" in cli.page(totals)
    assert cli.undo(spark, str(folder), job) == {"restored": 2}
    assert (folder / "a.jpg").exists() and (folder / "a.xmp").exists()
    assert cli.jobs(spark, str(folder))[job] >= {"plan"}


def test_taken_names_and_occupied_places(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for k in "xy":
        (tmp_path / k).mkdir(exist_ok=True)
        (tmp_path / k / "p.jpg").write_text(k)
    rows = [(f"{tmp_path}/{k}/p.jpg", "duplicate", "kept") for k in "xyz"]
    done = list(actions.move_out(spark, rows, f"{tmp_path}/out"))
    assert [x.target.rpartition("/")[2] if isinstance(x, actions.Moved) else x[1] for x in done] == ["p.jpg", "p (2).jpg", "missing"]
    (tmp_path / "x" / "p.jpg").write_text("new")
    states = dict(actions.undo(spark, [(x.source, x.target) for x in done[:2]]))
    assert [states[f"{tmp_path}/{k}/p.jpg"] for k in "xy"] == ["occupied", "restored"]


def test_records(spark, tmp_path):
    rows = spark.createDataFrame([("2024", "a", "b", "dup", "k", 1.5)], ["moved_at", "from", "to", "why", "kept_instead", "MB"])
    records.write(rows, str(tmp_path / "log"), "log")
    records.write(rows, str(tmp_path / "log"), "log", append=True)
    assert records.read(spark, str(tmp_path / "log"), "log").count() == 2
    assert records.has_columns(spark, str(tmp_path / "log"), "log") and not records.has_columns(spark, str(tmp_path / "log"), "plan")
    (tmp_path / "odd.csv").write_text("file_a,file_b\na,\n")
    assert records.read(spark, str(tmp_path / "odd.csv"), "audit").first()["file_b"] is None


def test_ledger(spark):
    ddl = records.SCHEMAS["review"].replace("group string", "`group` string")
    row = lambda at, setting: (at, setting, "x", "1", "f", "p", "y", "w", 0.1, "r")
    review = spark.createDataFrame([row("1", "copies"), row("2", "copies"), row("2", "scenes")], ddl)
    assert records.fold_ledger(review, "j", "d", "applied").count() == 2
    undone = records.fold_ledger(review, "j", "d", "undone")
    assert undone.count() == 3 and undone.columns == records.names("labels")
    assert records.retract(records.fold_ledger(review, "j", "d", "applied").union(undone), "j").count() == 3
    assert journal.last_pass(review, "setting").count() == 2
