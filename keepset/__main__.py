"""python -m keepset FOLDER: find redundant pictures, write a plan, and act on it if asked.

    FOLDER            analyse a folder; the plan goes to FOLDER/_keepset/<job>/plan
    --files LIST      only the files named in LIST, one path a line
    --block N --ratio N   limits in per cent and as a ratio, in place of the defaults
    --apply           move what the newest plan without a log calls redundant and proven, and write a log
    --undo JOB        put a job's files back
    --reset           undo every job
    --dashboard       totals of all jobs; --html FILE writes them as a page
    --exclude NAME    leave folders of that name out; may be given again
    --window SECONDS  how far apart two captures may be to be compared
    --audit PAIRS     what became of the pairs in a CSV of file_a, file_b; goes to the job's fates
    --verdicts CSV    alignments made elsewhere: file_a, file_b, scene, block, ratio and what else was measured
    --queue           FOLDER holds tickets, each naming folders to analyse
"""

from __future__ import annotations

import argparse
import html
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from keepset import actions
from keepset.functions import scalars as S
from keepset.operators import cascade, journal
from keepset.plans import library
from keepset.sources import files, pixels, records
from keepset.streaming import sessions

WORKING = "_keepset"


def jobs(spark: SparkSession, folder: str) -> dict[str, set[str]]:
    """job -> the records it has."""
    store, root = actions.Files(spark), f"{folder}/{WORKING}"
    if not store.exists(root):
        return {}
    return {p.rpartition("/")[2]: {q.rpartition("/")[2] for q, _ in store.children(p)} for p, is_folder in store.children(root) if is_folder}


def analyse(spark: SparkSession, folder: str, listed: str | None = None, block: float | None = None, ratio: float | None = None, exclude: tuple[str, ...] = (), window: float = S.WINDOW, audit: str | None = None, verdicts: str | None = None) -> str:
    """Write a plan; returns the job's name."""
    found = files.scan(spark, folder, exclude=(WORKING, *exclude), content=True)
    if listed:
        found, lost = files.listed(spark, listed, found)
        print(f"{lost.count()} listed files are not there")
    limits = cascade.Limits(cascade.BLOCK if block is None else block / 100, cascade.RATIO if ratio is None else ratio)
    taken, stamp = jobs(spark, folder), datetime.now(timezone.utc).strftime("%Y-%m-%d")
    job = next(name for k in range(1, len(taken) + 2) if (name := f"{stamp} {k:03d}") not in taken)
    where = f"{folder}/{WORKING}/{job}"
    videos = files.scan(spark, folder, exclude=(WORKING, *exclude), extensions=S.VIDEO_EXTENSIONS)
    aligned = records.read(spark, verdicts, "verdicts") if verdicts else None
    plan, fates = library.manifest(spark, found, limits, aligned, window=window, videos=videos, looks=pixels.looks(pixels.pictures(spark, folder)))
    records.write(plan, f"{where}/plan", "plan")
    if audit:
        records.write(library.audited(records.read(spark, audit, "audit"), fates, records.read(spark, f"{where}/plan", "plan")), f"{where}/fates", "fates")
    return job


def apply(spark: SparkSession, folder: str) -> str | None:
    """Move what the newest open plan lets go; older open plans are superseded."""
    opened = sorted(job for job, own in jobs(spark, folder).items() if "plan" in own and "log" not in own)
    if not opened:
        return None
    job = opened[-1]
    leaving = journal.apply_plan(records.read(spark, f"{folder}/{WORKING}/{job}/plan", "plan")).select("file", "why", "kept_instead")
    done = list(actions.move_out(spark, (tuple(r) for r in leaving.toLocalIterator()), f"{folder}/{WORKING}/{job}/culled"))
    moved = [x.row() for x in done if isinstance(x, actions.Moved)]
    log = spark.createDataFrame(moved, "moved_at string, from string, to string, why string, kept_instead string, MB double")
    records.write(log, f"{folder}/{WORKING}/{job}/log", "log")
    for state in ("missing", "failed"):
        if n := sum(not isinstance(x, actions.Moved) and x[1] == state for x in done):
            print(f"{n} {state}")
    return job


def undo(spark: SparkSession, folder: str, job: str) -> dict[str, int]:
    where = f"{folder}/{WORKING}/{job}"
    log = records.read(spark, f"{where}/log", "log").orderBy("moved_at").select("from", "to")
    counts: dict[str, int] = {}
    for _, state in actions.undo(spark, (tuple(r) for r in log.toLocalIterator())):
        counts[state] = counts.get(state, 0) + 1
    store = actions.Files(spark)
    store.move(f"{where}/log", f"{where}/log undone {datetime.now(timezone.utc).strftime('%Y%m%d%H%M%S')}")
    actions.prune_empty(spark, where)
    return counts


def dashboard(spark: SparkSession, folder: str) -> list[tuple]:
    """(job, files, sidecars, size) with a row for all, largest first."""
    logs = [records.read(spark, f"{folder}/{WORKING}/{job}/log", "log").withColumn("job", F.lit(job)) for job, own in jobs(spark, folder).items() if "log" in own]
    if not logs:
        return []
    every = logs[0]
    for log in logs[1:]:
        every = every.unionByName(log)
    beside = F.col("why").isin(*set(actions.SIDECARS.values()))
    rolled = every.rollup("job").agg(F.count(F.when(~beside, 1)).alias("files"), F.count(F.when(beside, 1)).alias("sidecars"), F.sum("MB").alias("MB"))
    rows = rolled.select(F.coalesce("job", F.lit("all")).alias("job"), "files", "sidecars", S.size_text(F.col("MB") * 1e6).alias("size"), "MB").orderBy(F.col("MB").desc())
    return [tuple(r)[:4] for r in rows.collect()]


def page(rows: list[tuple]) -> str:
    """The dashboard as HTML; a bar shows each job's share of the files."""
    total = max((r[1] for r in rows), default=0) or 1
    cells = "".join(f"<tr><td>{html.escape(str(job))}</td><td>{n}</td><td>{beside}</td><td>{html.escape(str(size))}</td><td><div style='background:#888;height:1em;width:{200 * n // total}px'></div></td></tr>" for job, n, beside, size in rows)
    return f"<!doctype html><meta charset='utf-8'><title>keepset</title><table><tr><th>job</th><th>files</th><th>sidecars</th><th>size</th><th></th></tr>{cells}</table>"


def main() -> None:
    parser = argparse.ArgumentParser(prog="keepset", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("folder")
    parser.add_argument("--files")
    parser.add_argument("--block", type=float)
    parser.add_argument("--ratio", type=float)
    parser.add_argument("--apply", action="store_true")
    parser.add_argument("--undo", metavar="JOB")
    parser.add_argument("--reset", action="store_true")
    parser.add_argument("--dashboard", action="store_true")
    parser.add_argument("--html", metavar="FILE")
    parser.add_argument("--exclude", action="append", default=[])
    parser.add_argument("--window", type=float, default=S.WINDOW)
    parser.add_argument("--audit", metavar="PAIRS")
    parser.add_argument("--verdicts", metavar="CSV")
    parser.add_argument("--queue", action="store_true")
    args = parser.parse_args()
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.undo:
        print(undo(spark, args.folder, args.undo))
    elif args.reset:
        for job, own in jobs(spark, args.folder).items():
            if "log" in own:
                print(job, undo(spark, args.folder, job))
    elif args.dashboard:
        rows = dashboard(spark, args.folder)
        for row in rows:
            print(*row, sep="\t")
        if args.html:
            with open(args.html, "w", encoding="utf-8") as out:
                out.write(page(rows))
    elif args.apply:
        print(apply(spark, args.folder) or "no open plan")
    elif args.queue:
        sessions.drain(spark, args.folder, f"{args.folder}/{WORKING}/queue", lambda folder: print(folder, analyse(spark, folder)))
    else:
        print(analyse(spark, args.folder, args.files, args.block, args.ratio, tuple(args.exclude), args.window, args.audit, args.verdicts))


if __name__ == "__main__":
    main()
