"""Per-stage task balance of registered queries, from Spark's event log.

usage: python tools/task_skew.py [sf_dir] [key ...]

The test tables are single small files (one row group each), so a scan reads
them in one task whatever the plan. The tool therefore first writes a copy of
the tables into a fresh scratch folder, 16 files per table, and runs the
queries on that copy. Each query runs into the ``noop`` sink in a session
whose event log goes to its own fresh scratch folder, with fixed shuffle
partitions (no AQE coalescing) so the data spreads over several tasks even at
a small scale factor. Then reads the log and prints, per stage, the number
of tasks, the records read (input + shuffle) and the share of the busiest
task. A stage is flagged when one task reads over half of a stage's records
while the stage reads more than 10 % of the query's input rows — the sign of a
plan that funnels the data through one task.
"""

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortlab.plans.catalog import TABLES  # noqa: E402
from cohortlab.plans.queries import REGISTRY  # noqa: E402
from cohortlab.session import build_session  # noqa: E402

DEFAULT_KEYS = ["class_profile", "describe_table", "min_max_scale", "record_profile",
                "row_index", "positional_join", "auroc_exact", "confusion_matrix",
                "model_leaderboard", "split_train_val", "standard_scale", "pca_project"]


def _lines(path: str):
    if path.endswith(".zstd"):
        import io

        import zstandard
        with open(path, "rb") as raw:
            reader = zstandard.ZstdDecompressor().stream_reader(raw)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        with open(path) as f:
            yield from f


def stage_table(log_dir: str) -> dict:
    files = [p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)
             if os.path.isfile(p) and os.path.basename(p).startswith(("events_", "local-", "app-"))]
    stages = defaultdict(list)
    job_of_stage = {}
    for path in files:
        for line in _lines(path):
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerJobStart":
                for sid in ev.get("Stage IDs", []):
                    job_of_stage[sid] = ev.get("Job ID")
            elif kind == "SparkListenerTaskEnd":
                m = ev.get("Task Metrics") or {}
                rec = (m.get("Input Metrics", {}).get("Records Read", 0)
                       + m.get("Shuffle Read Metrics", {}).get("Total Records Read", 0))
                stages[ev["Stage ID"]].append(rec)
    return {"stages": stages, "jobs": job_of_stage}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    keys = sys.argv[2:] or DEFAULT_KEYS
    copy = tempfile.mkdtemp(prefix="cohortlab-tables-")
    spark = build_session()
    for t in TABLES:
        src = os.path.join(sf, f"{t}.parquet")
        if os.path.exists(src):
            spark.read.parquet(src).repartition(16).write.parquet(os.path.join(copy, f"{t}.parquet"))
    spark.stop()
    sf = copy
    report = {}
    for key in keys:
        log_dir = tempfile.mkdtemp(prefix="cohortlab-eventlog-")
        spark = build_session(extra={
            "spark.eventLog.enabled": "true",
            "spark.eventLog.dir": log_dir,
            "spark.eventLog.compress": "false",
            "spark.sql.files.maxPartitionBytes": "1m",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
        })
        try:
            rows_in = spark.read.parquet(f"{sf}/lineitem.parquet").count()
            REGISTRY[key](spark, sf).write.format("noop").mode("overwrite").save()
        finally:
            spark.stop()
        t = stage_table(log_dir)
        flagged, lines = [], []
        for sid, recs in sorted(t["stages"].items()):
            total = sum(recs)
            share = max(recs) / total if total else 0.0
            lines.append((sid, len(recs), total, round(share, 3)))
            if total > 0.1 * rows_in and share > 0.5 and len(recs) > 1:
                flagged.append(sid)
            if total > 0.1 * rows_in and len(recs) == 1:
                flagged.append(sid)
        report[key] = {"stages": lines, "flagged": flagged}
        print(f"{key:18s} stages={len(lines):3d} flagged={flagged} "
              f"busiest={[(s, n, tot, sh) for s, n, tot, sh in lines if tot > 0.1 * rows_in]}",
              flush=True)
    print(json.dumps({k: v["flagged"] for k, v in report.items()}))


if __name__ == "__main__":
    main()
