"""Summarise a Spark event log: the slowest stages with their task counts.

    BENCH_EVENT_LOG=1 python bench.py ingest_admissions   # prints nothing extra
    python tools/stage_times.py <event log file or folder> [top]
"""

import glob
import io
import json
import os
import sys


def _lines(f: str):
    """Lines of one event file; Spark 4 compresses event logs with zstd."""
    if f.endswith(".zstd") or f.endswith(".zst"):
        import zstandard
        with open(f, "rb") as raw:
            reader = zstandard.ZstdDecompressor().stream_reader(raw)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        with open(f, encoding="utf-8") as fh:
            yield from fh


def stages(path: str):
    files = [path] if os.path.isfile(path) else sorted(
        f for f in glob.glob(f"{path}/**/*", recursive=True)
        if os.path.isfile(f) and os.path.basename(f).startswith(("events_", "local-", "app-")))
    for f in files:
        for line in _lines(f):
            if line.strip():
                ev = json.loads(line)
                if ev.get("Event") == "SparkListenerStageCompleted":
                    info = ev["Stage Info"]
                    start, end = info.get("Submission Time"), info.get("Completion Time")
                    if start and end:
                        yield ((end - start) / 1000.0, info["Number of Tasks"], info["Stage Name"],
                               info["Stage ID"])


def main():
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    rows = sorted(stages(path), reverse=True)
    total = sum(r[0] for r in rows)
    print(f"{len(rows)} stages, {total:.2f} s of stage time")
    for secs, tasks, name, sid in rows[:top]:
        print(f"{secs:8.3f}s  stage {sid:4d}  tasks {tasks:4d}  {name[:90]}")


if __name__ == "__main__":
    main()
