"""Command line: the batch jobs as Spark applications.

    python -m wardstat upload   <file.csv> <gold_dir> [--require col ...]
    python -m wardstat batch    <admissions.csv> <out_dir> [--no-train]
    python -m wardstat rates    <admissions.csv> [--show N]
    python -m wardstat train    <admissions.csv> <model_dir>
    python -m wardstat lines    <frequency|rates|yearly|weekend> <input_dir> <output_dir>

Exit codes: 0 success, 1 usage or processing failure, 2 required columns
missing (upload).  The session comes from ``spark-submit``/the platform;
run locally it is a ``local[*]`` session.
"""

from __future__ import annotations

import argparse
import sys

from .operators import aggregates as A
from .operators import ml as ML
from .operators.upload import MissingColumnsError
from .plans import batch as B
from .session import get_session
from .sources import files as FS


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="wardstat")
    sub = ap.add_subparsers(dest="cmd", required=True)
    up = sub.add_parser("upload", help="gold tables from an uploaded CSV")
    up.add_argument("csv")
    up.add_argument("gold_dir")
    up.add_argument("--require", nargs="*", default=[])
    bt = sub.add_parser("batch", help="ingest -> frequency job -> training")
    bt.add_argument("csv")
    bt.add_argument("out_dir")
    bt.add_argument("--no-train", action="store_true")
    rt = sub.add_parser("rates", help="readmission rate by region and disease")
    rt.add_argument("csv")
    rt.add_argument("--show", type=int, default=5)
    ln = sub.add_parser("lines", help="a line-oriented job: text lines -> key<TAB>value text")
    ln.add_argument("job", choices=sorted(B.LINE_JOBS))
    ln.add_argument("input")
    ln.add_argument("output")
    tr = sub.add_parser("train", help="fit and save the scoring forest")
    tr.add_argument("csv")
    tr.add_argument("model_dir")
    try:
        args = ap.parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0

    from pyspark.sql import SparkSession
    owned = SparkSession.getActiveSession() is None
    master = None if _has_master() else "local[*]"
    spark = get_session(master=master, app_name=f"wardstat-{args.cmd}")
    try:
        if args.cmd == "upload":
            for name, path in B.process_upload(spark, args.csv, args.gold_dir, required=args.require).items():
                print(f"{name}\t{path}")
        elif args.cmd == "batch":
            adm = FS.read_admissions(spark, args.csv)
            for name, path in B.run_batch(spark, adm, args.out_dir, train=not args.no_train).items():
                print(f"{name}\t{path}")
        elif args.cmd == "rates":
            A.readmission_rates(FS.read_admissions(spark, args.csv)) \
                .orderBy("region", "disease").show(args.show, truncate=False)
        elif args.cmd == "lines":
            print(B.run_line_job(spark, args.job, args.input, args.output))
        elif args.cmd == "train":
            model = ML.train_ordinal(FS.read_admissions(spark, args.csv))
            print(ML.save_model(model, args.model_dir))
        return 0
    except MissingColumnsError as e:
        print(f"Data Quality Check Failed. {e}", file=sys.stderr)
        return MissingColumnsError.exit_code
    except Exception as e:  # noqa: BLE001 - reported as a failed job
        print(f"Processing failed: {e}", file=sys.stderr)
        return 1
    finally:
        if owned:
            spark.stop()


def _has_master() -> bool:
    from pyspark import SparkConf
    return SparkConf().contains("spark.master")


if __name__ == "__main__":
    sys.exit(main())
