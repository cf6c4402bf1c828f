"""Command line: ``python -m docket INPUT_FOLDER OUTPUT_FOLDER [--master local[*]]``.

Runs the whole flow on a folder of .docx files with the rule analyzer and prints
the run summary, the place of the failure table and its first rows.
"""

from __future__ import annotations

import argparse
import sys

from docket.config import Config
from docket.plans.casework import run_folder
from docket.session import build_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="python -m docket", description=__doc__.splitlines()[0])
    p.add_argument("input_folder")
    p.add_argument("output_folder")
    p.add_argument("--master", default="local[*]")
    p.add_argument("--shuffle-partitions", type=int, help="default: the session's own setting")
    p.add_argument("--batch-size", type=int, default=Config.max_concurrent_requests)
    p.add_argument("--show-failures", type=int, default=20, help="print at most so many failed files")
    p.add_argument("--publish", action="store_true", help="commit the reports as one set, in OUTPUT_FOLDER/published")
    args = p.parse_args(argv)
    spark = build_session(args.master, app="docket", shuffle_partitions=args.shuffle_partitions)
    try:
        res = run_folder(spark, args.input_folder, args.output_folder, config=Config(max_concurrent_requests=args.batch_size),
                         publish=args.publish)
        print(f"Total documents processed: {res.n_documents}")
        if res.summary is not None:
            s = res.summary.first()
            print(f"Successful analyses: {s['n_success']}")
            print(f"Failed analyses: {s['n_failed']}")
            print(f"Total time: {s['elapsed_s']:.1f}s")
            print(f"Unreadable files (quarantined): {res.n_quarantined}")
            print(f"Failure table: {args.output_folder.rstrip('/')}/failures")
            for r in res.failures.orderBy("filename").limit(args.show_failures).collect():
                print(f"- {r['filename']}: {r['error']}")
        return 0
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
