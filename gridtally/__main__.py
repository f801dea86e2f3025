"""The pipeline steps as one command for spark-submit.

    spark-submit --py-files gridtally.zip gridtally/__main__.py run SOURCE WAREHOUSE

``check`` lists the files, ``ingest``, ``transform`` and ``load`` are the single steps
in their order, ``ingest-new`` reads only files that are new since its last run.
"""

from __future__ import annotations

import argparse

from gridtally.plans import pipeline
from gridtally.schema import MAX_PLAUSIBLE_KWH
from gridtally.session import build_session
from gridtally.sources.csv_readings import available_files
from gridtally.streaming.incremental import ingest_new_files


def parse(arguments: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="gridtally", description=__doc__)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--max-kwh", type=float, default=MAX_PLAUSIBLE_KWH)
    files = argparse.ArgumentParser(add_help=False)
    files.add_argument("source")
    files.add_argument("--glob", action="append", help="one per file layout, default all *.csv of any layout")
    steps = parser.add_subparsers(dest="step", required=True)
    for step, parents in {
        "check": [files],
        "ingest": [files, common],
        "ingest-new": [files, common],
        "transform": [common],
        "load": [],
        "run": [files, common],
    }.items():
        command = steps.add_parser(step, parents=parents)
        if step != "check":
            command.add_argument("warehouse")
    return parser.parse_args(arguments)


def main(arguments: list[str] | None = None) -> None:
    options = parse(arguments)
    spark = build_session()
    globs = getattr(options, "glob", None) or []
    if options.step == "check":
        for glob in globs or ["*.csv"]:
            print(f"{len(available_files(spark, options.source, glob))} files match {glob}")
    elif options.step == "ingest":
        print(pipeline.ingest(spark, options.source, options.warehouse, *globs, max_kwh=options.max_kwh))
    elif options.step == "ingest-new":
        for glob in globs or ["*.csv"]:
            stream = "".join(c if c.isalnum() else "_" for c in glob)
            counts = ingest_new_files(
                spark, options.source, options.warehouse, glob, options.max_kwh, stream_name=stream
            )
            print(glob, counts)
    elif options.step == "transform":
        pipeline.transform_stored(spark, options.warehouse, options.max_kwh)
    elif options.step == "load":
        pipeline.load(spark, pipeline.processed_folder(options.warehouse), options.warehouse)
    else:
        pipeline.run_pipeline(
            spark, options.source, options.warehouse, *globs, max_kwh=options.max_kwh
        ).show()


if __name__ == "__main__":
    main()
