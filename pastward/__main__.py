"""Run the experiment on two hourly CSV files: ``python -m pastward FOLDER CANONICAL RAW OUT [--smoke] [--overwrite]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from pastward.plans.experiment import run_files


def main() -> None:
    parser = argparse.ArgumentParser(prog="pastward", description=__doc__)
    parser.add_argument("folder", help="folder of the input files")
    parser.add_argument("canonical", help="name of the cleaned hourly CSV")
    parser.add_argument("raw", help="name of the raw hourly CSV")
    parser.add_argument("out", help="folder for the results")
    parser.add_argument("--smoke", action="store_true", help="run on the last rows only, with the quick sizes; leaves earlier results alone")
    parser.add_argument("--overwrite", action="store_true", help="let a full run write over what is in OUT")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("pastward").getOrCreate()
    run_files(spark, args.folder, args.canonical, args.raw, args.out, args.smoke, args.overwrite).show(truncate=False)


if __name__ == "__main__":
    main()
