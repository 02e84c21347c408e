"""Command line: python -m entwine {sample,pool,sweep} --help."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .config import BlockingConfig
from .functions.geo import threshold_sweep
from .operators import evaluation, sampling
from .plans import normalize, pool
from .sources import files, load


def sample(spark: SparkSession, args) -> None:
    *sources, truth = load.load(spark, args.input, args.prefix)
    sampled, rows = sampling.anchored_sample(sources, truth, args.truth_rows, args.noise_rows)
    load.save(sampled, rows, args.output)


def run_pool(spark: SparkSession, args) -> None:
    config = BlockingConfig(top_k=args.top_k, include_s2_s3=not args.skip_s2_s3, max_df_ratio=args.max_df_ratio, joint_thresholds=not args.per_source)
    *sources, truth = load.load(spark, args.input, args.prefix)
    rows = normalize.normalize(normalize.check_ids(normalize.union_sources(*sources)), config).persist()
    pairs = pool.candidate_pool(rows, config).persist()
    pairs.write.mode("overwrite").parquet(f"{args.output}/pool")
    files.write_tsv(evaluation.submission(pairs, rows), f"{args.output}/matching_results.tsv")
    print(files.report_json(evaluation.recall_report(pairs, evaluation.true_pairs(truth, rows), rows)))


def sweep(spark: SparkSession, args) -> None:
    *sources, _ = load.load(spark, args.input, args.prefix)
    rows = normalize.add_text(normalize.union_sources(*sources).where("business_address IS NOT NULL"))
    threshold_sweep(rows, args.thresholds).orderBy("threshold").show(len(args.thresholds), truncate=False)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="entwine", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, function in (("sample", sample), ("pool", run_pool), ("sweep", sweep)):
        command = commands.add_parser(name)
        command.set_defaults(function=function)
        command.add_argument("input", help="folder of <prefix>_source1..3.tsv and <prefix>_ground_truth.tsv; synthetic tables without it")
        command.add_argument("--prefix", default="train" if name == "sample" else "sample")
        if name != "sweep":
            command.add_argument("output")
    options = commands.choices
    options["sample"].add_argument("--truth-rows", type=int, default=1500)
    options["sample"].add_argument("--noise-rows", type=int, default=8500)
    options["pool"].add_argument("--top-k", type=int, default=7)
    options["pool"].add_argument("--skip-s2-s3", action="store_true")
    options["pool"].add_argument("--max-df-ratio", type=float)
    options["pool"].add_argument("--per-source", action="store_true", help="block thresholds per source")
    options["sweep"].add_argument("--thresholds", type=int, nargs="+", default=[10_000, 12_000, 15_000, 20_000])
    args = parser.parse_args(arguments)
    args.function(SparkSession.builder.getOrCreate(), args)


if __name__ == "__main__":
    main()
