"""Command line: python -m kindred train | predict | validate.

Folders hold <part>_source1.tsv to <part>_source3.tsv (part: train or test) and train_ground_truth.tsv. Results are
matching_results.tsv and candidate_pairs.tsv. The exit code is 0 if all went well and the files pass, else 1.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import blocking, model, quality
from kindred.plans import matching
from kindred.sources import tsv

BLOCKINGS = {"standard": blocking.STANDARD, "narrow": blocking.NARROW, "hybrid": blocking.HYBRID, "wide": blocking.WIDE}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kindred")
    commands = top.add_subparsers(dest="command", required=True)

    train = commands.add_parser("train", help="fit a matcher, with its threshold")
    train.add_argument("--train-dir", required=True)
    train.add_argument("--model-out", required=True)
    train.add_argument("--val-frac", type=float, default=0.2)
    train.add_argument("--seed", type=int, default=42)
    train.add_argument("--sample-s1", type=int, help="records of the first source to learn from")
    train.add_argument("--sample-other", type=int, help="records of each other source, true matches first")
    train.add_argument("--blocking", choices=sorted(BLOCKINGS), default="standard")
    train.add_argument("--depth", type=int, default=model.ModelConfig.depth)
    train.add_argument("--rounds", type=int, default=model.ModelConfig.rounds)

    predict = commands.add_parser("predict", help="write candidates and matches")
    predict.add_argument("--test-dir", required=True)
    predict.add_argument("--model", required=True)
    predict.add_argument("--output-dir", required=True)
    predict.add_argument("--limit-other", type=int, help="read the first records of the second and third source only")
    predict.add_argument("--batches", type=int, default=1, help="parts of the first source, matched one after another")

    check = commands.add_parser("validate", help="check result files")
    check.add_argument("--matching", "-m", required=True)
    check.add_argument("--candidate", "-c")
    check.add_argument("--test-dir", "-t", required=True)
    check.add_argument("--check-ids", action="store_true", help="also check that listed ids exist")
    return top


def _sources(spark: SparkSession, folder: str, part: str, limit_other: int | None = None) -> DataFrame:
    return matching.load_sources(spark, *(f"{folder}/{part}_source{i}.tsv" for i in (1, 2, 3)), limit_other)


def run_train(spark: SparkSession, args: argparse.Namespace) -> int:
    lists = tsv.read_ground_truth(spark, f"{args.train_dir}/train_ground_truth.tsv")
    truth = lists.select("source1_entity_id", F.explode("matched").alias("matched_entity_id"))
    fitted = matching.train(
        _sources(spark, args.train_dir, "train"), truth, BLOCKINGS[args.blocking], model.ModelConfig(args.depth, args.rounds), args.val_frac, args.seed,
        args.sample_s1, args.sample_other,
    )
    fitted.matcher.save(spark, args.model_out)
    print(f"recall ceiling {fitted.recall_ceiling:.4f}, F0.5 {fitted.validation_f_half:.4f} at {fitted.matcher.threshold:.2f}, empty baseline {fitted.empty_baseline:.4f}")
    return 0


def run_predict(spark: SparkSession, args: argparse.Namespace) -> int:
    source = _sources(spark, args.test_dir, "test", args.limit_other)
    found, matches = matching.predict(source, model.Matcher.load(spark, args.model), args.batches)
    matching.write_outputs(source, found, matches, f"{args.output_dir}/matching_results.tsv", f"{args.output_dir}/candidate_pairs.tsv")
    return 0


def run_validate(spark: SparkSession, args: argparse.Namespace) -> int:
    paths = [f"{args.test_dir}/test_source{i}.tsv" for i in (1, 2, 3)]
    if not quality.exists(spark, paths[0]):
        print(f"error missing_file: {paths[0]}")
        return 1
    targets = None
    if args.check_ids and all(quality.exists(spark, p) for p in paths[1:]):
        targets = tsv.read_ids(spark, paths[1]).unionByName(tsv.read_ids(spark, paths[2]))
    issues = quality.validate_files(spark, args.matching, args.candidate, tsv.read_ids(spark, paths[0]), targets)
    rows = quality.summary(issues).orderBy("level", "rule").collect()  # one row a rule
    for row in rows:
        print(f"{row['level']} {row['rule']}: {row['n']}, e.g. {', '.join(str(x) for x in row['examples'])}")
    failed = any(row["level"] == "error" for row in rows)
    print("FAIL" if failed else "PASS")
    return int(failed)


COMMANDS = {"train": run_train, "predict": run_predict, "validate": run_validate}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    return COMMANDS[args.command](spark or SparkSession.builder.appName("kindred").getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
