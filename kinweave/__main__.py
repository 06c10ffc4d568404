"""python -m kinweave train | benchmark | predict | merge | validate"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .operators import outputs
from .plans import runs
from .plans.paths import PATHS
from .sources import tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kinweave", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, **text: str) -> argparse.ArgumentParser:
        one = commands.add_parser(name)
        for flag, what in text.items():
            one.add_argument(f"--{flag.replace('_', '-')}", required=True, help=what)
        return one

    data = "folder with <prefix>_source1.tsv, <prefix>_source2.tsv and <prefix>_source3.tsv"
    one = command("train", data=data, truth="tab-separated links", work="folder of the index and the models")
    one.add_argument("--path", choices=sorted(PATHS), default="blocking", help="how candidates are found")
    for flag, value in (("sample", 2000), ("folds", 3), ("trees", 900)):
        one.add_argument(f"--{flag}", type=int, default=value)
    one.add_argument("--rate", type=float, default=0.04, help="share of each tree that counts")
    for name, path in PATHS.items():
        for flag, value in path.settings.items():
            one.add_argument(f"--{flag.replace('_', '-')}", type=int, help=f"of the {name} path; {value or 'no bound'} if not given")
    one = command("benchmark", data=data, work="folder of the index")
    one.add_argument("--queries", type=int, default=1000)
    one = command("predict", data=data, work="folder of the index and the models", out="folder of the parts")
    for flag, value in (("part", 0), ("parts", 1), ("batches", 1)):
        one.add_argument(f"--{flag}", type=int, default=value)
    command("merge", data=data, out="folder of the parts")
    one = command("validate", matches="file of matches", data=data)
    one.add_argument("--candidates", help="file of candidates")
    one.add_argument("--skip-id-check", action="store_true")
    for name, one in commands.choices.items():
        one.add_argument("--prefix", default="train" if name == "train" else "test")
    return top


def main(args: list[str] | None = None) -> int:
    usage = parser()
    a = usage.parse_args(args)
    sizes = [getattr(a, x) for x in ("sample", "folds", "trees", "queries", "parts", "batches", *(s for p in PATHS.values() for s in p.settings)) if a.command != "validate" and getattr(a, x, None) is not None]
    if min(sizes, default=1) < 1 or a.command == "train" and a.folds < 2 or a.command == "predict" and not 0 <= a.part < a.parts:
        usage.error("sizes must be positive, folds two at least, and 0 <= part < parts")
    spark = SparkSession.builder.appName("kinweave").getOrCreate()
    queries, targets = tables.load_split(spark, a.data, a.prefix)
    files = tables.file_fingerprint(spark, [*tables.split_files(a.data, a.prefix), *([a.truth] if a.command == "train" else [])]) if a.command in ("train", "predict") else None
    if a.command == "train":
        settings = {s: x for p in PATHS.values() for s in p.settings if (x := getattr(a, s)) is not None}
        print(json.dumps(runs.train(spark, queries, targets, tables.read_tsv(spark, a.truth), a.work, a.sample, a.folds, a.trees, a.rate, a.path, files, **settings), sort_keys=True))
    elif a.command == "benchmark":
        print(json.dumps(runs.benchmark(spark, queries, a.work, a.queries, queries.count()), sort_keys=True))
    elif a.command == "predict":
        runs.predict(spark, queries, a.work, a.out, a.part, a.parts, targets, a.batches, print, files)
    elif a.command == "merge":
        runs.merge(spark, queries, a.out, targets)
    else:
        errors, warnings = outputs.validate(spark, a.matches, a.candidates, queries, None if a.skip_id_check else targets)
        for kind, messages in (("warning", warnings), ("error", errors)):
            for message in messages:
                print(f"{kind}: {message}")
        return int(bool(errors))
    return 0


if __name__ == "__main__":
    sys.exit(main())
