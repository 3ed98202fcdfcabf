"""Command line: prepare -> train -> evaluate -> save artifacts.

    python -m fernrec --text /data/reviews/ --out /shared/run1
    python -m fernrec --table /data/events.parquet --user user_id \
        --item item_id --ts ts --out /shared/run1 --factors 64 --iterations 20

Prints the metrics as JSON. On a cluster run it with spark-submit and set
``spark.checkpoint.dir`` to a shared folder.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields

from .config import ModelConfig, RuntimeConfig

# shorter names of some options
SHORT = {"min_user_interactions": ("--min-user",), "min_item_interactions": ("--min-item",),
         "random_seed": ("--seed",)}


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="fernrec")
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--text", help="review text file(s) or folder")
    src.add_argument("--table", help="Parquet table with user, item and time columns")
    ap.add_argument("--user", default="user_id")
    ap.add_argument("--item", default="item_id")
    ap.add_argument("--ts", default="ts")
    ap.add_argument("--out", required=True, help="artifact folder")
    ap.add_argument("--state", help="folder on the shared store; a run that was lost goes on from it")
    ap.add_argument("--master", default=None, help="e.g. local[8]; default: from spark-submit")
    # every other option is a field of ModelConfig or RuntimeConfig
    for config in (ModelConfig, RuntimeConfig):
        for field in fields(config):
            kind = {"int": int, "float": float, "str": str}[field.type.split(" |")[0]]
            names = [f"--{field.name.replace('_', '-')}", *SHORT.get(field.name, ())]
            ap.add_argument(*names, dest=field.name, type=kind, default=field.default)
    args = ap.parse_args(argv)
    if args.table and args.mode == "smoke":
        ap.error("--mode smoke samples review text; it does not apply to --table")
    model, runtime = (config(**{f.name: getattr(args, f.name) for f in fields(config)})
                      for config in (ModelConfig, RuntimeConfig))

    from pyspark.sql import SparkSession

    from .plans.end_to_end import load_review_text, metrics_json, run, save_artifacts
    from .sources.tables import interactions_from_table

    builder = SparkSession.builder.appName("fernrec")
    if args.master:
        builder = builder.master(args.master)
    spark = builder.getOrCreate()
    if args.text:
        interactions = load_review_text(spark, args.text, runtime)
    else:
        interactions = interactions_from_table(spark.read.parquet(args.table), args.user,
                                               args.item, args.ts)
    result = run(interactions, model, runtime, args.state)
    save_artifacts(result, args.out, model)
    print(metrics_json(result.metrics))
    return 0


if __name__ == "__main__":
    sys.exit(main())
