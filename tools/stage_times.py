"""Per-stage wall time of prepare + train + evaluate, from Spark's event log.

The event log goes to a fresh scratch folder (no UI, no server). Jobs are
labelled by ``setJobDescription`` in the plans; time is summed per label.
usage: python tools/stage_times.py [sf_dir] [factors] [iterations]
"""
import glob
import io
import json
import os
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def read_events(log_dir):
    import zstandard
    for path in sorted(glob.glob(os.path.join(log_dir, "**", "events_*"), recursive=True)
                       + glob.glob(os.path.join(log_dir, "local-*"))):
        raw = open(path, "rb")
        if path.endswith(".zstd"):
            raw = zstandard.ZstdDecompressor().stream_reader(raw)
        for line in io.TextIOWrapper(raw, encoding="utf-8"):
            yield json.loads(line)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    k = int(sys.argv[2]) if len(sys.argv) > 2 else 64
    iters = int(sys.argv[3]) if len(sys.argv) > 3 else 2
    log_dir = tempfile.mkdtemp(prefix="fernrec-evlog-")
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from fernrec.config import ModelConfig, RuntimeConfig
    from fernrec.operators.scoring import evaluate
    from fernrec.plans.prepare import prepare
    from fernrec.plans.train import train
    from fernrec.sources.tables import order_line_interactions
    m = ModelConfig(factors=k, iterations=iters, min_user_interactions=23,
                    min_item_interactions=23)
    prep = prepare(order_line_interactions(spark, sf_dir), m)
    model = train(prep, m, RuntimeConfig())
    spark.sparkContext.setJobDescription("fernrec evaluate")
    evaluate(prep.test, prep.train, model.p, model.q, m.topk, prep.num_users,
             prep.num_items)[1].collect()
    spark.stop()

    job_label, stage_job, stage_time = {}, {}, defaultdict(float)
    for e in read_events(log_dir):
        ev = e["Event"]
        if ev == "SparkListenerJobStart":
            label = (e.get("Properties") or {}).get("spark.job.description") or "(unlabelled)"
            job_label[e["Job ID"]] = label
            for sid in e["Stage IDs"]:
                stage_job[sid] = e["Job ID"]
        elif ev == "SparkListenerStageCompleted":
            info = e["Stage Info"]
            if "Submission Time" in info and "Completion Time" in info:
                label = job_label.get(stage_job.get(info["Stage ID"]), "(unlabelled)")
                stage_time[label] += (info["Completion Time"] - info["Submission Time"]) / 1e3
    for label, sec in sorted(stage_time.items(), key=lambda kv: -kv[1]):
        print(f"{sec:8.2f} s  {label}")
    print(f"event log: {log_dir}")


if __name__ == "__main__":
    main()
