"""Print the physical plans of the main operators (``explain("formatted")``).

usage: python tools/explain_plans.py [sf_dir] [mode]
What to look for: column-pruned ``ReadSchema`` and ``PushedFilters`` on the
scans, ``partial_*`` aggregates before each ``Exchange``, no ``Exchange`` on
the bucketed history side of the half-step cogroup, broadcasts only of the
bounded offset table or of sides AQE measured as small.
"""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import numpy as np  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    mode = sys.argv[2] if len(sys.argv) > 2 else "formatted"
    from fernrec.config import ModelConfig, RuntimeConfig
    from fernrec.operators import prepare as P
    from fernrec.operators.halfstep import half_step
    from fernrec.operators.scoring import heldout_rank, recommend_topk
    from fernrec.plans.prepare import prepare
    from fernrec.plans.train import initial_factors, layouts
    from fernrec.session import get_session
    from fernrec.sources.tables import events_interactions, order_line_interactions

    spark = get_session("local[8]", 8)
    m = ModelConfig(factors=8, c0=16.0, min_user_interactions=10, min_item_interactions=10)
    dd = P.dedup_latest(order_line_interactions(spark, sf_dir))
    plans = {"dedup (OL)": dd,
             "k-core round": P.filter_min_count(P.filter_min_count(dd, "user_id", 10),
                                                "item_id", 10),
             "dense index": P.dense_index(dd, "user_id", "user_idx")}
    prep = prepare(events_interactions(spark, sf_dir), m)
    sp = P.leave_one_out(prep.indexed)
    plans["split: test"] = sp.test
    plans["split: train"] = sp.train
    p, q = initial_factors(prep, m)
    ul, il = layouts(prep, RuntimeConfig(heavy_threshold=60))
    plans["user half-step"] = half_step(ul, p, q, np.eye(8), 0.01)
    plans["held-out rank"] = heldout_rank(prep.test, prep.train, p, q, prep.num_users,
                                          prep.num_items, 64, 32)
    plans["top-k"] = recommend_topk(prep.test, prep.train, p, q, 10, prep.num_users,
                                    prep.num_items, 64, 32)
    for name, df in plans.items():
        print(f"\n===== {name} =====")
        df.explain(mode)


if __name__ == "__main__":
    main()
