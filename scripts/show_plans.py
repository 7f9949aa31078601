"""Write PLANS.md: formatted physical plans of the headline queries.

Usage: python scripts/show_plans.py [sf_dir]
"""

from __future__ import annotations

import sys

sys.path.insert(0, ".")
from attrix.plans.catalog import load_all  # noqa: E402
from attrix.session import get_spark  # noqa: E402

NAMES = ["agg_10_segment_two_keys", "agg_17_describe_lineitem", "spl_1_stratified_split", "ml_auc",
         "agg_16_crosstab_lineitem", "flt_9_outside_range"]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark()
    reg = load_all()
    out = ["# Physical plans of headline queries", "",
           f"Generated by `scripts/show_plans.py` at `{sf}` (local mode; AQE re-plans at run time).", ""]
    for name in NAMES:
        df = reg[name][0](spark, sf)
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        out += [f"## {name}", "", "```", plan.split("\n\n(1)")[0].strip(), "```", ""]
    with open("PLANS.md", "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
