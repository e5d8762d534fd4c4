"""Write the physical plan tree of every registered query to PLANS.md.

usage: python tools/explain_all.py [sf_dir]

Only the operator tree and the scan lines (pushed filters, read schema) are
kept. Steps that run eagerly while a query is built (model and scaler fits,
the measured broadcast sides, the range bounds) appear in the tree as their
materialised results (``Scan ExistingRDD`` for a checkpoint).
"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortlab.plans.queries import REGISTRY  # noqa: E402
from cohortlab.session import build_session  # noqa: E402


def tree(df) -> str:
    txt = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    lines = txt.splitlines()
    out, in_tree = [], True
    for ln in lines:
        if in_tree:
            if ln.strip() == "" and out:
                in_tree = False
                continue
            out.append(ln)
        elif re.match(r"^(PushedFilters|ReadSchema):", ln):
            out.append("    " + ln)
    return "\n".join(out)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    parts = ["# PLANS", "",
             f"Physical plans of the registered queries (`tools/explain_all.py`, tables `{sf}`, "
             "local session, AQE on; before execution, so AQE's runtime changes are not shown).",
             ""]
    for k, fn in REGISTRY.items():
        parts += [f"## {k}", "", "```", tree(fn(spark, sf)), "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(parts))
    print(path)


if __name__ == "__main__":
    main()
