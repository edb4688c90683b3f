"""Write the physical plans of the headline queries to docs/PLANS.md.

Usage: python tools/plans.py [sf_dir]
"""

from __future__ import annotations

import io
import os
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from netvigil.plans.catalog import QUERIES  # noqa: E402
from netvigil.session import get_session  # noqa: E402

KEYS = ["e8_decision_summary", "l2_threat_list", "w1_packet_size_stats", "w1_keyed_packet_size_stats",
        "j2_flow_fan", "x4_stratified_split", "a3_classification_report", "a13_health_check",
        "x3_training_sets"]


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session()
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `tools/plans.py` on `{sf_dir}` (AQE shows the initial plan).", ""]
    for k in KEYS:
        buf = io.StringIO()
        with redirect_stdout(buf):
            QUERIES[k](spark, sf_dir).explain("formatted")
        text = buf.getvalue()
        out += [f"## {k}", "", "```", text.strip(), "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md")
    with open(path, "w") as fh:
        fh.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
