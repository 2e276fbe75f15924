"""Write PLANS.md: physical plans (after AQE, from a real run at sf0.01) of
the operators whose shape matters at scale."""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tiercraft.config import COMPANY_PROFILE_TOP  # noqa: E402
from tiercraft.functions.text import PY_WHITESPACE  # noqa: E402
from tiercraft.operators import quality, quantiles, rollup, trend, worklist  # noqa: E402
from tiercraft.plans import catalog  # noqa: E402
from tiercraft.session import build_session  # noqa: E402
from tiercraft.sources import fixtures as fx  # noqa: E402

SF = "/root/testdata/sf0.01"


def plan_text(df) -> str:
    df.collect()        # run it, so the adaptive plan shows the final strategy
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    text = buf.getvalue().split("== Physical Plan ==", 1)[-1]
    if "== Final Plan ==" in text:
        text = text.split("== Final Plan ==", 1)[1].split("+- == Initial Plan ==", 1)[0]
    text = re.sub(r"#\d+L?", "", text)
    text = re.sub(r", \[plan_id=\d+\]", "", text)
    # the whitespace set of the id trim is printed raw: name it instead
    text = text.replace(PY_WHITESPACE, "<Python whitespace set>")
    return "".join(c if c.isprintable() or c == "\n" else repr(c)[1:-1] for c in text)


def _round(df):
    with quantiles._Values(df, ["amount", "days_since_ship"]) as values:
        (_, lo, hi), (_, dlo, dhi) = values.stats()
        return quantiles._Values(df, ["amount", "days_since_ship"]).bins([(0, lo, hi), (1, dlo, dhi)])


def main() -> None:
    spark = build_session("local[8]", 8)
    seg, _ = catalog.players_segmented(spark, SF)
    seg = seg.persist()
    seg.count()
    cseg, _ = catalog.companies_segmented(spark, SF)
    sections = [
        ("Derived players table: orders aggregated per customer before the join",
         fx.players(spark, SF)),
        ("Quarantine: repeated ids from (id, row order) pairs only, joined back; rows without an "
         "id carry join keys of their own",
         quality.classify_identity(fx.players_dirty(spark, SF), "PlayerID")),
        ("Quarantine of the order lines, in which many ids repeat",
         quality.classify_identity(fx.lines(spark, SF), "line_id")),
        ("segment_lines: the quarantined lines come from a checkpoint, cuts are literals",
         catalog.q_segment_lines(spark, SF)),
        ("Quantiles, one round for two columns: bins are counted map-side, one aggregate",
         _round(fx.lines(spark, SF))),
        ("Worklist rank: range-partitioned rows from a checkpoint, offsets broadcast (a row per "
         "partition), window inside each partition",
         worklist.host_worklist(seg, id_col="PlayerID")),
        ("Trend: deduplicated prior (min_by aggregate), join left to the planner",
         trend.apply_trend(seg.drop("NetADT_Prev", "TrendPct", "Trend"),
                           fx.prior(spark, SF), "PlayerID")),
        ("Value table: partial aggregation, window only over the aggregated segments",
         rollup.value_table(seg, "PlayerID", "NetADT")),
        ("Top 10 per segment: WindowGroupLimit before and after the shuffle",
         worklist.top_per_segment(seg, "NetADT", "PlayerID")),
        ("Top 10 overall: TakeOrderedAndProject", worklist.top_records(seg, "NetADT", "PlayerID")),
        ("Top 3 values per column: WindowGroupLimit", rollup.top_categories(cseg,
                                                                          COMPANY_PROFILE_TOP)),
        ("Pareto: one aggregate, window over four rows", rollup.pareto(fx.offers(spark, SF))),
    ]
    out = ["# Physical plans", "",
           "Generated by `scripts/dump_plans.py` (executed at sf0.01 on local[8], so the",
           "adaptive plans show the strategy chosen at run time). Expression ids removed.", ""]
    for title, df in sections:
        out += [f"## {title}", "", "```", plan_text(df).rstrip(), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                           "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
