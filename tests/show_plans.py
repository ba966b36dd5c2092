"""Write PLANS.md: physical plans of representative queries at sf0.01.

    python -m tests.show_plans
"""

from __future__ import annotations

import io
import os
import sys
from contextlib import redirect_stdout

NAMES = [
    ("shard_batch_summary", "flagship: offsets from staged range slices, bounded correction table, partial aggregates"),
    ("retain_by_time", "retention: scalar subquery for the newest time, ts-only scan, no cross join"),
    ("lookup_parent", "parent lookup: the optimizer picks the broadcast side, pushed region filter"),
    ("latest_by", "latest per key: partial max_by (sort-based), no window"),
    ("member_sessions", "sessions: gap scan over staged slices, bounded correction table, partial aggregate"),
    ("match_single_attachment", "single attachment: hash aggregate of count + min, then joins"),
    ("expand_slots", "slot expansion: chunks dealt round-robin before they are exploded"),
]


def main() -> None:
    from shardline.session import build_session
    import __spark_entry__ as entry
    spark = build_session("local[8]")
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    q = entry.queries()
    out = ["# Physical plans of representative queries", "",
           f"Generated by `python -m tests.show_plans` on `{sf}` (local[8], AQE on; plans before AQE re-planning).",
           "A `Scan ExistingRDD` is the checkpointed slice frame of an ordered scan.", ""]
    for name, why in NAMES:
        buf = io.StringIO()
        with redirect_stdout(buf):
            q[name](spark, sf).explain("simple")
        text = "\n".join(line[:240] for line in buf.getvalue().strip().splitlines())
        out += [f"## `{name}`", "", why + ".", "", "```", text, "```", ""]
    # a streaming plan: hourly counts over a file stream of events
    from shardline.sources.tables import load
    from shardline.streaming import jobs
    ev = load(spark, sf, "events")
    stream = spark.readStream.schema(ev.schema).parquet(f"{sf}/events.parquet")
    buf = io.StringIO()
    with redirect_stdout(buf):
        jobs.hourly_counts(stream, "ts").explain("simple")
    text = "\n".join(line[:240] for line in buf.getvalue().strip().splitlines())
    out += ["## `hourly_counts` (stream)", "",
            "retention stream: partial count per window before the state store exchange, watermark-bounded state.",
            "", "```", text, "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out))
    print(path)


if __name__ == "__main__":
    main()
