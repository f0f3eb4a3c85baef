"""Headline queries at one scale on one machine; prints a single JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs once after a short warm-up and is written to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cuestream import catalog  # noqa: E402
from cuestream.plans.session import build_session  # noqa: E402

HEADLINE = (
    "tim12_idle_regions", "tim14_post_process", "tim01_estimate_lines", "tim02_interpolate_words", "tim11_snap_to_beats",
    "tim15_sequential_scenes", "tim16_anchored_scenes", "tim26_timed_import", "join01_signature_merge", "join03_nearest",
    "join04_active_cue", "join05_visible_cues", "join08_unreferenced_assets", "join12_first_fit_level", "join15_resample_down",
    "txt01_normalize_display", "txt02_match_signature", "txt11_sentences", "txt14_block_kinds", "agg01_peak_buckets",
    "agg04_repeated_lines", "agg09_dedupe_by_hash", "agg12_export_totals", "agg14_bundle_id", "sig07_smooth_and_scale",
    "sig08_tempo", "sig14_ctc_decode", "seq01_debounce", "seq02_line_sections", "seq04_align_corpus", "seq08_coalesce_edits",
    "src02_lrc_cues", "src04_srt_cues", "src08_json_cues", "snk03_srt", "dq01_validate_projects", "dq03_migrate_projects",
    "str01_sanitise_events", "str04_counter_roll_up", "str06_presence",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    catalog.load()
    only = sys.argv[1:]
    names = [n for n in HEADLINE if not only or any(o in n for o in only)]
    catalog.QUERIES["tim12_idle_regions"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
