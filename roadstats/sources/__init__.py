from roadstats.sources.counts import (
    apply_changes,
    count_changes,
    period_counts,
    replace_periods,
    save_period_counts,
)
from roadstats.sources.raw import (
    corrupt_records,
    good_records,
    hidden_files,
    parse_records,
    read_clean_lines,
    read_entity,
    read_raw,
    refuse_hidden,
    repair_lines,
    routed_lines,
    unrouted_lines,
    validation_counts,
    write_clean_lines,
)
from roadstats.sources.store import (
    as_json,
    bad_baseline,
    load,
    load_baseline,
    save_documents,
    save_rules,
)

__all__ = [
    "apply_changes",
    "as_json",
    "bad_baseline",
    "corrupt_records",
    "count_changes",
    "good_records",
    "hidden_files",
    "load",
    "load_baseline",
    "parse_records",
    "period_counts",
    "read_clean_lines",
    "read_entity",
    "read_raw",
    "refuse_hidden",
    "repair_lines",
    "replace_periods",
    "routed_lines",
    "save_documents",
    "save_period_counts",
    "save_rules",
    "unrouted_lines",
    "validation_counts",
    "write_clean_lines",
]
