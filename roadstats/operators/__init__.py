from roadstats.operators.closed import essential_rules, mark_itemsets
from roadstats.operators.counts import count_by, count_dimensions, rank_in_group, top_groups
from roadstats.operators.distinct import (
    compare_sketches,
    distinct_by,
    distinct_sketches,
    distinct_with_totals,
    merge_sketches,
    sketch_counts,
)
from roadstats.operators.heavy import bucket_counts, merge_buckets, top_values
from roadstats.operators.integrity import childless_keys, integrity, key_presence, orphan_keys
from roadstats.operators.joins import join_for_count
from roadstats.operators.nest import nest, nest_dimensions, nest_map
from roadstats.operators.recode import recode_groups
from roadstats.operators.rules import (
    baseline_from_counts,
    baseline_from_rules,
    count_itemsets,
    filter_rules,
    inverse_log_score,
    itemsets,
    mine_rules,
    ratio_score,
    rule_lines,
    score_rules,
)
from roadstats.operators.series import months_by, with_trend
from roadstats.operators.significance import adjusted, chi_squared, rule_counts, significant_rules
from roadstats.operators.support import supported_itemsets, supported_rules
from roadstats.operators.totals import with_totals

__all__ = [
    "adjusted",
    "baseline_from_counts",
    "baseline_from_rules",
    "bucket_counts",
    "chi_squared",
    "childless_keys",
    "compare_sketches",
    "count_by",
    "count_dimensions",
    "count_itemsets",
    "distinct_by",
    "distinct_sketches",
    "distinct_with_totals",
    "essential_rules",
    "filter_rules",
    "integrity",
    "inverse_log_score",
    "itemsets",
    "join_for_count",
    "key_presence",
    "mark_itemsets",
    "merge_buckets",
    "merge_sketches",
    "mine_rules",
    "months_by",
    "nest",
    "nest_dimensions",
    "nest_map",
    "orphan_keys",
    "rank_in_group",
    "ratio_score",
    "recode_groups",
    "rule_counts",
    "rule_lines",
    "score_rules",
    "significant_rules",
    "sketch_counts",
    "supported_itemsets",
    "supported_rules",
    "top_groups",
    "top_values",
    "with_totals",
    "with_trend",
]
