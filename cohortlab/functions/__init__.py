from cohortlab.functions.columns import (all_of, contains, encode_binary, match_flag,
                                         min_max_scale, negate, null_count, null_heavy,
                                         split_bucket)

__all__ = ["all_of", "contains", "encode_binary", "match_flag", "min_max_scale", "negate",
           "null_count", "null_heavy", "split_bucket"]
