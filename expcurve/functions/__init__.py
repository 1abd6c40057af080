from .nasafe import (categorise, complete_years, distinct_list, grepl,
                     literal_lookup, not_grepl, ordinal, pivot_checked, separate, strict_cumsum,
                     strict_sum, sum_na_rm, to_number, unpivot)

__all__ = ["categorise", "complete_years", "distinct_list", "grepl",
           "literal_lookup", "not_grepl", "ordinal", "pivot_checked", "separate",
           "strict_cumsum", "strict_sum", "sum_na_rm", "to_number", "unpivot"]
