from tillroll.functions.dates import day_gap, in_year, in_years, month_of, year_month
from tillroll.functions.labels import income_band, is_private_label
from tillroll.functions.stats import corr_matrix, exact_avg, money_sum, pearson, ratio

__all__ = [
    "day_gap",
    "in_year",
    "in_years",
    "month_of",
    "year_month",
    "income_band",
    "is_private_label",
    "corr_matrix",
    "exact_avg",
    "money_sum",
    "pearson",
    "ratio",
]
