"""Panel schema: the four base tables and the columns the analyses use.

Names are lower-case snake case; Spark resolves them case-insensitively, so source files
with mixed-case headers (``TC_id``, ``TC_date``) map onto them unchanged.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

HOUSEHOLDS = T.StructType(
    [
        T.StructField("hh_id", T.LongType()),
        T.StructField("hh_income", T.IntegerType()),
        T.StructField("hh_state", T.StringType()),
    ]
)

PRODUCTS = T.StructType(
    [
        T.StructField("prod_id", T.LongType()),
        T.StructField("department_at_prod_id", T.StringType()),
        T.StructField("group_at_prod_id", T.StringType()),
        T.StructField("module_at_prod_id", T.StringType()),
        T.StructField("brand_at_prod_id", T.StringType()),
    ]
)

TRIPS = T.StructType(
    [
        T.StructField("tc_id", T.LongType()),
        T.StructField("hh_id", T.LongType()),
        T.StructField("tc_date", T.DateType()),
        T.StructField("tc_retailer_code", T.StringType()),
        T.StructField("tc_total_spent", MONEY),
    ]
)

PURCHASES = T.StructType(
    [
        T.StructField("tc_id", T.LongType()),
        T.StructField("prod_id", T.LongType()),
        T.StructField("quantity_at_tc_prod_id", T.IntegerType()),
        T.StructField("total_price_paid_at_tc_prod_id", MONEY),
        T.StructField("deal_flag_at_tc_prod_id", T.IntegerType()),
    ]
)

SCHEMAS: dict[str, T.StructType] = {
    "households": HOUSEHOLDS,
    "products": PRODUCTS,
    "trips": TRIPS,
    "purchases": PURCHASES,
}

# Fixed values of the panel study:
# - private-label brand code
# - household income bands (inclusive income-code ranges; None = open upper end)
# - a "month" of trip gaps is 30 days; a gap of more than 3 such months marks inactivity
# - households active in all 12 calendar months; spend averaged over a fixed 12 months
# - loyalty thresholds: one retailer with at least 80 %, two retailers together above 80 %
PRIVATE_LABEL_BRAND = "CTL BR"
INCOME_BANDS = (("low", 3, 15), ("mid", 16, 21), ("high", 22, None))
DAYS_PER_MONTH = 30
INACTIVE_MONTHS = 3
ACTIVE_MONTHS = 12
SPEND_MONTHS = 12
SINGLE_LOYAL_SHARE = 80
PAIR_LOYAL_SHARE = 80

# Partition column of the year layout (sources.layout).
YEAR_COL = "tc_year"
