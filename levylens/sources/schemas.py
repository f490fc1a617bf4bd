"""Schemas of the raw tables. The open-data portal delivers every value as text."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, StringType, StructField, StructType


def _text(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


INCOME_V1 = _text(
    "tax_year", "state", "county", "income_class", "income_class_sort_order",
    "place_of_residence_sort_order", "number_of_all_returns",
    "ny_agi_of_all_returns_in_thousands", "tax_liability_of_all_returns_in_thousands",
)

INCOME_V2 = _text(
    "tax_year", "state", "county", "place_of_residence", "tax_liability_status",
    "number_of_returns", "new_york_state_amount_of_ny_adjusted_gross_income",
    "federal_amount_of_ny_adjusted_gross_income", "tax_liability",
    "number_filing_married_separate_or_widow_widower",
)

SALES = _text(
    "jurisdiction", "sales_tax_year", "sales_tax_quarter", "selling_period",
    "naics_industry_group", "description", "taxable_sales_and_purchases",
)

SECTORS = StructType(
    [StructField("sector", DoubleType()), StructField("sector_description", StringType())]
)
