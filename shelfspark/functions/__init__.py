from shelfspark.functions.dates import date_key, month_index, month_start, months_before
from shelfspark.functions.money import as_money, exact, line_amount, round_half_away, safe_div, times
from shelfspark.functions.privacy import pseudonymise

__all__ = [
    "date_key", "month_index", "month_start", "months_before",
    "as_money", "exact", "line_amount", "round_half_away", "safe_div", "times", "pseudonymise",
]
