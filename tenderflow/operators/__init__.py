from tenderflow.operators.keys import (
    asked,
    business_dates,
    on_dates,
    original_transactions,
    session_matches,
)
from tenderflow.operators.listings import ordered_listing, property_summary
from tenderflow.operators.lookups import scalar_lookup
from tenderflow.operators.stores import by_eligibility, eligible_stores, newest_pushes
from tenderflow.operators.surplus import surplus_over

__all__ = [
    "asked", "business_dates", "by_eligibility", "eligible_stores", "newest_pushes", "on_dates",
    "ordered_listing", "original_transactions", "property_summary", "scalar_lookup",
    "session_matches", "surplus_over",
]
