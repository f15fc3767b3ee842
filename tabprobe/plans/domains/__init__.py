"""Domain pipelines: one module per dataset page.

Every module offers ``clean`` / ``features`` / ``apply_filters`` and a
``results`` function returning named lazy result tables.  Features are
computed before the filters (they see unfiltered rows), as on the pages.
"""

from tabprobe.plans.domains import (  # noqa: F401
    bank_marketing, bank_stocks, card_fraud, game_catalogue, loan_default, medical_cost,
    online_retail, taxi_trips, video_game_sales)
from tabprobe.plans.domains.common import profile_tables  # noqa: F401
