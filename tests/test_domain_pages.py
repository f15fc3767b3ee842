"""Every table of every page, built from the driver-table mappings (sf0.001)."""

import pytest

from tabprobe.plans import q_domains as qd
from tabprobe.plans.domains import (bank_marketing, bank_stocks, card_fraud, game_catalogue, loan_default,
                                    medical_cost, online_retail, taxi_trips, video_game_sales)

from conftest import SF_SMALL

PAGES = {
    "bank_marketing": (bank_marketing, qd.bank_view, {}),
    "card_fraud": (card_fraud, qd.fraud_view, {}),
    "loan_default": (loan_default, qd.loan_view, {}),
    "medical_cost": (medical_cost, qd.medical_view, {}),
    "taxi_trips": (taxi_trips, qd.taxi_view, {}),
    "online_retail": (online_retail, qd.retail_view, {}),
    "bank_stocks": (bank_stocks, qd.stocks_view, {}),
    "game_catalogue": (game_catalogue, qd.games_view, {}),
    "video_game_sales": (video_game_sales, qd.vgs_view, {}),
}


@pytest.mark.parametrize("page", sorted(PAGES))
def test_page_builds_every_table(spark, page):
    mod, view, kw = PAGES[page]
    tables = mod.run(view(spark, SF_SMALL), **kw)
    assert tables
    for name, df in tables.items():
        if df is not None:
            df.count()
