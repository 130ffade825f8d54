from datetime import date

import pytest
from conftest import SESSIONS

from sitepulse.plans import dashboard


@pytest.fixture(scope="module")
def table(spark, raw_rows):
    return dashboard.dashboard_table(spark.createDataFrame(raw_rows, SESSIONS))


def test_every_table_has_rows(table):
    pages = {
        **dashboard.overview_page(table),
        **dashboard.site_page(table),
        **dashboard.state_page(table, date(2024, 1, 1), date(2024, 1, 2)),
        **dashboard.feature_page(table),
    }
    empty = [name for name, df in pages.items() if df.isEmpty()]
    assert empty == [] and len(pages) >= 15


def test_pages_read_only_their_columns(table):
    plan = dashboard.overview_page(table)["daily_total"]._jdf.queryExecution().executedPlan()
    assert "ReadSchema: struct<hour:timestamp_ntz,sessions:double>" in plan.toString()


def test_chosen_sites(table):
    rows = dashboard.site_page(table, [2])["comparison"].collect()
    assert {r["site_id"] for r in rows} == {2}
