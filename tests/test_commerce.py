"""Commerce questions on hand-made orders (FIXTURES.md section 3)."""

import datetime as dt

import pytest

from cartlytics.operators import cohort, commerce, rfm
from tests.conftest import rows

ORD = "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp_ntz"
CUST = "customer_id string, customer_unique_id string"


def ts(y, m, d=1):
    return dt.datetime(y, m, d, 12, 0)


@pytest.fixture
def cust_orders(spark):
    def make(orders, customers=None):
        o = spark.createDataFrame(orders, ORD)
        if customers is None:
            customers = sorted({(r[1], r[1]) for r in orders})
        c = spark.createDataFrame(customers, CUST)
        return commerce.customer_orders(c, o)
    return make


def test_one_time_buyers(cust_orders):
    co = cust_orders([
        ("o1", "a1", "delivered", ts(2017, 1)), ("o2", "a2", "canceled", ts(2017, 2)),
        ("o3", "b1", "delivered", ts(2017, 1)), ("o4", "b2", "delivered", ts(2017, 3))],
        [("a1", "A"), ("a2", "A"), ("b1", "B"), ("b2", "B")])
    assert commerce.one_time_buyers(co).collect()[0].one_time_buyers == 1


def test_null_status_counts_as_purchase(cust_orders):
    co = cust_orders([("o1", "a", None, ts(2017, 1)), ("o2", "a", "delivered", ts(2017, 2))])
    assert commerce.one_time_buyers(co).collect()[0].one_time_buyers == 0


def test_undelivered_mean_over_observed_months(cust_orders):
    data = ([(f"c{i}", "x", "canceled", ts(2017, 1)) for i in range(2)]
            + [(f"d{i}", "x", "canceled", ts(2017, 3)) for i in range(4)]
            + [(f"u{i}", "x", "unavailable", ts(2017, 2)) for i in range(3)]
            + [("z", "x", "delivered", ts(2017, 2))])
    out = dict(rows(commerce.undelivered_by_reason(cust_orders(data))))
    assert out == {"canceled": 3.0, "unavailable": 3.0}


def test_top_weekday_tie_goes_to_first_name(spark):
    o = spark.createDataFrame([
        ("o1", "c", "delivered", dt.datetime(2017, 3, 3)),   # Friday
        ("o2", "c", "delivered", dt.datetime(2017, 3, 10)),  # Friday
        ("o3", "c", "delivered", dt.datetime(2017, 3, 7)),   # Tuesday
        ("o4", "c", "delivered", dt.datetime(2017, 3, 14)),  # Tuesday
        ("o5", "c", "canceled", dt.datetime(2017, 3, 13))],  # Monday, not a purchase
        ORD)
    items = spark.createDataFrame([(f"o{i}", "p1") for i in range(1, 6)] + [("o5", "p1")],
                                  "order_id string, product_id string")
    out = rows(commerce.top_weekday_per_product(o, items))
    assert out == [("p1", "Friday", 2)]


def test_purchases_per_week(cust_orders):
    data = [("a", "x", "delivered", ts(2017, 2, 3)), ("b", "x", "delivered", ts(2017, 2, 9)),
            ("c", "x", "delivered", ts(2017, 3, 1)), ("d", "x", "delivered", ts(2017, 3, 2)),
            ("e", "x", "delivered", ts(2017, 3, 5))]
    out = {r.year_month: r.avg_purchases_per_week
           for r in commerce.purchases_per_week(cust_orders(data)).collect()}
    assert out[dt.date(2017, 2, 1)] == pytest.approx(0.5)
    assert out[dt.date(2017, 3, 1)] == pytest.approx(0.677419, abs=1e-6)


def test_cohort_proper_vs_compat(cust_orders):
    data = [("o1", "x", "canceled", ts(2017, 1)), ("o2", "x", "delivered", ts(2017, 3)),
            ("o3", "x", "delivered", ts(2017, 5))]
    proper = rows(cohort.cohort_retention(cust_orders(data), mode="proper"),
                  "year_month", "month_offset", "customers_quantity", "percentage")
    assert proper == [(dt.date(2017, 3, 1), 0, 1, 100.0), (dt.date(2017, 5, 1), 2, 1, 100.0)]
    compat = rows(cohort.cohort_retention(cust_orders(data), mode="compat"), "year_month", "month_offset")
    assert (dt.date(2017, 1, 1), -2) in compat and len(compat) == 3


def test_cohort_n_periods_per_cohort(cust_orders):
    data = [(f"o{m}", "x", "delivered", ts(2017, m)) for m in range(1, 6)]
    r = cohort.cohort_retention(cust_orders(data), n_periods={"2017-01": 3})
    assert len(r.collect()) == 3


def test_best_cohort_picks_highest_third_month(cust_orders):
    data = ([("a1", "a", "delivered", ts(2017, 1)), ("a2", "a", "delivered", ts(2017, 3))]
            + [("b1", "b", "delivered", ts(2017, 2)), ("c1", "c", "delivered", ts(2017, 2)),
               ("b2", "b", "delivered", ts(2017, 4))])
    best = rows(cohort.best_cohort(cohort.cohort_retention(cust_orders(data))), "cohort", "percentage")
    assert best == [(dt.date(2017, 1, 1), 100.0)]


def test_rfm_end_to_end(spark, cust_orders):
    data = [(f"o{i}", f"c{i % 5}", "delivered", ts(2017, 1 + i % 12, 1 + i % 27)) for i in range(40)]
    co = cust_orders(data)
    items = spark.createDataFrame([(f"o{i}", float(10 + i)) for i in range(40)] + [("o1", None)],
                                  "order_id string, price double")
    base = rfm.rfm_base(co, items, as_of=dt.date(2018, 1, 1), period_days=200)
    segs = rfm.rfm_segments(rfm.rfm_scores(base))
    got = segs.collect()
    assert len(got) == 5
    for r in got:
        assert 1 <= r.r <= 5 and 1 <= r.f <= 5 and 1 <= r.m <= 5
    shares = rfm.segment_shares(segs).collect()
    assert abs(sum(r.percentage for r in shares) - 100) < 1e-6


def test_best_cohort_by_observed_row_in_compat_mode(cust_orders):
    # person x: an unpaid order in Jan before the first paid order in Mar
    data = [("o1", "x", "canceled", ts(2017, 1)), ("o2", "x", "delivered", ts(2017, 3)),
            ("o3", "x", "delivered", ts(2017, 5)),
            ("p1", "y", "delivered", ts(2017, 3)), ("p2", "y", "delivered", ts(2017, 4))]
    compat = cohort.cohort_retention(cust_orders(data), mode="compat")
    by_row = rows(cohort.best_cohort(compat, 3, position="row"), "cohort", "customers_quantity")
    assert by_row == [(dt.date(2017, 3, 1), 1)]   # third observed month of the Mar cohort is Apr
    by_offset = rows(cohort.best_cohort(compat, 3), "cohort", "customers_quantity")
    assert by_offset == [(dt.date(2017, 3, 1), 1)]  # offset 2 is May


def test_undelivered_fill_missing_months(cust_orders):
    data = ([(f"c{i}", "x", "canceled", ts(2017, 1)) for i in range(2)]
            + [(f"d{i}", "x", "canceled", ts(2017, 3)) for i in range(4)]
            + [(f"u{i}", "x", "unavailable", ts(2017, 2)) for i in range(3)])
    out = dict(rows(commerce.undelivered_by_reason(cust_orders(data), fill_missing_months=True)))
    assert out == {"canceled": 2.0, "unavailable": 1.0}


def test_cohort_range_and_period_mapping(cust_orders):
    data = ([(f"a{m}", "a", "delivered", ts(2017, m)) for m in range(1, 6)]
            + [(f"b{m}", "b", "delivered", ts(2017, m)) for m in range(2, 6)])
    co = cust_orders(data)
    only_feb = rows(cohort.cohort_retention(co, cohort_from="2017-02-01", cohort_to="2017-02-28"),
                    "cohort", "month_offset", "percentage")
    assert only_feb == [(dt.date(2017, 2, 1), k, 100.0) for k in range(4)]
    limited = cohort.cohort_retention(co, n_periods={"2017-01": 2, "2017-02": 3})
    counts = {}
    for r in limited.collect():
        counts[r.cohort] = counts.get(r.cohort, 0) + 1
    assert counts == {dt.date(2017, 1, 1): 2, dt.date(2017, 2, 1): 3}


def test_cohorts_without_a_limit_stay_whole(cust_orders):
    data = ([(f"a{m}", "a", "delivered", ts(2017, m)) for m in range(1, 6)]
            + [(f"b{m}", "b", "delivered", ts(2017, m)) for m in range(2, 6)])
    co = cust_orders(data)
    counts = {}
    for r in cohort.cohort_retention(co, n_periods={"2017-01": 2}).collect():
        counts[r.cohort] = counts.get(r.cohort, 0) + 1
    assert counts == {dt.date(2017, 1, 1): 2, dt.date(2017, 2, 1): 4}
    assert cohort.cohort_retention(co, n_periods={}).count() == 9
