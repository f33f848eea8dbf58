"""Inflation row by row, and keys that do not fit."""

from datetime import datetime

import pytest

from reelflow.operators import inflate, keys
from tests.conftest import make, ts


def shifted(d, years):
    """Step after step; 29 February becomes the 28th where the year has none."""
    if d is None:
        return None
    for y in years:
        try:
            d = d.replace(year=d.year + y)
        except ValueError:
            d = datetime(d.year + y, 2, 28, d.hour, d.minute, d.second, d.microsecond)
    return d


@pytest.mark.parametrize("years", [(1, 2, 3, 4, 5), (4,), ()])
def test_every_copy_has_its_steps(spark, years):
    dates = [ts("2000-02-29 10:00:00"), ts("2001-12-31 23:59:59.123456")]
    rows = make(spark, "payment", *[{"payment_id": k, "rental_id": 7, "payment_date": d} for k, d in enumerate(dates)])
    got = inflate.inflate_payment(rows, years).collect()
    masks = range(1 << len(years))
    want = sorted(str(shifted(d, [y for b, y in enumerate(years) if m >> b & 1])) for d in dates for m in masks)
    assert sorted(str(r.payment_date) for r in got) == want
    assert len({r.payment_id for r in got}) == len(got) and sum(r.rental_id is not None for r in got) == 2


def test_open_rentals_stay_open(spark):
    rows = make(spark, "rental", {"rental_id": 1, "inventory_id": 1, "customer_id": 1, "rental_date": ts("2001-05-05 00:00:00"), "return_date": None})
    grown = inflate.inflate_rental(rows)
    assert grown.count() == 16 and grown.where("return_date is not null").count() == 0


def test_keys_that_do_not_fit_say_so(spark):
    wide = make(spark, "customer", {"customer_id": -(2**62)}, {"customer_id": 2**62})
    with pytest.raises(Exception, match="dense keys"):
        keys.append_with_keys(wide, wide, "customer_id").collect()
    near = make(spark, "customer", {"customer_id": 5}, {"customer_id": 9})
    assert sorted(r.customer_id for r in keys.append_with_keys(near, near, "customer_id").collect()) == [5, 9, 10, 14]
    assert keys.append_with_keys(near.limit(0), near, "customer_id").count() == 2
