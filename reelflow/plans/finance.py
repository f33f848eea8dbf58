"""Customer balances and the monthly rewards report."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelflow.functions.scalars import as_date, days_between, ntz, within_days
from reelflow.sources.tables import RentalTables


def _rental_terms(t: RentalTables) -> DataFrame:
    return t.inventory.select("inventory_id", "film_id").join(
        t.film.select("film_id", "rental_rate", "rental_duration", "replacement_cost"), "film_id"
    )


def _late_fees(charge_replacement: bool) -> tuple[Column, Column]:
    """Fee per day late and fee of a film given up as lost, of a rental joined to its terms."""
    late = days_between("rental_date", "return_date") - F.col("rental_duration")
    late_fee = F.when(late > 0, late).otherwise(F.lit(0))
    lost_fee = F.when(late > F.col("rental_duration") * 2, F.col("replacement_cost")).otherwise(F.lit(0))
    return late_fee, lost_fee if charge_replacement else F.lit(0)


def customer_balance(t: RentalTables, as_of: datetime | str, charge_replacement: bool = False) -> DataFrame:
    """(customer_id, rent_fees, late_fees, payments, balance) for every customer up to a date.

    Rental fees of all rentals begun, plus 1 per day a returned film was late, minus payments.
    Rentals still open add no late fee. `charge_replacement` adds the replacement cost of films
    returned more than twice the rental duration late.
    """
    until = ntz(as_of)
    terms = _rental_terms(t)
    late_fee, lost_fee = _late_fees(charge_replacement)
    fees = (
        t.rental.filter(F.col("rental_date") <= until)
        .select("customer_id", "inventory_id", "rental_date", "return_date")
        .join(terms, "inventory_id")
        .groupBy("customer_id")
        .agg(
            F.sum("rental_rate").alias("rent_fees"),
            F.sum(late_fee).alias("late_fees"),
            F.sum(lost_fee).alias("lost_fees"),
        )
    )
    paid = t.payment.filter(F.col("payment_date") <= until).groupBy("customer_id").agg(F.sum("amount").alias("payments"))

    def money(name: str):
        return F.coalesce(F.col(name), F.lit(0)).cast("decimal(18,2)")

    rows = t.customer.select("customer_id").join(fees, "customer_id", "left").join(paid, "customer_id", "left")
    return rows.select(
        "customer_id",
        money("rent_fees").alias("rent_fees"),
        (money("late_fees") + money("lost_fees")).cast("decimal(18,2)").alias("late_fees"),
        money("payments").alias("payments"),
        (money("rent_fees") + money("late_fees") + money("lost_fees") - money("payments"))
        .cast("decimal(18,2)")
        .alias("balance"),
    )


def balances_at(t: RentalTables, probes: DataFrame, charge_replacement: bool = False, slot: str = "DAY") -> DataFrame:
    """(customer_id, as_of, rent_fees, late_fees, payments, balance) for each distinct (customer_id, as_of) of `probes`.

    The balance of `customer_balance` at a date that differs from row to row. Charges, payments and
    probes are one stream of events for each customer; a probe's balance is the running sum before it,
    events of its own moment included. The stream is cut into slots of time: running sums within
    (customer, slot), and the totals of the slots before, one row for each customer and slot. So a
    customer with a large share of all rows is spread over as many tasks as there are slots. `as_of`
    is a timestamp without zone; probes with a NULL customer or date are left out.
    """
    late_fee, lost_fee = _late_fees(charge_replacement)
    money = lambda c: c.cast("decimal(18,2)")
    nothing = money(F.lit(0))
    fees = t.rental.select("customer_id", "inventory_id", "rental_date", "return_date").join(_rental_terms(t), "inventory_id")
    charges = fees.select("customer_id", F.col("rental_date").alias("at"), money(F.col("rental_rate")).alias("rent_fees"), money(late_fee + lost_fee).alias("late_fees"), nothing.alias("payments"))
    paid = t.payment.select("customer_id", F.col("payment_date").alias("at"), nothing.alias("rent_fees"), nothing.alias("late_fees"), money(F.col("amount")).alias("payments"))
    asked = probes.select("customer_id", F.col("as_of").cast("timestamp_ntz").alias("at")).where("customer_id is not null and at is not null").distinct()
    kinds = ("rent_fees", "late_fees", "payments")
    events = charges.unionByName(paid).where("customer_id is not null and at is not null").withColumn("probe", F.lit(False))
    stream = events.unionByName(asked.select("*", *[nothing.alias(c) for c in kinds], F.lit(True).alias("probe")))
    stream = stream.withColumn("slot", F.date_trunc(slot, "at"))
    order = Window.partitionBy("customer_id", "slot").orderBy("at", "probe")
    within = order.rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("customer_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    # sums are cut to the width of money before they are exchanged, as wider decimals take three times the bytes
    running = stream.select(
        "customer_id", "slot", "at", "probe", *[money(F.sum(c).over(within)).alias(c) for c in kinds],
        F.max("probe").over(within).alias("asked"), F.lead(F.lit(True)).over(order).isNull().alias("ends"))
    # the running sums at a slot's end are its totals, taken from the same exchange as the probes' sums
    totals = running.where("ends")
    carried = totals.select("customer_id", "slot", "asked", *[money(F.coalesce(F.sum(c).over(before), F.lit(0))).alias(f"carried_{c}") for c in kinds])
    # all slots count for those after them, but only the ones with a probe meet one
    carried = carried.where("asked").drop("asked")
    sums = {c: money(F.col(c) + F.col(f"carried_{c}")) for c in kinds}
    # a left join, as an inner one would push a filter into one side only and so part the exchanges
    return running.where("probe").join(carried, ["customer_id", "slot"], "left").select(
        "customer_id", F.col("at").alias("as_of"), *[v.alias(c) for c, v in sums.items()],
        money(sums["rent_fees"] + sums["late_fees"] - sums["payments"]).alias("balance"))


def reward_month(as_of: date | str, months_back: int = 1) -> tuple[date, date]:
    """First and last day of the calendar month `months_back` before `as_of`."""
    day = as_date(as_of)
    index = day.year * 12 + day.month - 1 - months_back
    first = date(index // 12, index % 12 + 1, 1)
    following = date((index + 1) // 12, (index + 1) % 12 + 1, 1)
    return first, following - timedelta(days=1)


def rewards_report(
    t: RentalTables,
    min_monthly_purchases: int,
    min_dollar_amount: Decimal | str,
    as_of: date | str,
    months_back: int = 1,
) -> DataFrame:
    """All columns of the customers above both limits (strictly) in one calendar month."""
    amount = Decimal(str(min_dollar_amount))
    if min_monthly_purchases <= 0:
        raise ValueError("min_monthly_purchases must be positive")
    if amount <= 0:
        raise ValueError("min_dollar_amount must be positive")
    first, last = reward_month(as_of, months_back)
    best = (
        t.payment.filter(within_days("payment_date", first, last))
        .groupBy("customer_id")
        .agg(F.sum("amount").alias("paid"), F.count("customer_id").alias("n"))
        .filter((F.col("paid") > F.lit(amount)) & (F.col("n") > min_monthly_purchases))
        .select("customer_id")
    )
    return t.customer.join(best, "customer_id", "left_semi")


def count_rewardees(rewardees: DataFrame) -> DataFrame:
    """The report's count, as a one-row DataFrame."""
    return rewardees.agg(F.count(F.lit(1)).alias("count_rewardees"))
