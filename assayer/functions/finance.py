"""Charges, taxes and accruals as column expressions on exact decimals."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(c: Column, scale: int = 2) -> Column:
    return c.cast(f"decimal(18,{scale})")


def term(holding_days: Column, threshold_days: Column) -> Column:
    return F.when(holding_days >= threshold_days, "long").otherwise("short")


def gains_tax(total_gain: Column, exemption: Column, rate_pct: Column) -> Column:
    """Tax on the part of a yearly gain above the exemption."""
    return F.greatest(total_gain - exemption, F.lit(0)) * rate_pct / 100


def charges(is_buy: Column, gross: Column, brokerage: Column, stt_rate, stamp_rate, gst_rate) -> dict:
    """Transaction tax on both legs, stamp duty on buys only, GST on the brokerage.

    The net of a buy leaves stamp duty out; the net of a sell takes every charge off.
    """
    rate = lambda r: F.lit(r).cast("decimal(8,6)")
    stt = F.bround(gross * rate(stt_rate), 2)
    gst = F.bround(brokerage * rate(gst_rate), 2)
    stamp = F.when(is_buy, F.bround(gross * rate(stamp_rate), 2)).otherwise(
        F.lit(0).cast("decimal(18,2)")
    )
    costs = brokerage + stt + gst
    return {
        "stt": stt,
        "gst": gst,
        "stamp_duty": stamp,
        "net": F.when(is_buy, gross + costs).otherwise(gross - costs),
    }


def days_30_360(start: Column, end: Column) -> Column:
    """Days between two dates when every month has 30 days."""
    d1 = F.least(F.dayofmonth(start), F.lit(30))
    d2 = F.when((F.dayofmonth(end) == 31) & (d1 == 30), 30).otherwise(F.dayofmonth(end))
    return (
        360 * (F.year(end) - F.year(start)) + 30 * (F.month(end) - F.month(start)) + (d2 - d1)
    )


def accrued_interest(face: Column, coupon_pct: Column, last_coupon: Column, day: Column) -> Column:
    return face * coupon_pct / 100 * days_30_360(last_coupon, day) / 360


def last_semiannual(issue: Column, day: Column) -> Column:
    """Latest coupon date on or before ``day`` for coupons every six months from issue."""
    months = F.floor(F.months_between(day, issue) / 6) * 6
    return F.add_months(issue, months.cast("int"))


def action_factor(action: Column, numerator: Column, denominator: Column) -> Column:
    """Quantity factor of a bonus (a for b on top) or a split (a for b)."""
    return (
        F.when(action == "BONUS", (numerator + denominator) / denominator)
        .when(action == "SPLIT", numerator / denominator)
        .otherwise(1.0)
    )
