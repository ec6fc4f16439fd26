"""Money: parsing (A22), economics (E1-E6), rounding and formats (K7)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """Fee and tax in per cent, the rest in money; clamped as E2 has it."""

    fee_rate: float = 13.25
    fixed_fee: float = 0.30
    sales_tax: float = 7.0
    buffer: float = 0.0

    def clamped(self) -> Settings:
        pct = lambda v: max(0.0, min(100.0, float(v or 0)))
        money = lambda v: max(0.0, float(v or 0))
        return Settings(pct(self.fee_rate), money(self.fixed_fee), pct(self.sales_tax), money(self.buffer))


def _number(text: Column, pattern: str = r"(\d+(?:\.\d{1,2})?)") -> Column:
    return F.nullif(F.regexp_extract(F.replace(text, F.lit(",")), pattern, 1), F.lit("")).cast("double")


def edge_money(v: Column) -> Column:
    """The first number of a text, thousands separators ignored; a sign is ignored too."""
    return _number(v)


def card_money(v: Column) -> Column:
    """As edge_money, but 0 counts as missing."""
    n = _number(v)
    return F.when(n > 0, n)


def item_money(v: Column) -> Column:
    """Also reads a decimal comma ('12,99') where no other reading is open."""
    t = F.trim(F.replace(v, F.lit(" "), F.lit(" ")))
    digits = F.regexp_replace(t, r"[^\d.,]", "")
    euro = t.rlike(r"^\D*\d{1,3}(?:\.\d{3})*,\d{2}\D*$")
    plain = F.when(euro, F.replace(F.replace(digits, F.lit(".")), F.lit(","), F.lit("."))).otherwise(F.replace(digits, F.lit(",")))
    return F.nullif(F.regexp_extract(plain, r"(\d+(?:\.\d{1,2})?)", 1), F.lit("")).cast("double")


def range_money(v: Column) -> Column:
    """The low end of '$10.00 to $25.50'; only dollar prices count."""
    found = F.transform(F.regexp_extract_all(F.replace(v, F.lit(",")), F.lit(r"\$\s*(\d+(?:\.\d{1,2})?)"), 1), lambda x: x.cast("double"))
    return F.when(F.size(found) > 0, F.array_min(found))


def rounded(v: Column, digits: int) -> Column:
    """Half up, also below zero (-2.5 gives -2)."""
    k = float(10**digits)
    return F.floor(v * k + F.lit(0.5)) / F.lit(k)


def non_negative(v: Column) -> Column:
    return F.when(v >= 0, v)


def dollars(v: Column) -> Column:
    """$1,234.56, -$1.00; null as $0.00."""
    r = F.coalesce(v, F.lit(0.0))
    return F.concat(F.when(r < 0, "-$").otherwise("$"), F.format_number(F.abs(r), 2))


def economics(sell: Column, sell_shipping: Column, buy: Column, buy_shipping: Column, prime: Column, s: Settings = Settings()) -> dict[str, Column]:
    """E1-E4 by name. Negative or missing money counts as 0 and is warned of; the order of the arithmetic is part of the contract."""
    s = s.clamped()
    sell_known, buy_known = non_negative(sell), non_negative(buy)
    ship_known = F.coalesce(non_negative(buy_shipping), F.when(F.coalesce(prime, F.lit(False)), 0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rate, tax = F.lit(s.fee_rate) / F.lit(100.0), F.lit(s.sales_tax) / F.lit(100.0)
    revenue = zero(sell_known) + zero(non_negative(sell_shipping))
    sourcing = (zero(buy_known) + zero(ship_known)) * (F.lit(1.0) + tax)
    fees = revenue * rate + F.lit(s.fixed_fee)
    net = revenue - sourcing - fees - F.lit(s.buffer)
    warnings = F.array_compact(
        F.array(
            F.when(sell_known.isNull(), "sell price missing, treated as $0"),
            F.when(buy_known.isNull(), "buy price missing, treated as $0"),
            F.when(ship_known.isNull(), "buy shipping unknown and not prime, $0 assumed"),
        )
    )
    return {
        "revenue": rounded(revenue, 2),
        "sourcing": rounded(sourcing, 2),
        "fees": rounded(fees, 2),
        "buffer": rounded(F.lit(s.buffer), 2),
        "net_profit": rounded(net, 2),
        "roi": F.when(sourcing > 0, rounded(net / F.nullif(sourcing, F.lit(0.0)) * 100, 1)),
        "margin_on_revenue": F.when(revenue > 0, rounded(net / F.nullif(revenue, F.lit(0.0)) * 100, 1)),
        "profitable": net > 0,
        "warnings": warnings,
    }


def table_economics(sell: Column, buy: Column, fee_pct: float = 13.0) -> dict[str, Column]:
    """E5: fees, profit and return on the buying price (0 if that is not above 0); no tax, shipping or fixed fee."""
    fees = sell * F.lit(fee_pct / 100)
    profit = sell - fees - buy
    return {"fees": fees, "profit": profit, "return_on_buy": F.when(buy > 0, profit / F.nullif(buy, F.lit(0.0))).otherwise(0.0)}


def breakdown_lines(sell: Column, sell_shipping: Column, buy: Column, buy_shipping: Column, prime: Column, s: Settings = Settings()) -> Column:
    """Five lines of text."""
    e, s = economics(sell, sell_shipping, buy, buy_shipping, prime, s), s.clamped()
    zero = lambda c: F.coalesce(non_negative(c), F.lit(0.0))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Revenue: "), dollars(zero(sell)), F.lit(" (item) + "), dollars(zero(sell_shipping)), F.lit(" (shipping) = "), dollars(e["revenue"])),
        F.concat(F.lit("Sourcing: ("), dollars(zero(buy)), F.lit(" + "), dollars(zero(buy_shipping)), F.lit(f") x {100 + s.sales_tax:.1f}% tax = "), dollars(e["sourcing"])),
        F.concat(F.lit("Fees: "), dollars(e["revenue"]), F.lit(f" x {s.fee_rate:.2f}% + "), dollars(F.lit(s.fixed_fee)), F.lit(" = "), dollars(e["fees"])),
        F.concat(F.lit("Buffer: "), dollars(e["buffer"])),
        F.concat(F.lit("Net profit: "), dollars(e["net_profit"])),
    )
