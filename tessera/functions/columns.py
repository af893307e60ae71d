"""Column builders: parsing, costs, ticks and time rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window, functions as F

#: Product classes that are not ordinary shares.
EXCLUDED_CATEGORIES = ("ETF", "ETN", "Beneficiary Certificate", "Depositary Receipt", "Warrant", "Index", "ETF受益證券")

#: Price bands (from, tick).
TICKS = ((0, "0.01"), (10, "0.05"), (50, "0.1"), (100, "0.5"), (500, "1"), (1000, "5"))


def roc_date(text: Column) -> Column:
    """`yyy/mm/dd`, `yyyy/mm/dd` or `yyyy-mm-dd` to a date; years below 1911 count from 1911. Anything else: null."""
    parts = F.split(F.regexp_replace(F.trim(text), "-", "/"), "/")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    year = number(0) + F.when(number(0) < 1911, 1911).otherwise(0)
    built = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(number(1).cast("string"), 2, "0"), F.lpad(number(2).cast("string"), 2, "0"))
    return F.when(F.size(parts) == 3, built.try_cast("date"))


def parse_number(text: Column) -> Column:
    """A number with thousands commas or a leading X; dashes and blanks are null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), ",", ""), "^X", "")
    return bare.try_cast("double")


def instrument_key(text: Column) -> Column:
    """`tse:2330` and `2330:otc` to struct(market, symbol); no market means tse; anything malformed: null."""
    parts = F.split(F.lower(F.trim(text)), ":")
    known = lambda c: c.isin("tse", "otc")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    market = F.when(F.size(parts) == 1, F.lit("tse")).when(known(first), first).when(known(second), second)
    symbol = F.upper(F.when(F.size(parts) == 1, first).when(known(first), second).otherwise(first))
    return F.when(market.isNotNull() & (F.size(parts) <= 2) & symbol.rlike("^[0-9A-Z]{4,6}$"), F.struct(market.alias("market"), symbol.alias("symbol")))


def classify_security(stock_id: Column, name: Column, categories: Column) -> Column:
    """ordinary_share or excluded_product, by id, name and the list of categories."""
    excluded = F.arrays_overlap(F.coalesce(categories, F.array().cast("array<string>")), F.array(*map(F.lit, EXCLUDED_CATEGORIES)))
    odd = ~stock_id.rlike("^[0-9]{4}$") | F.coalesce(name, F.lit("")).contains("-DR") | F.coalesce(name, F.lit("")).rlike("特[甲-癸]?$")
    return F.when(excluded | odd, "excluded_product").otherwise("ordinary_share")


def at_clock(day: Column, clock: str, zone: str = "Asia/Taipei") -> Column:
    """The UTC timestamp of a wall-clock time on a date."""
    return F.to_utc_timestamp(F.concat(day.cast("string"), F.lit(f" {clock}")).cast("timestamp"), zone)


@dataclass(frozen=True)
class AvailabilityPolicy:
    """Wall clocks: when a session closes, when its data are published, and the buffer until they may be used."""

    close: str = "13:30:00"
    publish: str = "17:30:00"
    buffer_minutes: int = 30

    def event_time(self, day: Column) -> Column:
        return at_clock(day, self.close)

    def published(self, day: Column) -> Column:
        return at_clock(day, self.publish)

    def available(self, day: Column) -> Column:
        return self.published(day) + F.expr(f"INTERVAL {self.buffer_minutes} MINUTES")


@dataclass(frozen=True)
class CostPolicy:
    """Commission rate, discount and minimum; tax rate on sells; slippage in basis points."""

    rate: str = "0.001425"
    discount: str = "1"
    minimum: str = "20"
    tax: str = "0.003"
    slippage_bps: str = "5"


def _money(c: Column) -> Column:
    return c.cast("decimal(20,8)")


def commission(gross: Column, policy: CostPolicy) -> Column:
    """Gross times rate and discount, the minimum at least, rounded up to a whole unit; no trade costs nothing."""
    rate = F.lit(policy.rate).cast("decimal(12,8)") * F.lit(policy.discount).cast("decimal(8,4)")
    due = F.ceil(F.greatest(_money(_money(gross) * rate.cast("decimal(14,10)")), F.lit(policy.minimum).cast("decimal(20,8)")))
    return F.when(gross == 0, F.lit(0)).otherwise(due).cast("decimal(20,0)")


def transaction_tax(gross: Column, side: Column, policy: CostPolicy) -> Column:
    """Tax on sells, rounded down to a whole unit."""
    due = F.floor(_money(_money(gross) * F.lit(policy.tax).cast("decimal(12,8)")))
    return F.when(side == "sell", due).otherwise(F.lit(0)).cast("decimal(20,0)")


def incremental_commission(gross: Column, order: list[str], sequence: list[str], policy: CostPolicy) -> Column:
    """What each fill adds to its order's commission: the minimum is charged once an order."""
    upto = Window.partitionBy(*order).orderBy(*sequence).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(_money(gross)).over(upto)
    return commission(total, policy) - commission(total - _money(gross), policy)


def tick_size(price: Column) -> Column:
    """The tick of a price's band."""
    found = F.lit(TICKS[0][1]).cast("decimal(10,4)")
    for low, tick in TICKS[1:]:
        found = F.when(price >= low, F.lit(tick).cast("decimal(10,4)")).otherwise(found)
    return found


def tick_round(price: Column, side: Column) -> Column:
    """To a valid price against the trader: buys up, sells down; repeated while rounding changes the band (three times at most)."""
    now = price.cast("decimal(20,6)")
    for _ in range(3):
        steps = now / tick_size(now)
        now = (F.when(side == "buy", F.ceil(steps)).otherwise(F.floor(steps)) * tick_size(now)).cast("decimal(20,6)")
    return now


def slippage_cost(quantity: Column, price: Column, reference: Column, side: Column) -> Column:
    """What a fill cost against the reference price; negative if it was better."""
    return quantity * (price - reference) * F.when(side == "buy", 1).otherwise(-1)


def row_checksum(*columns: str) -> Column:
    """sha256 of a row's JSON, columns by name."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def change(last: Column, previous: Column) -> Column:
    return last - previous


def change_pct(last: Column, previous: Column) -> Column:
    """Percent change; null when the previous value is null or zero."""
    return (last - previous) / F.nullif(previous, F.lit(0.0)) * 100


def target_quantity(weight: Column, nav: Column, price: Column, lot: int, policy: CostPolicy) -> Column:
    """The most whole lots whose cost with commission stays within weight * nav.

    The estimate without costs is at most a few lots too high; those few are tried, largest first."""
    budget = _money(weight * nav)
    lots = F.floor(budget / (_money(price) * lot)).cast("long")
    tried = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.greatest(lots - i, F.lit(0).cast("long")))
    fits = lambda n: (n == 0) | (_money(n * lot * _money(price)) + commission(n * lot * _money(price), policy) <= budget)
    return F.get(F.filter(tried, fits), F.lit(0)) * lot


def fill_capacity(volume: Column, participation: float = 0.1) -> Column:
    return F.floor(volume * F.lit(participation)).cast("long")


def unfilled_reason(quantity: Column, volume: Column, suspended: Column, locked: Column, participation: float = 0.1) -> Column:
    """Why an order is not filled whole; null if it is."""
    room = fill_capacity(volume, participation)
    return F.when(suspended, "suspended").when(locked, "price_limit_locked").when(volume == 0, "zero_volume").when(room == 0, "participation_capacity_zero").when(room < quantity, "insufficient_volume_for_full_fill")


def linear_quantile(value: Column, q: float) -> Column:
    return F.percentile(value, F.lit(q))
