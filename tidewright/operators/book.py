"""The sequential core: one trading book stepped over one run's bars.

`step_book` is the only place that moves cash and positions. The batch plan calls it inside
`applyInArrow` (one group is one run of bounded length), the streaming plan keeps its state
between micro-batches. A book holds one or several symbols on one calendar.

Order of events on a bar: working orders fill, financing accrues on the previous marks, the
book is marked, signals are sized against that one mark, orders of the bar are placed.
"""

from __future__ import annotations

import importlib
import math
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

FILL_TIMINGS = ("close", "next_open", "next_close")


@dataclass(frozen=True)
class Slippage:
    """kind: none, bps, impact (spread plus square-root impact) or permanent (with a decaying push)."""

    kind: str = "none"
    half_spread_bps: float = 2.0
    impact: float = 0.6
    bar_volatility: float = 0.0126
    permanent: float = 0.3
    half_life: float = 5.0

    def __post_init__(self):
        if self.kind not in ("none", "bps", "impact", "permanent"):
            raise ValueError(f"unknown slippage {self.kind!r}")
        if self.half_spread_bps < 0 or self.impact < 0 or self.bar_volatility < 0 or self.permanent < 0 or self.half_life <= 0:
            raise ValueError("slippage parameters must not be negative and half_life must be positive")

    def price(self, sign: float, quantity: float, reference: float, volume: float, push: float = 0.0) -> float:
        if self.kind == "none":
            return reference
        share = min(quantity / max(volume, 1.0), 1.0)
        cost = self.half_spread_bps / 10_000.0
        if self.kind != "bps":
            cost = cost + self.impact * self.bar_volatility * math.sqrt(share)
        price = reference * (1.0 + sign * cost)
        if self.kind == "permanent":
            price += reference * sign * max(0.0, sign * push)
        return price

    def column(
        self, sign: Column, quantity: Column, reference: Column, volume: Column, push: Column | None = None
    ) -> Column:
        """The same price over columns."""
        if self.kind == "none":
            return reference
        cost = F.lit(self.half_spread_bps / 10_000.0)
        if self.kind != "bps":
            share = F.least(quantity / F.greatest(volume, F.lit(1.0)), F.lit(1.0))
            cost = cost + F.lit(self.impact * self.bar_volatility) * F.sqrt(share)
        price = reference * (1 + sign * cost)
        if self.kind == "permanent" and push is not None:
            price = price + reference * sign * F.greatest(F.lit(0.0), sign * push)
        return price

    @property
    def remembers(self) -> bool:
        """Whether fills push later prices."""
        return self.kind == "permanent"

    def push_left(self, push: float, bars: int) -> float:
        return push * 0.5 ** (max(0, bars) / self.half_life)

    def push_after(self, sign: float, quantity: float, volume: float, push: float) -> float:
        return push + sign * self.permanent * self.bar_volatility * min(quantity / max(volume, 1.0), 1.0)


@dataclass(frozen=True)
class Commission:
    """kind: none, share (per share with a minimum and a cap on notional) or bps of notional."""

    kind: str = "none"
    per_share: float = 0.005
    minimum: float = 1.0
    cap: float = 0.01
    bps: float = 1.0

    def __post_init__(self):
        if self.kind not in ("none", "share", "bps"):
            raise ValueError(f"unknown commission {self.kind!r}")
        if min(self.per_share, self.minimum, self.cap, self.bps) < 0:
            raise ValueError("commission parameters must not be negative")

    def fee(self, quantity: float, price: float) -> float:
        if self.kind == "none" or quantity <= 0:
            return 0.0
        notional = abs(quantity * price)
        if self.kind == "bps":
            return notional * self.bps / 10_000.0
        return min(max(self.minimum, self.per_share * quantity), self.cap * notional)

    def column(self, quantity: Column, price: Column) -> Column:
        """The same fee over columns."""
        notional = F.abs(quantity * price)
        if self.kind == "none":
            return F.lit(0.0)
        fee = notional * F.lit(self.bps / 10_000.0) if self.kind == "bps" else F.least(
            F.greatest(F.lit(self.minimum), F.lit(self.per_share) * quantity), F.lit(self.cap) * notional
        )
        return F.when(quantity > 0, fee).otherwise(0.0)


@dataclass(frozen=True)
class Financing:
    """Yearly rates earned on cash, paid on borrowed cash and on short value; an optional leverage limit."""

    cash_rate: float = 0.0
    borrow_rate: float = 0.0
    short_fee: float = 0.0
    max_leverage: float | None = None
    bars_per_year: float = 252.0

    def __post_init__(self):
        if self.bars_per_year <= 0 or (self.max_leverage is not None and self.max_leverage <= 0):
            raise ValueError("bars_per_year and max_leverage must be positive")
        if self.borrow_rate < 0 or self.short_fee < 0:
            raise ValueError("borrow_rate and short_fee must not be negative")

    def accrual(self, cash: float, short_value: float) -> float:
        return (
            cash * (self.cash_rate if cash >= 0 else self.borrow_rate) - short_value * self.short_fee
        ) / self.bars_per_year

    def column(self, cash: Column, short_value: Column) -> Column:
        """The same accrual over columns."""
        rate = F.when(cash >= 0, self.cash_rate).otherwise(self.borrow_rate)
        return (cash * rate - short_value * self.short_fee) / F.lit(self.bars_per_year)


@dataclass(frozen=True)
class Frictions:
    """Liquidity, order style and carry: a volume cap, limit orders, financing."""

    max_participation: float | None = None
    limit_offset_bps: float | None = None
    limit_expiry_bars: int = 1
    financing: Financing | None = None

    @property
    def active(self) -> bool:
        return self.max_participation is not None or self.limit_offset_bps is not None or self.financing is not None

    def describe(self) -> str:
        said = []
        if self.max_participation is not None:
            said.append(f"at most {self.max_participation:.0%} of volume")
        if self.limit_offset_bps is not None:
            said.append(f"limit orders {self.limit_offset_bps:g} bp from the close for {self.limit_expiry_bars} bar(s)")
        if self.financing is not None:
            said.append("financing")
        return ", ".join(said) or "none"


def _packed(model) -> dict:
    """A cost model as plain values: its class by name, and its fields."""
    return {"class": f"{type(model).__module__}:{type(model).__qualname__}", **asdict(model)}


def _unpacked(d: dict):
    module, name = d["class"].split(":")
    return getattr(importlib.import_module(module), name)(**{k: v for k, v in d.items() if k != "class"})


@dataclass(frozen=True)
class Account:
    """Everything that a run needs besides bars and signals.

    A slippage or commission model of one's own is a frozen dataclass of an importable module with
    the methods price (and, if it remembers, push_left and push_after) or fee.
    """

    slippage: Slippage = Slippage()
    commission: Commission = Commission()
    frictions: Frictions = Frictions()
    fill_timing: str = "close"
    capital: float = 1_000_000.0
    band: float = 0.05
    fractional: bool = True

    def __post_init__(self):
        if self.fill_timing not in FILL_TIMINGS:
            raise ValueError(f"fill_timing must be one of {FILL_TIMINGS}")
        if self.capital <= 0 or self.band < 0:
            raise ValueError("capital must be positive and band not negative")
        f = self.frictions
        if f.max_participation is not None and not 0 < f.max_participation <= 1:
            raise ValueError("max_participation must be in (0, 1]")
        if f.limit_offset_bps is not None and (f.limit_offset_bps < 0 or f.limit_expiry_bars < 1):
            raise ValueError("limit offset must not be negative and expiry at least one bar")

    def to_dict(self) -> dict:
        return asdict(self) | {"slippage": _packed(self.slippage), "commission": _packed(self.commission)}

    @staticmethod
    def from_dict(d: dict) -> Account:
        f = d["frictions"]
        fin = Financing(**f["financing"]) if f["financing"] else None
        return Account(
            _unpacked(d["slippage"]),
            _unpacked(d["commission"]),
            Frictions(**{**f, "financing": fin}),
            d["fill_timing"],
            d["capital"],
            d["band"],
            d["fractional"],
        )

    def zero_cost(self) -> Account:
        return replace(self, slippage=Slippage(), commission=Commission())


@dataclass
class Order:
    symbol: str
    quantity: float  # what remains, unsigned
    sign: float
    limit: float | None = None
    expires: int | None = None
    fresh: bool = False


@dataclass
class Book:
    """State between bars; plain values, so it can be stored and restored."""

    cash: float
    holdings: dict[str, float]
    marks: dict[str, float] = field(default_factory=dict)
    working: list[Order] = field(default_factory=list)
    push: dict[str, tuple[float, int]] = field(default_factory=dict)
    cancelled: float = 0.0
    expired: float = 0.0
    financing: float = 0.0
    bars: int = 0

    def to_dict(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_dict(d: dict) -> Book:
        return Book(
            d["cash"],
            d["holdings"],
            d["marks"],
            [Order(**o) for o in d["working"]],
            {k: tuple(v) for k, v in d["push"].items()},
            d["cancelled"],
            d["expired"],
            d["financing"],
            d["bars"],
        )


Bar = tuple  # (open, high, low, close, volume)
#: (t, symbol, signed quantity, fill price, reference price, commission)
Fill = tuple


def _market_fill(
    book: Book, account: Account, order: Order, t: int, reference: float, volume: float, fills: list[Fill]
) -> tuple[float, float] | None:
    """Fill what the volume cap lets through; returns (cash change, units) without applying them."""
    cap = account.frictions.max_participation
    quantity = order.quantity if cap is None else min(order.quantity, cap * max(volume, 0.0))
    order.quantity -= quantity
    if order.quantity > 1e-12:
        book.working.append(order)
    if quantity <= 0:
        return None
    slip, push = account.slippage, 0.0
    remembers = getattr(slip, "remembers", False)
    if remembers:
        push, since = book.push.get(order.symbol, (0.0, t))
        push = slip.push_left(push, t - since)
    price = slip.price(order.sign, quantity, reference, volume, push)
    if remembers:
        book.push[order.symbol] = (slip.push_after(order.sign, quantity, volume, push), t)
    fee = account.commission.fee(quantity, price)
    units = order.sign * quantity
    fills.append((t, order.symbol, units, price, reference, fee))
    return units * price + fee, units


def step_book(
    book: Book, account: Account, t: int, bars: dict[str, Bar], signals: list[tuple[str, float]]
) -> tuple[tuple, list[Fill]]:
    """Advance one bar. Returns ((cash, {symbol: position}, {symbol: price}, equity), fills of this bar)."""
    fills: list[Fill] = []
    frictions = account.frictions
    working, book.working = book.working, []
    for order in working:
        o, h, low, c, v = bars[order.symbol]
        if order.limit is None:
            reference = o if order.fresh and account.fill_timing == "next_open" else c
            order.fresh = False
            moved = _market_fill(book, account, order, t, reference, v, fills)
            if moved:
                book.cash -= moved[0]
                book.holdings[order.symbol] += moved[1]
            continue
        if low < order.limit if order.sign > 0 else h > order.limit:
            cap = frictions.max_participation
            quantity = order.quantity if cap is None else min(order.quantity, cap * max(v, 0.0))
            if quantity > 0:
                order.quantity -= quantity
                fee = account.commission.fee(quantity, order.limit)
                fills.append((t, order.symbol, order.sign * quantity, order.limit, order.limit, fee))
                book.cash -= order.sign * quantity * order.limit + fee
                book.holdings[order.symbol] += order.sign * quantity
        if order.quantity > 1e-12:
            if order.expires is not None and t >= order.expires:
                book.expired += order.quantity
            else:
                book.working.append(order)
    fin = frictions.financing
    if fin is not None and book.bars:
        accrued = fin.accrual(book.cash, sum(max(0.0, -q) * book.marks[s] for s, q in book.holdings.items()))
        book.cash += accrued
        book.financing -= accrued
    prices = {s: b[3] for s, b in bars.items()}
    book.marks = prices
    book.bars += 1
    equity = book.cash + sum(q * prices[s] for s, q in book.holdings.items())
    mark = (book.cash, dict(book.holdings), prices, equity)
    orders, intended = [], dict(book.holdings)
    for symbol, weight in signals:
        price = prices[symbol]
        if price <= 0 or equity <= 0:
            continue
        value = weight * equity
        if fin is not None and fin.max_leverage is not None:
            others = sum(abs(q * prices[s]) for s, q in intended.items() if s != symbol)
            room = max(0.0, fin.max_leverage * equity - others)
            value = max(-room, min(room, value))
        target = value / price
        if not account.fractional:
            target = float(int(target))
        delta = target - book.holdings[symbol]
        if delta == 0.0 or abs(delta * price) < max(account.band * equity, 1e-9):
            continue
        intended[symbol] = target
        sign = 1.0 if delta > 0 else -1.0
        limit = None if frictions.limit_offset_bps is None else price * (
            1.0 - sign * frictions.limit_offset_bps / 10_000.0
        )
        orders.append(
            Order(symbol, abs(delta), sign, limit, None if limit is None else t + frictions.limit_expiry_bars)
        )
    applied = []
    for order in orders:
        keep = []
        for other in book.working:
            if other.symbol == order.symbol:
                book.cancelled += other.quantity
            else:
                keep.append(other)
        book.working = keep
        if order.limit is None and account.fill_timing == "close":
            moved = _market_fill(book, account, order, t, prices[order.symbol], bars[order.symbol][4], fills)
            if moved:
                applied.append((order.symbol, *moved))
        else:
            order.fresh = order.limit is None
            book.working.append(order)
    for symbol, cost, units in applied:
        book.cash -= cost
        book.holdings[symbol] += units
    return mark, fills
