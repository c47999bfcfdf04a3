"""A grammar for quantities: numbers, unit expressions, and conversion to canonical units.

A unit is a vector of exponents over base dimensions with a scale and an offset:
``canonical = (number * coefficient + offset) * 10 ** exponent``. Currencies are
dimensions of their own, since they are never exchanged into one another.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

# Names of powers of ten, units and currencies.
SCALES = {
    "k": 3, "th": 3, "ths": 3, "thousand": 3, "thousands": 3, "tsd": 3,
    "m": 6, "mm": 6, "mn": 6, "mln": 6, "mio": 6, "mil": 6, "million": 6, "millions": 6,
    "b": 9, "bn": 9, "bln": 9, "billion": 9, "billions": 9,
    "tn": 12, "trn": 12, "trillion": 12, "trillions": 12, "hundred": 2, "hundreds": 2,
}
CURRENCIES = {"usd", "cad", "eur", "gbp", "jpy", "chf", "aud", "nzd", "cny", "hkd", "mxn", "brl", "inr", "sek", "nok", "dkk"}
SIGNS = {"us$": "USD", "$": "USD", "c$": "CAD", "ca$": "CAD", "cad$": "CAD", "cdn$": "CAD", "a$": "AUD", "au$": "AUD", "nz$": "NZD", "hk$": "HKD", "€": "EUR", "£": "GBP", "¥": "JPY"}
#: name: (dimension, its exponent, coefficient, power of ten, offset)
UNITS = {
    **dict.fromkeys(("share", "shares", "sh", "shs", "shr", "shrs", "stock", "stocks"), ("shares", 1, 1.0, 0, 0.0)),
    **dict.fromkeys(("percent", "pct", "%"), ("", 0, 1.0, -2, 0.0)),
    **dict.fromkeys(("bp", "bps"), ("", 0, 1.0, -4, 0.0)),
    **dict.fromkeys(("pure", "ratio"), ("", 0, 1.0, 0, 0.0)),
    **dict.fromkeys(("kg", "kilogram", "kilograms"), ("kg", 1, 1.0, 0, 0.0)),
    **dict.fromkeys(("tonne", "tonnes"), ("kg", 1, 1.0, 3, 0.0)),
    **dict.fromkeys(("lb", "lbs", "pound", "pounds"), ("kg", 1, 0.45359237, 0, 0.0)),
    **dict.fromkeys(("meter", "meters", "metre", "metres"), ("m", 1, 1.0, 0, 0.0)),
    **dict.fromkeys(("km", "kilometers", "kilometres"), ("m", 1, 1.0, 3, 0.0)),
    **dict.fromkeys(("mile", "miles"), ("m", 1, 1609.344, 0, 0.0)),
    **dict.fromkeys(("bbl", "barrel", "barrels"), ("m", 3, 0.158987294928, 0, 0.0)),
    **dict.fromkeys(("kelvin", "kelvins"), ("K", 1, 1.0, 0, 0.0)),
    **dict.fromkeys(("celsius", "degc"), ("K", 1, 1.0, 0, 273.15)),
    **dict.fromkeys(("fahrenheit", "degf"), ("K", 1, 5 / 9, 0, 255.3722222222222)),
}
FILLERS = {"in", "of", "the", "amounts", "amount", "omitted", "no", "s", "and", "units", "each", "iso", "expressed"}
_CENTS = {"cent", "cents", "¢", "c", "ct", "cts"}

_TOKEN = re.compile(
    r"iso4217:|(?:us|cdn|cad|ca|c|au|a|nz|hk)?\$|[€£¥¢%/()]"
    r"|'?000(?:'?s)?(?![\d.,])"
    r"|[-−(]?\s?(?:us\$|ca\$|c\$|\$)?\s?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:e[-+]?\d+)?"
    r"|[^\W\d_]+",
    re.I,
)


@dataclass
class Quantity:
    """What a text says: its number, if any, and its unit."""

    number: float | None = None
    dims: dict = field(default_factory=dict)
    exponent: int = 0
    coefficient: float = 1.0
    offset: float = 0.0
    scaled: bool = False  # a power of ten is stated
    known: bool = True  # every word was understood
    assumed: bool = False  # the currency is not named: cents alone


def currency_of(dims: dict) -> str | None:
    return next((d for d in dims if d.lower() in CURRENCIES), None)


def _word(word: str) -> list[str] | None:
    """The unit words a run of letters is made of: ``kusd`` is ``k usd``, ``usdth`` is ``usd th``."""
    if word in SCALES or word in CURRENCIES or word in UNITS or word in FILLERS or word in _CENTS or word in ("per", "us", "u"):
        return [word]
    for code in CURRENCIES:
        if word.startswith(code) and word[len(code) :] in SCALES:
            return [code, word[len(code) :]]
        if word.endswith(code) and word[: -len(code)] in SCALES:
            return [word[: -len(code)], code]
    return None


@lru_cache(maxsize=65536)
def parse_quantity(text: str | None) -> Quantity:
    """Parse a number with its unit, or a unit expression alone.

    Grammar: ``quantity := {filler | number | scale | unit | "/" | "per"}``. The
    first number that is not itself a scale (as ``000s`` is) is the number. What
    follows ``/`` or ``per`` counts in the denominator. Null and blank texts
    give a quantity that says nothing.
    """
    q = Quantity()
    if text is None or not text.strip():
        return q
    side = 1
    currency_from_us = False
    cents = False
    t = text.strip().lower().replace("−", "-")
    for m in _TOKEN.finditer(t):
        token = m.group().strip()
        if token in ("(", ")", "iso4217:"):
            continue
        if token == "/":
            side = -1
            continue
        if token.strip("'s") == "000" and "000" in token:
            q.exponent += 3 * side
            q.scaled = True
            continue
        if any(ch.isdigit() for ch in token):
            if q.number is None:
                sign = next((s for s in ("us$", "ca$", "c$", "$") if s in token), None)
                body = token.replace(sign, "") if sign else token
                negative = body.startswith(("-", "("))
                q.number = float(body.strip("-( ").replace(",", "")) * (-1 if negative else 1)
                if sign:
                    q.dims.setdefault(SIGNS[sign], 1)
            continue
        if token in SIGNS:
            q.dims.setdefault(SIGNS[token], side if currency_of(q.dims) else 1)
            continue
        words = _word(token)
        if words is None:
            q.known = False
            continue
        for w in words:
            if w == "per":
                side = -1
            elif w in CURRENCIES:  # "30c per share CAD": a currency is below the line only beside another one
                q.dims.setdefault(w.upper(), side if currency_of(q.dims) else 1)
            elif w in _CENTS:
                cents = True
                q.exponent -= 2 * side
                q.scaled = True
            elif w in SCALES:
                q.exponent += SCALES[w] * side
                q.scaled = True
            elif w in UNITS:
                dim, power, coefficient, exponent, offset = UNITS[w]
                if dim:
                    q.dims[dim] = q.dims.get(dim, 0) + power * side
                q.coefficient *= coefficient**side
                q.offset += offset
                q.exponent += exponent * side
            elif w in ("us", "u"):
                currency_from_us = True
    if cents and not any(d.lower() in CURRENCIES for d in q.dims):
        q.dims["USD"] = 1
        q.assumed = not currency_from_us
    elif currency_from_us and not q.dims:
        q.dims["USD"] = 1
    return q


@lru_cache(maxsize=65536)
def stated_currency(unit: str | None, text: str | None) -> str | None:
    """The currency that the unit, or else the text, names; null if neither does."""
    return next((currency_of(q.dims) for q in map(parse_quantity, (unit, text)) if currency_of(q.dims) and not q.assumed), None)


@lru_cache(maxsize=65536)
def conversion(unit: str | None, text: str | None, common: str | None) -> tuple[str | None, float | None, int, float, float, str]:
    """How a recorded fact becomes one in its common unit.

    Gives ``(common unit, number in the text, exponent, coefficient, offset, status)``.
    A scale that the text states goes before that of the unit. The common unit
    takes the fact's own currency: the unit's, else the text's. Status is
    ``ok``, ``unknown_unit`` (words that the grammar does not know, or no common
    unit) or ``incompatible`` (other dimensions than the common unit).
    """
    said = parse_quantity(text)
    if common is None:
        return None, said.number, 0, 1.0, 0.0, "unknown_unit"
    target, own = parse_quantity(common), parse_quantity(unit)
    base = own if own.dims else said
    by = said if said.scaled else own
    home, actual = currency_of(target.dims), stated_currency(unit, text) or currency_of(own.dims) or currency_of(said.dims)
    name, dims = common, dict(target.dims)
    if home and actual and actual != home:
        name = common.replace(home, actual)
        dims = {actual if d == home else d: p for d, p in dims.items()}
    if base.dims and base.dims != dims:
        # a text may leave out "per share": only what it names is compared
        if base is own or any(dims.get(d) != p for d, p in base.dims.items()):
            return name, said.number, 0, 1.0, 0.0, "incompatible"
    if not own.known or (not own.dims and unit and not own.scaled):
        return name, said.number, 0, 1.0, 0.0, "unknown_unit"
    shape = own if own.dims else said
    return name, said.number, by.exponent - target.exponent, shape.coefficient, shape.offset, "ok"
