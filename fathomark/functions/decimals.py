"""Exact decimals as an integer and a scale, for operands; there is no arithmetic."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal as Python

from fathomark.functions.datatypes import DataType as D

# The limits of the numeric types.
INT32 = (-(1 << 31), (1 << 31) - 1)
INT64 = (-(1 << 63), (1 << 63) - 1)
INT128 = (-(1 << 127), (1 << 127) - 1)
DOUBLE_DIGITS, DOUBLE_SCALE = 15, 292
BIG_SCALE = 18

_NUMBER = re.compile(r"([+-]?)([0-9]*)(?:(\.)([0-9]*))?(?:[eE]([+-]?[0-9]+))?\Z")


@dataclass(frozen=True)
class Dec:
    """unscaled * 10 ** -scale."""

    unscaled: int
    scale: int

    @classmethod
    def parse(cls, text: str) -> Dec:
        m = _NUMBER.match(text)
        if m is None:
            raise ValueError(f"not a number: {text!r}")
        sign, whole, point, part, exponent = m[1], m[2], m[3], m[4] or "", m[5]
        if not whole and not part or point and not part and whole in ("", "0"):
            raise ValueError(f"no digits: {text!r}")
        power = int(exponent or 0)
        scale = len(part) - power
        if not -(1 << 63) <= power < 1 << 63 or not INT32[0] <= scale <= INT32[1]:
            raise ValueError(f"scale out of range: {text!r}")
        return cls(int(sign + (whole or "0") + part), scale)

    @classmethod
    def maybe(cls, text: str) -> Dec | None:
        try:
            return cls.parse(text)
        except ValueError:
            return None

    def strip(self) -> Dec:
        if not self.unscaled:
            return Dec(0, 0)
        digits = str(abs(self.unscaled))
        zeros = len(digits) - len(digits.rstrip("0"))
        return Dec(self.unscaled // 10**zeros, self.scale - zeros) if zeros else self

    def precision(self) -> int:
        return len(str(abs(self.unscaled)))

    def to_scale(self, scale: int, up: bool | None = None) -> Dec:
        """At another scale; digits that are cut must be zero unless up says where to round."""
        if scale >= self.scale:
            return Dec(self.unscaled * 10 ** (scale - self.scale), scale)
        q, r = divmod(self.unscaled, 10 ** (self.scale - scale))
        if r and up is None:
            raise ValueError("digits would be lost")
        return Dec(q + bool(r and up), scale)

    def to_precision(self, digits: int, up: bool) -> Dec:
        out = self
        while out.precision() > digits:
            out = out.to_scale(out.scale - (out.precision() - digits), up)
        return out

    def is_int128(self) -> bool:
        return INT128[0] <= self.unscaled <= INT128[1]

    def _key(self) -> Python:
        return Python(self.unscaled).scaleb(-self.scale)

    def compare(self, other: Dec) -> int:
        # by magnitude first, so that far apart scales need no huge integers
        signs = [(d.unscaled > 0) - (d.unscaled < 0) for d in (self, other)]
        if signs[0] != signs[1] or not signs[0]:
            return (signs[0] > signs[1]) - (signs[0] < signs[1])
        tops = [d.precision() - d.scale for d in (self, other)]
        if tops[0] != tops[1]:
            return signs[0] * (1 if tops[0] > tops[1] else -1)
        scale = max(self.scale, other.scale)
        a, b = self.to_scale(scale).unscaled, other.to_scale(scale).unscaled
        return (a > b) - (a < b)

    def canonical(self) -> str:
        """Plain notation without trailing zeros."""
        d = self.strip()
        digits, sign = str(abs(d.unscaled)), "-" if d.unscaled < 0 else ""
        if d.scale <= 0:
            return sign + digits + "0" * (-d.scale if d.unscaled else 0)
        digits = digits.rjust(d.scale + 1, "0")
        return f"{sign}{digits[: -d.scale]}.{digits[-d.scale :]}"

    def to_json(self) -> str:
        return self.canonical()

    @classmethod
    def from_json(cls, text: str) -> Dec:
        return cls.parse(text.strip().strip('"'))

    def fits(self, precision: int, scale: int) -> bool:
        d = self.strip()
        return d.scale <= scale and d.precision() - d.scale <= precision - scale

    def as_float(self) -> float:
        try:
            return float(f"{self.unscaled}e{-self.scale}")
        except OverflowError:
            return float("inf") if self.unscaled > 0 else float("-inf")


def classify_integer(v: int) -> D:
    for t, (low, high) in ((D.INTEGER, INT32), (D.LONG, INT64), (D.BIG_INTEGER, INT128)):
        if low <= v <= high:
            return t
    return D.UNBOUND_INTEGER


def in_double(d: Dec) -> bool:
    return d.precision() <= DOUBLE_DIGITS and abs(d.scale) <= DOUBLE_SCALE


def in_big_decimal(d: Dec) -> bool:
    if d.scale > BIG_SCALE or d.precision() > 39 or d.precision() - d.scale > 21:
        return False
    return d.precision() <= 38 and d.precision() - d.scale <= 20 or d.to_scale(BIG_SCALE).is_int128()


def classify_decimal(d: Dec) -> D:
    """d without trailing zeros."""
    return D.DOUBLE if in_double(d) else D.BIG_DECIMAL if in_big_decimal(d) else D.UNBOUND_DECIMAL


def classify_number(d: Dec) -> D:
    """The type of a number that a document holds: 30.0 is whole."""
    d = d.strip()
    return classify_integer(d.unscaled * 10**-d.scale) if d.scale <= 0 else classify_decimal(d)
