"""Reading quantities from text: figures, ranges and units, and converting them to a common unit."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Unit -> (quantity, factor to the base unit, offset, spellings). Base: SI-like, converted by ratios below.
UNITS: dict[str, tuple[str, float, float, tuple[str, ...]]] = {
    "Pa": ("pressure", 0.001, 0, ("Pa", "pascal", "pascals")),
    "hPa": ("pressure", 0.1, 0, ("hPa", "hectopascal", "mbar", "millibar", "millibars")),
    "kPa": ("pressure", 1, 0, ("kPa", "KPa", "kilopascal", "kilopascals")),
    "MPa": ("pressure", 1000, 0, ("MPa", "megapascal", "megapascals")),
    "bar": ("pressure", 100, 0, ("bar", "bars")),
    "psi": ("pressure", 6.894757293168, 0, ("psi", "lb/in2", "lb/in²", "lbf/in2", "pounds per square inch", "psig")),
    "inHg": ("pressure", 3.386389, 0, ("inHg", "in Hg", "inches of mercury", "inch of mercury")),
    "mmHg": ("pressure", 0.133322387415, 0, ("mmHg", "mm Hg", "torr")),
    "atm": ("pressure", 101.325, 0, ("atm",)),
    "kgf/cm2": ("pressure", 98.0665, 0, ("kgf/cm2", "kg/cm2", "kg/cm²")),
    "V": ("voltage", 1, 0, ("V", "Volt", "volts")),
    "mV": ("voltage", 0.001, 0, ("mV", "millivolt", "millivolts")),
    "kV": ("voltage", 1000, 0, ("kV", "kilovolt", "kilovolts")),
    "C": ("temperature", 1, 0, ("C", "°C", "deg C", "degC", "degrees C", "degree Celsius", "degrees Celsius", "Celsius")),
    "F": ("temperature", 5 / 9, -32 * 5 / 9, ("F", "°F", "deg F", "degF", "degrees F", "degree Fahrenheit", "degrees Fahrenheit", "Fahrenheit")),
    "K": ("temperature", 1, -273.15, ("K", "kelvin", "kelvins")),
    "mm": ("distance", 1, 0, ("mm", "millimetre", "millimetres", "millimeter", "millimeters")),
    "cm": ("distance", 10, 0, ("cm", "centimetre", "centimetres", "centimeter", "centimeters")),
    "m": ("distance", 1000, 0, ("m", "metre", "metres", "meter", "meters")),
    "um": ("distance", 0.001, 0, ("um", "µm", "μm", "micrometre", "micrometres", "micrometer", "micrometers", "micron", "microns")),
    "in": ("distance", 25.4, 0, ("in", "inch", "inches")),
    "ft": ("distance", 304.8, 0, ("ft", "foot", "feet")),
    "ms": ("duration", 1, 0, ("ms", "msec", "msecs", "millisecond", "milliseconds")),
    "s": ("duration", 1000, 0, ("s", "sec", "secs", "second", "seconds")),
    "us": ("duration", 0.001, 0, ("us", "µs", "μs", "usec", "microsecond", "microseconds")),
    "min": ("duration", 60_000, 0, ("min", "mins", "minute", "minutes")),
    "h": ("duration", 3_600_000, 0, ("h", "hr", "hrs", "hour", "hours")),
    "rpm": ("rotation", 1, 0, ("rpm", "r/min", "rev/min", "revolutions per minute")),
    "krpm": ("rotation", 1000, 0, ("krpm", "thousand rpm")),
    "rev/s": ("rotation", 60, 0, ("rev/s", "r/s", "rps", "Hz", "hertz", "revolutions per second")),
    "Nm": ("torque", 1, 0, ("Nm", "N·m", "N m", "N.m", "N-m", "newton metre", "newton metres", "newton meter", "newton meters")),
    "lb-ft": ("torque", 1.3558179483314004, 0, ("lb-ft", "lb·ft", "lbft", "lb ft", "lbs-ft", "ft-lb", "ft-lbs", "ft lb", "ft lbs", "ft·lb", "foot-pound", "foot-pounds", "foot pounds", "pound-feet", "pound feet")),
    "kgf·m": ("torque", 9.80665, 0, ("kgf·m", "kgf m", "kgf-m", "kg-m")),
    "kW": ("power", 1, 0, ("kW", "kilowatt", "kilowatts")),
    "W": ("power", 0.001, 0, ("W", "watt", "watts")),
    "hp": ("power", 0.7457, 0, ("hp", "bhp", "horsepower")),
    "g/s": ("mass_flow", 1, 0, ("g/s", "g/sec", "gram per second", "grams per second")),
    "kg/h": ("mass_flow", 1 / 3.6, 0, ("kg/h", "kg/hr", "kilograms per hour")),
    "lb/min": ("mass_flow", 453.59237 / 60, 0, ("lb/min", "lbs/min", "pound per minute", "pounds per minute")),
    "cc/min": ("volume_flow", 1, 0, ("cc/min", "cm3/min", "cm³/min", "ml/min", "millilitres per minute", "cubic centimetres per minute")),
    "L/min": ("volume_flow", 1000, 0, ("L/min", "lpm", "litre per minute", "litres per minute", "liters per minute")),
    "L/h": ("volume_flow", 1000 / 60, 0, ("L/h", "l/hr", "litres per hour", "liters per hour")),
    "J": ("energy", 1, 0, ("J", "joule", "joules")),
    "mJ": ("energy", 0.001, 0, ("mJ", "millijoule", "millijoules")),
    "kJ": ("energy", 1000, 0, ("kJ", "kilojoule", "kilojoules")),
    "A": ("current", 1, 0, ("A", "amp", "amps", "ampere", "amperes")),
    "mA": ("current", 0.001, 0, ("mA", "milliamp", "milliamps", "milliampere", "milliamperes")),
    "km/h": ("speed", 1, 0, ("km/h", "kph", "kmh", "km/hr", "kilometres per hour", "kilometers per hour")),
    "mph": ("speed", 1.609344, 0, ("mph", "mi/h", "miles per hour")),
    "m/s": ("speed", 3.6, 0, ("m/s", "metres per second", "meters per second")),
}

_EXACT = {s: u for u, (*_, spellings) in UNITS.items() for s in spellings}
_FOLDED = {s.lower(): u for s, u in reversed(list(_EXACT.items()))}
_SPELLED = "|".join(re.escape(s).replace(r"\ ", r"\s+") for s in sorted(_EXACT, key=len, reverse=True))
_UNIT = re.compile(rf"[\s ]*({_SPELLED})(?![^\W_]|[·²³/])", re.I)
_NUMBER = re.compile(
    r"(?:(?<![\w.,)])[-+−])?(?<![^\W_])(?<![.,])"
    r"(?:\d{1,3}(?:[    ]\d{3})+(?!\d)(?:[.,]\d+)?|\d{1,3}(?:,\d{3})+(?!\d)(?:\.\d+)?|\d+(?:[.,]\d+)?|[.,]\d+)(?:[eE][-+]?\d+)?"
)
_RANGE = re.compile(r"[\s ]*(?:to|through|till|until|bis|-|–|—|−)[\s ]*", re.I)
_NOISE = re.compile(r"\[\s*REF[^\]]*\]|\([^()]*\)", re.I)
_DOTS = re.compile(r"\s*(?:\.{2,}|…)\s*")


@dataclass(frozen=True)
class Quantity:
    """A figure or a range as written, in the order of size, with its unit or None."""

    lo: float
    hi: float
    unit: str | None

    def common(self, unit: str) -> tuple[float, float]:
        _, factor, offset, _ = UNITS[unit]
        return self.lo * factor + offset, self.hi * factor + offset


def unit_name(text: str) -> str | None:
    """The unit that a spelling names; case counts only where it tells two units apart."""
    text = " ".join(text.split())
    return _EXACT.get(text) or _FOLDED.get(text.lower())


def number(text: str) -> float:
    """Blanks, and a comma before exactly three digits, group thousands; any other comma is a decimal comma."""
    plain = re.sub(r"[\s   ]|,(?=\d{3}(?!\d))", "", text.replace("−", "-"))
    return float(plain.replace(",", "."))


def first_unit(text: str | None) -> str | None:
    """The first unit of a unit field, such as `kPa (bar)`."""
    if not text:
        return None
    m = _UNIT.match(_NOISE.sub(" ", text))
    return unit_name(m.group(1)) if m else None


def read(text: str | None) -> Quantity | None:
    """The first figure or range of a text; None if it has none. Parentheses and reference marks don't count."""
    if not text:
        return None
    text = _DOTS.sub(" to ", _NOISE.sub(" ", text))
    m = _NUMBER.search(text)
    if not m:
        return None
    low, at = number(m.group()), m.end()
    u = _UNIT.match(text, at)
    unit = unit_name(u.group(1)) if u else None
    sep = _RANGE.match(text, u.end() if u else at)
    n = _NUMBER.match(text, sep.end()) if sep else None
    if not n:
        return Quantity(low, low, unit)
    high = number(n.group())
    w = _UNIT.match(text, n.end())
    second = unit_name(w.group(1)) if w else None
    if unit and second and unit != second and UNITS[unit][0] == UNITS[second][0]:
        # Ends in different units of one quantity: the first end is turned into the unit of the second.
        low = (low * UNITS[unit][1] + UNITS[unit][2] - UNITS[second][2]) / UNITS[second][1]
    unit = second or unit
    return Quantity(min(low, high), max(low, high), unit)
