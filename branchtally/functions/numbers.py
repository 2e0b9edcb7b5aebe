"""Numbers: parsing dirty cells, exact order-independent sums, whole-unit rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import quoted
from .text import strip

# Money is summed in fixed point, so that a sum does not depend on the order of its rows. A
# value is cut into small whole parts; each part is summed as a long, which cannot overflow
# before 2^41 rows per group, and costs a fraction of a decimal sum. Six decimals hold what
# money has; what a value has beyond them goes into a finer part, twelve decimals in all.
_PART_BITS = 22
_MICRO = 1_000_000
_FINE = 1_000_000_000_000
# A rest within half a unit in the last place of the value is how a double writes the sixth
# decimal, not a digit of its own.
_HALF_ULP = 2.0**-52
_FIXED_POINT_LIMIT = float(1 << 62)
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _finite(d: Column) -> Column:
    return F.when(F.abs(d) < F.lit(float("inf")), d)


def parse_balance(c: Column, kind: T.DataType | None = None) -> Column:
    """A cell as double, or null when it is not a plain number (``1,250`` is not one)."""
    if kind is not None and isinstance(kind, T.NumericType):
        return _finite(c.cast("double"))
    text = c.cast("string")
    # Spark's cast also takes '1d', 'NaN' and hexadecimal. A cell that ends in a digit and
    # has no x or e is either a plain number or fails the cast; the rest, few cells,
    # goes through a pattern. Only exponents can overflow to infinity.
    last = F.right(text, F.lit(1))
    plain = (last >= "0") & (last <= "9") & (F.length(text) <= 300)
    for letter in "xXeE":
        plain = plain & ~F.contains(text, F.lit(letter))
    s = strip(text)
    return F.coalesce(
        F.when(plain, text.try_cast("double")),
        F.when(s.rlike(_NUMBER), _finite(s.try_cast("double"))),
    )


def parse_number(c: Column, kind: T.DataType | None = None) -> Column:
    """A money or frequency cell as double: thousands commas removed, bad cells 0.0."""
    if kind is not None and isinstance(kind, T.NumericType):
        return F.coalesce(_finite(c.cast("double")), F.lit(0.0))
    return F.coalesce(parse_balance(F.replace(c.cast("string"), F.lit(","), F.lit(""))), F.lit(0.0))


_PARTS = ("fine", "micro", "low", "mid", "top", "huge")


def _money_parts(name: str) -> dict[str, str]:
    # value = top * 2^44 + mid * 2^22 + low + micro / 10^6 + fine / 10^12; what is too large
    # for a long stays a double in huge.
    c, mask = quoted(name), (1 << _PART_BITS) - 1
    fits = f"abs({c}) < {_FIXED_POINT_LIMIT!r}D"
    micro = f"rint(({c} - floor({c})) * {_MICRO}.0D)"
    rest = f"({c} - floor({c}) - {micro} / {_MICRO}.0D)"
    own = f"abs({rest}) > abs({c}) * {_HALF_ULP!r}D"
    return {
        "fine": f"if({fits}, if({own}, cast(rint({rest} * {_FINE}.0D) as bigint), 0L), null)",
        "micro": f"if({fits}, cast({micro} as bigint), null)",
        "low": f"if({fits}, floor({c}) & {mask}L, null)",
        "mid": f"if({fits}, shiftright(floor({c}), {_PART_BITS}) & {mask}L, null)",
        "top": f"if({fits}, shiftright(floor({c}), {2 * _PART_BITS}), null)",
        "huge": f"if({fits}, null, {c})",
    }


def money_total(name: str) -> Column:
    """Aggregate: the sum of a double column, exact for every |value| below 2^62."""
    sums = ", ".join(f"'{part}', sum({sql})" for part, sql in _money_parts(name).items())
    return F.expr(f"named_struct({sums})")


def merge_totals(name: str) -> Column:
    """Aggregate: the sum of several ``money_total`` values."""
    c = quoted(name)
    return F.expr("named_struct(" + ", ".join(f"'{p}', sum({c}.{p})" for p in _PARTS) + ")")


def settle(name: str, scale: int | None = 2) -> Column:
    """The double value of a ``money_total`` column, rounded half-even to ``scale``."""
    c, wide = quoted(name), "decimal(38,6)"

    def part(p: str, factor: str = "") -> str:
        return f"cast(cast(coalesce({c}.{p}, 0) as {wide}){factor} as {wide})"

    exact = " + ".join(
        (
            part("top", f" * cast({1 << 2 * _PART_BITS} as decimal(14,0))"),
            part("mid", f" * cast({1 << _PART_BITS} as decimal(7,0))"),
            part("low"),
            part("micro", f" / cast({_MICRO} as decimal(7,0))"),
            part("fine", f" / cast({_FINE} as decimal(13,0))"),
        )
    )
    rounded = exact if scale is None else f"bround({exact}, {scale})"
    return F.expr(f"cast({rounded} as double) + coalesce({c}.huge, 0.0D)")


def whole_units(c: Column, mode: str = "round") -> Column:
    """Whole currency units: half-even ``round`` or ``ceil``; missing counts as 0."""
    filled = F.coalesce(c, F.lit(0.0))
    if mode == "ceil":
        return F.ceil(filled).cast("long")
    if mode == "round":
        return F.bround(filled, 0).cast("long")
    raise ValueError(f"unknown rounding mode {mode!r}; use 'round' or 'ceil'")
