"""Number literals, closed-form arithmetic and tolerant comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairforge.functions.text import as_col, let

INT_LITERAL = r"\A[-+]?(0+|[1-9][0-9]*)\z"
FLOAT_LITERAL = r"\A[-+]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+(?=[eE]))([eE][-+]?[0-9]+)?\z"
# Integers above this are not exact in a double.
EXACT_INT = float(2**53)
# Integers beyond a long are computed as decimals of 38 digits.
WIDE = "decimal(38,0)"
# Largest double below 2**63; digits of larger ones are approximate.
LONG_LIMIT = float(2**63 - 1024)


def _ten_decimals(x: Column) -> Column:
    """|x| with ten decimals, rounded half-even on the *exact* binary value, for
    2**-10 <= |x| < 2**53. Formatting functions round the shortest decimal form, which
    differs once a number has more than 17 digits or sits next to a tie.

    The fraction is a multiple of 2**-62 there, so frac·10**10 is frac·2**62·5**10 / 2**52,
    taken apart into two products that fit into a long.
    Every step hands all it needs to the next one in a struct."""
    whole = F.floor(F.abs(x))
    start = F.struct(
        F.when(x < 0, "-").otherwise("").alias("sign"),
        whole.alias("whole"),
        ((F.abs(x) - whole) * float(2**62)).cast("bigint").alias("m"),
    )

    def products(v: Column) -> Column:
        low = v["m"].bitwiseAND(F.lit(2**31 - 1)) * F.lit(5**10)
        high = F.shiftright(v["m"], 31) * F.lit(5**10) + F.shiftright(low, 31)
        rest = F.shiftleft(high.bitwiseAND(F.lit(2**21 - 1)), 31) + low.bitwiseAND(F.lit(2**31 - 1))
        return F.struct(v["sign"].alias("sign"), v["whole"].alias("whole"), F.shiftright(high, 21).alias("q"), rest.alias("r"))

    def rounded(v: Column) -> Column:
        up = (v["r"] > 2**51) | ((v["r"] == 2**51) & (v["q"] % 2 == 1))
        return F.struct(v["sign"].alias("sign"), v["whole"].alias("whole"), (v["q"] + up.cast("bigint")).alias("d"))

    def text(v: Column) -> Column:
        carry = F.when(v["d"] == 10**10, 1).otherwise(0)
        decimals = F.lpad((v["d"] % 10**10).cast("string"), 10, "0")
        return F.concat(v["sign"], (v["whole"] + carry).cast("string"), F.lit("."), decimals)

    return let(let(let(start, products), rounded), text)


def format_literal(x: Column | str, keep_float_zero: bool = True) -> Column:
    """A double as literal text: at most 10 decimals, integral values as ints.

    ``keep_float_zero``: the audit writes a float zero as ``0.0``; the candidate
    cleaner writes ``0``. Rounding is half-even, as in C-style formatting."""
    def body(x: Column) -> Column:
        tiny = F.format_string("%.10f", F.bround(x, 10))
        digits = F.when(F.abs(x) < 2.0**-10, tiny).otherwise(_ten_decimals(x))
        text = F.regexp_replace(F.regexp_replace(digits, r"0+\z", ""), r"\.\z", "")
        zero = "0.0" if keep_float_zero else "0"
        return (
            F.when(x.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(x), F.lit("float('nan')"))
            .when(x == float("inf"), F.lit("float('inf')"))
            .when(x == float("-inf"), F.lit("float('-inf')"))
            .when(x == 0, F.lit(zero))
            # Whole numbers: all digits of the double, not its shortest form.
            .when(F.abs(x).between(EXACT_INT, LONG_LIMIT), x.cast("bigint").cast("string"))
            .otherwise(F.regexp_replace(text, r"\A-0\z", "0"))
        )

    return let(as_col(x).cast("double"), body)


def number(text: Column) -> Column:
    """struct<i bigint, e decimal(38,0), d double>: ``e`` is set for int literals of up to 38
    digits, ``i`` for those that fit into a long, ``d`` for every numeric literal; all NULL for
    anything else (or on overflow)."""
    is_int, is_float = text.rlike(INT_LITERAL), text.rlike(FLOAT_LITERAL)
    # Only what a long cannot hold is read as a decimal.
    i, wide = F.when(is_int, text.try_cast("bigint")), F.when(is_int, text.try_cast(WIDE))
    return F.struct(
        i.alias("i"),
        F.coalesce(i.cast(WIDE), wide).alias("e"),
        F.coalesce(i.cast("double"), wide.cast("double"), F.when(is_float, text.try_cast("double"))).alias("d"),
    )


def _wide_value(op: Column, i: Column, j: Column) -> Column:
    """``i op j`` for ints of up to 38 digits, exact; NULL beyond."""
    remainder = F.try_mod(i, j)
    quotient = F.try_divide(F.try_subtract(i, remainder), j).cast(WIDE)
    floored = F.when((remainder != 0) & ((remainder < 0) != (j < 0)), F.try_subtract(quotient, F.lit(1)).cast(WIDE)).otherwise(quotient)
    factors = F.sequence(F.lit(1), j.cast("int"))
    power = F.aggregate(factors, F.lit(1).cast(WIDE), lambda product, _: F.try_multiply(product, i).cast(WIDE))
    return (
        F.when(op == "+", F.try_add(i, j).cast(WIDE))
        .when(op == "-", F.try_subtract(i, j).cast(WIDE))
        .when(op == "*", F.try_multiply(i, j).cast(WIDE))
        .when(op == "//", floored)
        .when((op == "**") & j.between(1, 126), power)
    )


def closed_form(op: Column, x: Column, y: Column) -> Column:
    """Value of ``x op y`` for two :func:`number` structs, without running any code.

    struct<known boolean, raises boolean, text string>. Python rules: ints stay
    ints except under ``/`` and negative powers, ``//`` floors, division by zero and
    float power overflow raise. Ints are exact up to 38 digits and unknown beyond, never wrong."""
    return let(F.struct(op.alias("op"), x.alias("x"), y.alias("y")), _closed_form)


def _closed_form(v: Column) -> Column:
    op, i, j, a, b = v["op"], v["x"]["i"], v["y"]["i"], v["x"]["d"], v["y"]["d"]
    wide_i, wide_j = v["x"]["e"], v["y"]["e"]
    ints = wide_i.isNotNull() & wide_j.isNotNull()
    finite = (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    raises = F.coalesce(
        (op.isin("/", "//") & (b == 0))
        | ((op == "**") & (a == 0) & (b < 0))
        | ((op == "**") & ~ints & finite & (F.abs(F.pow(a, b)) == float("inf"))),
        F.lit(False),
    )
    # '/' and '**' on ints above 2**53 would round twice; such values stay unknown.
    exact = ~ints | ((F.abs(a) <= EXACT_INT) & (F.abs(b) <= EXACT_INT))
    remainder = F.try_mod(i, j)
    truncated = F.try_divide(F.try_subtract(i, remainder), j).cast("bigint")
    int_value = (
        F.when(op == "+", F.try_add(i, j))
        .when(op == "-", F.try_subtract(i, j))
        .when(op == "*", F.try_multiply(i, j))
        .when(
            (op == "//") & exact,
            F.when((remainder != 0) & ((remainder < 0) != (j < 0)), truncated - 1).otherwise(truncated),
        )
        .when((op == "**") & (F.abs(F.pow(a, b)) < EXACT_INT), F.pow(a, b).cast("bigint"))
    )
    float_value = (
        F.when(op == "+", a + b)
        .when(op == "-", a - b)
        .when(op == "*", a * b)
        .when((op == "/") & exact, F.try_divide(a, b))
        # Beyond 2**53 a floored double quotient may be off by one.
        .when((op == "//") & (F.abs(F.try_divide(a, b)) < EXACT_INT), _float_floor_div(a, b))
        # A negative base with a fractional exponent is complex: unknown.
        .when((op == "**") & exact & ~F.isnan(F.pow(a, b)), F.pow(a, b))
    )
    stays_int = ints & (op != "/") & ~((op == "**") & (b < 0))

    def with_digits(x: Column) -> Column:
        return F.when((F.abs(x) <= LONG_LIMIT) | (F.abs(x) == float("inf")) | F.isnan(x), x)

    whole = F.coalesce(int_value.cast("string"), _wide_value(op, wide_i, wide_j).cast("string"))
    text = F.when(stays_int, whole).otherwise(format_literal(let(float_value, with_digits)))
    text = F.when(~raises & a.isNotNull() & b.isNotNull(), text)

    def pack(t: Column) -> Column:
        return F.struct((raises | t.isNotNull()).alias("known"), raises.alias("raises"), t.alias("text"))

    return let(text, pack)


def _float_floor_div(a: Column, b: Column) -> Column:
    """Floor of the exact quotient, as Python computes it from the remainder."""
    remainder = F.try_mod(a, b)
    shifted = F.when((remainder != 0) & ((remainder < 0) != (b < 0)), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.round(F.try_divide(a - remainder, b), 0) - shifted


def is_close(a: Column, b: Column, rtol: float = 1e-9, atol: float = 1e-9) -> Column:
    """Python's ``math.isclose``: NaN equals nothing, an infinity equals itself only."""
    a, b = a.cast("double"), b.cast("double")
    infinite = (F.abs(a) == float("inf")) | (F.abs(b) == float("inf"))
    near = F.abs(a - b) <= F.greatest(rtol * F.greatest(F.abs(a), F.abs(b)), F.lit(atol))
    return F.when(F.isnan(a) | F.isnan(b), F.lit(False)).when(infinite, a == b).otherwise(near)


def compare_close(a: Column, b: Column, op: Column | str, rtol: float = 1e-9, atol: float = 1e-9) -> Column:
    """Tolerant ``== != < <= > >=``: strict orders need a real difference, weak
    ones accept closeness. An unknown operator does not block."""
    op = F.lit(op) if isinstance(op, str) else op
    close = is_close(a, b, rtol, atol)
    nan = F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
    below, above = (a < b) & ~nan, (a > b) & ~nan
    return (
        F.when(op == "==", close)
        .when(op == "!=", ~close)
        .when(op == "<", below & ~close)
        .when(op == "<=", below | close)
        .when(op == ">", above & ~close)
        .when(op == ">=", above | close)
        .otherwise(F.lit(True))
    )


def arrays_close(a: Column, b: Column, rtol: float = 1e-9, atol: float = 1e-9) -> Column:
    """Element-wise tolerant equality of two arrays of the same length."""
    pairs = F.zip_with(a, b, lambda x, y: F.coalesce(is_close(x, y, rtol, atol), F.lit(False)))
    return (F.size(a) == F.size(b)) & F.forall(pairs, lambda x: x)
