"""Tolerant comparison of tables and of asserts whose sides are already values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.literals import INT_LITERAL, arrays_close, compare_close, is_close, number
from pairforge.functions.text import let, strip


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], value: str, rtol: float = 1e-9,
              atol: float = 1e-9) -> DataFrame:
    """Full outer comparison of one value per key: matching / differing / left_only /
    right_only. Both sides must hold one row per key (aggregate first), so the join
    is one to one."""
    a = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("_in_left"))
    b = right.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("_in_right"))
    close = F.coalesce(
        is_close(F.col("left_value"), F.col("right_value"), rtol, atol),
        F.col("left_value").isNull() & F.col("right_value").isNull(),
    )
    status = (
        F.when(F.col("_in_right").isNull(), "left_only")
        .when(F.col("_in_left").isNull(), "right_only")
        .when(close, "matching")
        .otherwise("differing")
    )
    return a.join(b, keys, "full_outer").withColumn("status", status).drop("_in_left", "_in_right")


def _truthy(text: Column) -> Column:
    """Truth of literal text; NULL when the text is no literal known here."""
    n = number(text)["d"]
    return (
        F.when(text == "True", F.lit(True))
        .when(text.isin("False", "None", "''", '""', "()", "[]", "{}"), F.lit(False))
        .when(n.isNotNull(), n != 0)
        .when(text.rlike(r"\A('[^']+'|\"[^\"]+\")\z"), F.lit(True))
    )


def _as_number(text: Column) -> Column:
    """Number behind a literal; True and False compare as 1 and 0. Integers of over 38 digits
    are doubles here, and none where a double cannot hold them."""
    wide = F.when(text.rlike(INT_LITERAL), text.try_cast("double"))
    wide = F.when(F.abs(wide) < float("inf"), wide)
    return F.when(text == "True", F.lit(1.0)).when(text == "False", F.lit(0.0)).otherwise(F.coalesce(number(text)["d"], wide))


QUOTED = r"\A('[^'\\]*'|\"[^\"\\]*\")\z"
NUMBERS = r"\A(\[[-+0-9.eE,\s]*\]|\([-+0-9.eE,\s]*\))\z"


def _inner(text: Column) -> Column:
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _elements(text: Column) -> Column:
    """Numbers of a list or tuple display, NULL for anything else."""
    items = F.transform(F.split(F.regexp_replace(_inner(text), r",\s*\z", ""), ","), lambda t: number(strip(t))["d"])
    empty = F.array().cast("array<double>")
    return F.when(text.rlike(NUMBERS), F.when(strip(_inner(text)) == "", empty).otherwise(items))


def _is_literal(text: Column) -> Column:
    return (
        _as_number(text).isNotNull() | text.isin("True", "False", "None") | text.rlike(QUOTED) | text.rlike(NUMBERS)
    )


def side_holds(left: Column, op: Column, right: Column) -> Column:
    """Does ``left op right`` hold for two literal texts? NULL when it cannot be told.

    Numbers compare with tolerance, lists and tuples of numbers element by element,
    ``is`` is strict for a boolean right side and compares truth otherwise, equal text
    is equal, ordering of non-numbers is trusted."""

    def body(v: Column) -> Column:
        left, op, right = v["left"], v["op"], v["right"]
        a, b = _as_number(left), _as_number(right)
        same_kind = F.substring(left, 1, 1) == F.substring(right, 1, 1)
        identical = F.when(right.isin("True", "False"), left == right).otherwise(_truthy(left) == _truthy(right))
        equal = (
            F.when(a.isNotNull() & b.isNotNull(), is_close(a, b))
            .when(left.rlike(NUMBERS) & right.rlike(NUMBERS), same_kind & arrays_close(_elements(left), _elements(right)))
            .when(left.rlike(QUOTED) & right.rlike(QUOTED), _inner(left) == _inner(right))
            .otherwise(left == right)
        )
        return F.when(
            _is_literal(left) & _is_literal(right),
            F.when(op == "is", identical)
            .when(op == "is not", ~identical)
            .when(op == "==", equal)
            .when(op == "!=", ~equal)
            .when(a.isNotNull() & b.isNotNull(), compare_close(a, b, op))
            .otherwise(F.lit(True)),
        )

    return let(F.struct(left.alias("left"), op.alias("op"), right.alias("right")), body)


def asserts_hold(asserts: Column) -> Column:
    """All asserts (facts array, sides already reduced to literals) hold. A chain
    ``a < b < c`` holds pairwise; a bare value is checked for truth; anything that
    cannot be evaluated makes the whole test fail."""

    def one(a: Column) -> Column:
        chain = F.forall(
            F.sequence(F.lit(0), F.size(a["ops"]) - 1),
            lambda i: F.coalesce(
                side_holds(F.get(a["sides"], i), F.get(a["ops"], i), F.get(a["sides"], i + 1)), F.lit(False)
            ),
        )
        return F.when(F.size(a["ops"]) > 0, chain).otherwise(
            F.coalesce(_truthy(F.get(a["sides"], F.lit(0))), F.lit(False))
        )

    return F.forall(asserts, one)
