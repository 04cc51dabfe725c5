"""Test blocks: merging single-function tests into one text and taking it apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.text import SPACE, as_col, let, split_lines, strip, unix_lines
from pairforge.operators.ranking import running_totals

GENERATED_ORIGIN = "Beams (multi-function)"
REGENERATED_ORIGIN = "Regen (multi-function)\n"
INDENT = f"[{SPACE}&&[^\\n]]*"
TEST_DEF = r"def\s+test_([A-Za-z_][A-Za-z_0-9]*)\s*\("


def snippet_body(snippet: Column | str, import_seen: Column) -> Column:
    """Snippet without origin comments and without ``import pytest`` lines, except the
    very first one (``import_seen``: an earlier snippet had one)."""

    def body(lines: Column) -> Column:
        is_import = F.transform(lines, lambda x: strip(x).startswith("import pytest"))
        first = F.when(import_seen, F.lit(-1)).otherwise(F.array_position(is_import, True).cast("int") - 1)
        return let(first, lambda at: _without_headers(lines, at))

    return strip(F.array_join(let(split_lines(snippet), body), "\n"))


def _without_headers(lines: Column, first_import: Column) -> Column:
    kept = F.filter(
        lines,
        lambda x, i: ~strip(x).startswith("# Origin")
        & (~strip(x).startswith("import pytest") | (i == first_import)),
    )
    return F.transform(
        kept, lambda x: F.when(strip(x).startswith("import pytest"), F.lit("import pytest")).otherwise(x)
    )


def has_import_line(snippet: Column | str) -> Column:
    return as_col(snippet).rlike(f"(?m)^{INDENT}import pytest")


def merge_snippets(snippets: Column | str, origin: str = GENERATED_ORIGIN) -> Column:
    """One block from an array of snippets (the functions of one submission): a single
    origin header, a single import, bodies parted by a blank line."""

    def body(parts: Column) -> Column:
        with_import = F.transform(parts, has_import_line)
        first = F.array_position(with_import, True).cast("int") - 1
        bodies = let(
            first, lambda f: F.transform(parts, lambda s, i: snippet_body(s, (f >= 0) & (i > f)))
        )
        return F.concat(F.lit(f"# Origin: {origin}\n"), F.array_join(F.filter(bodies, lambda b: b != ""), "\n\n"))

    return let(as_col(snippets), body)


def merge_tests(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    bucket: Column | None = None,
    snippet: str = "snippet",
    origin: str = GENERATED_ORIGIN,
    page_size: int = 1000,
) -> DataFrame:
    """:func:`merge_snippets` over rows: one block per key, in order.

    A block must fit into a cell, so it comes in pages of ``page_size`` snippets.
    Page 0 carries the header; pages joined by a blank line give the whole block.
    Positions and "an import came before" are skew-safe running totals."""
    placed = running_totals(
        df, keys, order, bucket,
        {"_position": F.lit(1).cast("bigint"), "_imports": has_import_line(snippet).cast("bigint")},
    )
    text = snippet_body(snippet, F.col("_imports") > 0)
    return (
        placed.select(*keys, "_position", F.floor(F.col("_position") / page_size).alias("page"), text.alias("_body"))
        .filter(F.col("_body") != "")
        .groupBy(*keys, "page")
        .agg(F.array_sort(F.collect_list(F.struct("_position", "_body"))).alias("_bodies"))
        .select(
            *keys,
            "page",
            F.concat(
                F.when(F.col("page") == 0, F.lit(f"# Origin: {origin}\n")).otherwise(F.lit("")),
                F.array_join(F.transform("_bodies", lambda b: b["_body"]), "\n\n"),
            ).alias("block"),
        )
    )


def split_tests(block: Column | str, names: Column | str) -> Column:
    """map<name, source>: the block cut at every test header. Tests of other names are
    dropped, the last slice of a repeated name wins, a name without a slice gets ''.

    Header lines are marked with a control character and the text split there, which
    is linear in the block; a running scan over its lines would not be."""
    mark = "\x01"
    text = F.regexp_replace(F.replace(unix_lines(block), F.lit(mark), F.lit("")), f"(?m)^(?={INDENT}{TEST_DEF})", mark)
    # The part before the first header belongs to no test.
    slices = F.filter(F.split(text, mark), lambda s: s.rlike(rf"\A\s*{TEST_DEF}"))
    named = F.transform(
        slices,
        lambda s: F.struct(
            F.regexp_replace(F.regexp_extract(s, TEST_DEF, 1), r"\Atest_", "").alias("name"), strip(s).alias("src")
        ),
    )

    def body(v: Column) -> Column:
        def last_of(name: Column) -> Column:
            mine = F.filter(v["named"], lambda t: t["name"] == name)
            return F.coalesce(F.get(mine, F.size(mine) - 1)["src"], F.lit(""))

        known = F.array_distinct(v["names"])
        return F.map_from_arrays(known, F.transform(known, last_of))

    return let(F.struct(named.alias("named"), as_col(names).alias("names")), body)


def previous_test(slices: Column, name: Column | str) -> Column:
    """The earlier test of one function, '' when the block had none."""
    return F.coalesce(F.try_element_at(slices, as_col(name)), F.lit(""))
