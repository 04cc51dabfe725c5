"""Text-cleaning columns. Everything here is a built-in expression, so it runs
inside the JVM, needs no shuffle and works on a stream as well as on a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python calls white space (str.strip, re '\s') and line ends
# (str.splitlines). Java's '\s' alone covers ASCII only.
SPACE = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE_CHARS = "".join(
    map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
              0x202F, 0x205F, 0x3000])
)
# The same characters without line ends, and the line ends other than a line feed.
BLANK = r" \t\x{1f}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
OTHER_LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
LINE_END = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"

# Invisible characters removed at the start / anywhere.
LEADING_INVISIBLE = r"[\x{feff}\x{200b}-\x{200d}\x{202a}-\x{202e}\x{2060}-\x{2063}\x{a0}]"
BIDI_ZERO_WIDTH = (
    r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{feff}\x{a0}\x{ad}\x{e000}-\x{f8ff}]"
)

TEST_HEADER = "def test_"
ARITHMETIC_FAMILIES = ("add", "subtract", "multiply", "divide", "power")


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``. Without this a
    cleaning chain with conditionals would repeat the whole chain in every branch."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """Python's ``str.strip``: Unicode white space on both ends."""
    return F.btrim(as_col(c), F.lit(SPACE_CHARS))


def split_lines(c: Column | str) -> Column:
    """Python's ``str.splitlines``: every line end counts, a final one adds no line."""
    return F.split(F.regexp_replace(as_col(c), f"(?:{LINE_END})\\z", ""), LINE_END)


def first_match(c: Column | str, pattern: str, group: int = 1) -> Column:
    """Group of the first match, NULL when there is none."""
    return F.nullif(F.regexp_extract(as_col(c), pattern, group), F.lit(""))


def unix_lines(c: Column | str) -> Column:
    """Every line end as a line feed, none at the end."""
    return F.regexp_replace(F.regexp_replace(as_col(c), f"(?:{LINE_END})\\z", ""), LINE_END, "\n")


# --- line ends, invisible characters, quotes ---------------------------------


def normalize_newlines(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), r"\r\n?", "\n")


def strip_leading_invisible(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), f"\\A{LEADING_INVISIBLE}+", "")


def strip_control(c: Column | str, keep_tab: bool = True) -> Column:
    """Drop the Unicode categories C*, except line feeds (and tabs)."""
    kept = r"\n\t" if keep_tab else r"\n"
    return F.regexp_replace(as_col(c), rf"[\p{{C}}&&[^{kept}]]", "")


def strip_bidi_zw(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), BIDI_ZERO_WIDTH, "")


def ascii_quotes(c: Column | str) -> Column:
    return F.translate(as_col(c), "‘’“”", "''\"\"")


def collapse_space(c: Column | str, preserve_indent: bool = True) -> Column:
    """Runs of blanks become one blank, 3+ line feeds become 2, then trim.
    ``preserve_indent=False`` also squeezes indentation, which breaks nested
    blocks; it exists for parity only."""
    text = strip(c)
    if preserve_indent:
        text = F.regexp_replace(text, r"(?<=[^ \t\n])[ \t]+", " ")
    else:
        text = F.regexp_replace(text, r"[ \t]+", " ")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def similarity_key(c: Column | str) -> Column:
    """Layout-free form of a test: no blank or comment lines, single blanks, lower case."""
    # Joining stripped lines by a blank and squeezing blanks is the same as squeezing the
    # whole text, line ends included, once the comment lines are gone.
    lines = F.translate(as_col(c), OTHER_LINE_ENDS, "\n" * len(OTHER_LINE_ENDS))
    squeezed = F.regexp_replace(F.regexp_replace(lines, f"(?md)^[{BLANK}]*#[^\n]*", ""), f"[{BLANK}\n]+", " ")
    return F.trim(F.lower(squeezed))


def unwrap_quotes(c: Column | str) -> Column:
    """Undo one pair of outer quotes, one pair of escaped quotes, and literal ``\\n`` / ``\\t``."""
    def without(marks: tuple[str, str]) -> Callable[[Column], Column]:
        n = len(marks[0])

        def body(text: Column) -> Column:
            wrapped = (text.startswith(marks[0]) & text.endswith(marks[0])) | (
                text.startswith(marks[1]) & text.endswith(marks[1])
            )
            return F.when(wrapped, F.substring(text, F.lit(n + 1), F.length(text) - 2 * n)).otherwise(text)

        return body

    text = let(let(strip(c), without(('"', "'"))), without(('\\"', "\\'")))
    return F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))


def drop_before(c: Column | str, marker: str = TEST_HEADER) -> Column:
    """Cut everything before the first marker; unchanged without one."""
    return F.regexp_replace(as_col(c), f"(?s)\\A.+?(?={marker})", "")


def keep_first_header(c: Column | str, prefix: str = TEST_HEADER) -> Column:
    """Keep the first line that (stripped) starts with the prefix, drop later ones.

    One pass: the first alternative keeps everything up to the first header, after
    that only the second one can match."""
    header = f"[{SPACE}&&[^\n]]*{prefix}[^\n]*"
    return F.regexp_replace(unix_lines(c), f"(?s)(\\A(?:|.*?\n){header})|\n{header}", "$1")


def escape_stray_backslash(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), r"(?<!\\)\\([^\\nrtbf'\"\\])", r"\\\\$1")


# --- building and standardising tests -----------------------------------------


def ensure_import(c: Column | str) -> Column:
    def body(text: Column) -> Column:
        return F.when(text.contains("import pytest"), text).otherwise(F.concat(F.lit("import pytest\n\n"), text))

    return let(as_col(c), body)


def indent(c: Column | str, prefix: str = "    ") -> Column:
    """Prefix every line that is not blank."""
    return F.regexp_replace(as_col(c), f"(?md)^(?=.*[^{SPACE}])", prefix)


def wrap_as_test(c: Column | str, name: Column | str) -> Column:
    def body(text: Column) -> Column:
        wrapped = F.concat(F.lit("def test_"), as_col(name), F.lit("():\n"), indent(text), F.lit("\n"))
        return F.when(text.rlike(r"(?m)^\s*def\s+\w+\s*\("), text).otherwise(wrapped)

    return let(strip(c), body)


def rename_first_test(c: Column | str, name: Column | str) -> Column:
    """Only the first ``def test_xxx(`` becomes ``def test_<name>(``."""
    return F.regexp_replace(
        as_col(c),
        F.lit(r"(?sm)\A(.*?)^\s*def\s+test_\w+\s*\("),
        F.concat(F.lit("$1def test_"), as_col(name), F.lit("(")),
    )


def fix_identifier_case(c: Column | str, name: Column | str) -> Column:
    """``Name`` / ``NAME`` → ``name``; no blank between the name and ``(``."""
    text, name = as_col(c), as_col(name)
    capital = F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substr(name, F.lit(2))))
    for variant in (capital, F.upper(name)):
        text = F.regexp_replace(text, F.concat(F.lit(r"\b"), variant, F.lit(r"\b")), name)
    return F.regexp_replace(text, F.concat(F.lit(r"\b"), name, F.lit(r"\s*(?=\()")), name)


def fix_assert_spacing(c: Column | str) -> Column:
    text = F.regexp_replace(as_col(c), r"assert\s+(\S)", "assert $1")
    return F.regexp_replace(text, r"assert\s+([^\s=]+)\s*==", "assert $1 ==")


def standardize_test(c: Column | str, name: Column | str, preserve_indent: bool = True) -> Column:
    """Blanks, first header, identifier case and assert spacing in one go."""
    text = rename_first_test(collapse_space(c, preserve_indent), name)
    return strip(fix_assert_spacing(fix_identifier_case(text, name)))


def clean_layout(c: Column | str, name: Column | str) -> Column:
    """Everything the sanitiser does before its final parse check."""
    text = F.coalesce(as_col(c), F.lit(""))
    text = drop_before(normalize_newlines(text))
    # Tabs are control characters, so this step removes them as well.
    text = strip_bidi_zw(strip_control(text, keep_tab=False))
    stub = F.concat(F.lit("def test_"), as_col(name), F.lit("():\n    pass"))
    text = let(
        strip(ascii_quotes(text)), lambda t: F.when(t.rlike(r"\Adef\s+test_"), t).otherwise(stub)
    )
    return escape_stray_backslash(keep_first_header(text))


# The test that stands for a text that does not parse.
SMOKE_TEST = "def test_{name}():\n    # fallback: callable smoke test\n    assert callable({name})\n"


def fill_name(template: str, name: Column | str) -> Column:
    return F.replace(F.lit(template), F.lit("{name}"), as_col(name))


def smoke_test(name: Column | str) -> Column:
    """Last resort of the sanitiser for text that does not parse."""
    return fill_name(SMOKE_TEST, name)


# --- names and titles -----------------------------------------------------------


# How a function is found in text. Word characters and blanks are Unicode's.
DEF_NAME = r"(?U)def\s+([a-zA-Z_]\w*)\s*\("
DEF_LINE = r"(?mU)^def\s+([a-zA-Z_]\w*)\s*\("


def def_name(c: Column | str) -> Column:
    return first_match(c, DEF_NAME)


def def_names(c: Column | str) -> Column:
    """Names of all ``def`` lines that start in column 0, in order."""
    return F.regexp_extract_all(as_col(c), F.lit(DEF_LINE), F.lit(1))


def function_name_or_default(c: Column | str, parsed_name: Column | None = None) -> Column:
    """First parsed non-test function → first ``def x(`` → first ``x =`` → ``generated``."""
    candidates = [] if parsed_name is None else [parsed_name]
    candidates += [
        first_match(c, r"\bdef\s+([A-Za-z_][A-Za-z_0-9]*)\s*\("),
        first_match(c, r"([A-Za-z_][A-Za-z_0-9]*)\s*="),
        F.lit("generated"),
    ]
    return F.coalesce(*candidates)


def family_of(name: Column | str) -> Column:
    return F.split_part(as_col(name), F.lit("_"), F.lit(1))


def is_arithmetic_family(name: Column | str) -> Column:
    return family_of(name).isin(*ARITHMETIC_FAMILIES)


def export_name(tests: Column | str, item_id: Column | str) -> Column:
    named = first_match(tests, r"def\s+(test_[a-zA-Z0-9_]+)\s*\(")
    return F.concat(
        F.coalesce(named, F.concat(F.lit("tests_item_"), as_col(item_id).cast("string"))), F.lit(".py")
    )


def session_title(
    names: Column | str,
    title: Column | None = None,
    file_name: Column | None = None,
    at: Column | None = None,
) -> Column:
    """Title from function names, else from the file stem, else from the time.
    A title that is already set wins."""
    def from_names(called: Column) -> Column:
        n = F.size(called)
        return (
            F.when(n == 1, F.concat(F.lit("Tests for "), F.get(called, F.lit(0))))
            .when(n.between(2, 3), F.array_join(called, ", "))
            .when(n > 3, F.concat(F.get(called, F.lit(0)), F.lit(" + "), (n - 1).cast("string"), F.lit(" more")))
        )

    options = [let(F.transform(as_col(names), lambda x: F.concat(x, F.lit("()"))), from_names)]
    if title is not None:
        options.insert(0, F.nullif(title, F.lit("")))
    if file_name is not None:
        base = F.regexp_replace(file_name, r"^.*/", "")
        stem = F.regexp_replace(base, r"(?<=.)\.[^.]+$", "")
        options.append(F.concat(stem, F.lit(".py tests")))
    if at is not None:
        options.append(F.concat(F.lit("Session – "), F.date_format(at, "dd MMM HH:mm")))
    return F.coalesce(*options)


def _header_name(text: Column, prefix: str) -> Column:
    """Name between ``def`` and ``(`` on the first line with that (stripped) start."""
    return F.nullif(strip(F.regexp_extract(text, f"(?m)^[{SPACE}]*{prefix}([^(\\n]*)\\(", 1)), F.lit(""))


def auto_title(title: Column | str, session_id: Column | str, code: Column | str, tests: Column | str) -> Column:
    """Replace a default-looking title by ``Tests for <function>()``."""
    title, sid = as_col(title), as_col(session_id).cast("string")
    is_default = F.array_contains(
        F.array(F.lit(""), F.lit("new session"), F.concat(F.lit("session #"), sid), F.concat(F.lit("session "), sid)),
        F.lower(strip(F.coalesce(title, F.lit("")))),
    )
    from_code = _header_name(as_col(code), "def (?!test_)")
    # A doubled prefix (test_test_x) loses one part only.
    from_tests = _header_name(as_col(tests), TEST_HEADER)

    def body(name: Column) -> Column:
        return F.when(is_default & name.isNotNull(), F.concat(F.lit("Tests for "), name, F.lit("()"))).otherwise(title)

    return let(F.coalesce(from_code, from_tests), body)


# --- tokens -----------------------------------------------------------------------

# A token is a run of letters, marks, digits and underscores, or one other sign.
WORD_CHARS = r"\p{L}\p{M}\p{N}_"
TOKEN = rf"[{WORD_CHARS}]+|[^{WORD_CHARS}{SPACE}]"


def tokens(c: Column | str) -> Column:
    """Word and punctuation tokens (model-free stand-in for a sub-word tokenizer)."""
    return F.regexp_extract_all(as_col(c), F.lit(TOKEN), F.lit(0))


def truncate_tokens(c: Column | str, n: int) -> Column:
    """struct<text, n_tokens, was_truncated>: the text up to the end of its ``n``-th token,
    layout and all. A text of at most ``n`` tokens stays byte for byte.

    One bounded pattern reads no further than the cut; only texts shorter than that have
    their tokens counted."""
    head = F.regexp_extract(as_col(c), rf"\A(?:[{SPACE}]*+(?:[{WORD_CHARS}]++|[^{WORD_CHARS}{SPACE}])){{{n}}}", 0)

    def body(v: Column) -> Column:
        full = v["head"] != ""
        more = full & F.substring(v["text"], F.length(v["head"]) + 1, F.length(v["text"])).rlike(f"[^{SPACE}]")
        return F.struct(
            F.when(more, v["head"]).otherwise(v["text"]).alias("text"),
            F.when(full, F.lit(n)).otherwise(F.size(tokens(v["text"]))).alias("n_tokens"),
            more.alias("was_truncated"),
        )

    return let(F.struct(as_col(c).alias("text"), head.alias("head")), body)
