"""Predicates and rule gates as columns.

A gate is an ordered list of (reason, condition): the first condition that holds
names the reason, no condition means the record passes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairforge.functions import facts as fx
from pairforge.functions.constants import ALLOWED_MODULES
from pairforge.functions.text import as_col, let, strip

# Limits on submissions and tests.
MAX_CODE_CHARS = 8000
MAX_FILE_BYTES = 200_000
MAX_CLIENT_FILE_BYTES = 512 * 1024
MIN_ASSERTS, MAX_ASSERTS = 1, 12

# Calls a test may make besides its target.
ALLOWED_CALLS = (
    "round", "abs", "int", "float", "len", "sum", "max", "min", "set", "sorted", "any", "all",
    "enumerate", "range", "list", "tuple", "dict", "str", "reversed",
)
ALLOWED_EDGE_CALLS = ("isinstance", "type", "repr", "bool", "map", "filter", "zip")

# Markers of numeric and of text-handling code.
NUMERIC_MARKERS = (
    "%", "+", "-", "*", "/", "**", "range(", "sum(", "len(", "for ", "while ", "int(", "float(",
)
STRING_MARKERS = (
    "split(", "join(", "replace(", ".lower(", ".upper(", ".strip(", "startswith(", "endswith(",
    "in 'aeiou'", 'in "aeiou"', "isalpha(", "isdigit(", "re.sub(",
)

# Parts of names and code that decide the kind of prompt.
COUNTER_NAMES = ("count", "uppercase", "lowercase")
COUNTER_PREFIXES = ("num_", "len_")
COUNTER_SUMS = ("sum(", " += 1")
COUNTER_CASES = (".isupper(", ".islower(")
COUNTER_CODE = ("collections.counter(", "return len(")
ANAGRAM_CODE = ("sorted(", "==", ",")
PALINDROME_CODE = ("return", "==", "s[::-1]")
STRING_PREDICATE_CODE = (".isalpha(", ".isdigit(", ".istitle(")
STRING_PREDICATE_NAME = r"\Ais_(alpha|digit|title)\z"
COUNTING_CODE = ("def count_", "def num_", "def len_", "return len(", "sum(", "+= 1", "total +=", "counter(")
PREDICATE_CODE = (" is_", " return true", " return false")

Rule = tuple[str, Column]


def first_reason(rules: list[Rule]) -> Column:
    """Reason of the first failing rule in order, NULL when all pass."""
    return F.coalesce(*[F.when(failed, F.lit(reason)) for reason, failed in rules])


def outcome_of(reason: Column) -> Column:
    return F.when(reason.isNull(), F.lit("kept")).otherwise(F.lit("rejected"))


def contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | text.contains(needle)
    return found


def contains_all(text: Column, needles: tuple[str, ...]) -> Column:
    found = F.lit(True)
    for needle in needles:
        found = found & text.contains(needle)
    return found


def starts_with_any(text: Column, prefixes: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for prefix in prefixes:
        found = found | text.startswith(prefix)
    return found


def is_blank(c: Column | str) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


# --- single predicates --------------------------------------------------------


def has_forbidden_tokens(c: Column | str) -> Column:
    return contains_any(as_col(c), ("__", "import ", ";"))


def has_leading_zero(c: Column | str, mode: str = "strict") -> Column:
    """A number written with a leading zero. ``compat`` also hits the decimals of
    ``1.05`` and digits inside names."""
    before = r"[^\w.]" if mode == "strict" else r"[^0-9]"
    return as_col(c).rlike(rf"(^|{before})0[0-9]+")


def needs_rhs_parse(rhs: Column) -> Column:
    """Expected values that cannot be decided by looking at their characters."""
    return ~rhs.startswith("float('") & rhs.rlike("[A-Za-z_]")


def rhs_allowed(values: Column | str) -> Column:
    """array<boolean> for an array of expected values. Only values with letters go
    to the parser; rows without any send NULL."""
    values = as_col(values)
    worth = F.filter(values, needs_rhs_parse)
    verdicts = fx.rhs_expressions_ok(F.when(F.size(worth) > 0, values))
    # zip_with pads the missing verdicts of skipped rows with NULL.
    return F.zip_with(
        values,
        F.coalesce(verdicts, F.array().cast("array<boolean>")),
        lambda v, ok: ~needs_rhs_parse(v) | F.coalesce(ok, F.lit(False)),
    )


def task_kind(c: Column | str) -> Column:
    """``numeric`` or ``string``, by distinct markers outside quoted literals; ties are ``string``."""

    def hits(text: Column, markers: tuple[str, ...]) -> Column:
        total = F.lit(0)
        for m in markers:
            total = total + text.contains(m).cast("int")
        return total

    bare = F.regexp_replace(F.lower(as_col(c)), r"(?d)\".*?\"|'.*?'", "")
    return let(
        bare, lambda t: F.when(hits(t, NUMERIC_MARKERS) > hits(t, STRING_MARKERS), "numeric").otherwise("string")
    )


def is_string_function(facts: Column) -> Column:
    return facts["str_method_call"]


def is_sorted_compare(facts: Column) -> Column:
    return facts["sorted_compare"]


def expects_strings(code: Column | str) -> Column:
    """The function calls a string method or compares two sorted values, so its arguments are
    texts. Only code with such a name in it goes to the parser; NULL and what does not parse: false."""
    text = as_col(code)
    facts = fx.extract_code_facts(F.when(contains_any(text, fx.STRING_METHODS + ("sorted",)), text))
    return F.coalesce(facts["str_method_call"] | facts["sorted_compare"], F.lit(False))


def is_arithmetic(name: Column, facts: Column) -> Column:
    """Named like a plain operation and defined with exactly two positional arguments."""
    binary = F.exists(facts["functions"], lambda f: (f["name"] == name) & (f["n_args"] == 2))
    return F.lower(name).isin("add", "subtract", "multiply", "power") & binary


def infer_op(facts: Column, name: Column | None = None) -> Column:
    return fx.function_op(facts, name)


def route_prompt(name: Column | str, code: Column | str, facts: Column) -> Column:
    """Prompt kind of one function; the first matching route wins."""

    def body(v: Column) -> Column:
        n, src = F.lower(v["name"]), v["code"]
        low = F.lower(src)
        counter = (
            contains_any(n, COUNTER_NAMES) | starts_with_any(n, COUNTER_PREFIXES)
            | (contains_any(low, COUNTER_SUMS) & contains_any(low, COUNTER_CASES))
            | contains_any(low, COUNTER_CODE)
        )
        anagram = n.contains("is_anagram") | contains_all(src, ANAGRAM_CODE)
        palindrome = n.contains("is_palindrome") | contains_all(src, PALINDROME_CODE)
        string_predicate = contains_any(low, STRING_PREDICATE_CODE) | n.rlike(STRING_PREDICATE_NAME)
        counts = contains_any(low, COUNTING_CODE)
        predicate = v["parse_ok"] & ~counts & (
            v["bool_return"]
            | (v["is_attr_call"] & ~low.contains("len("))
            | contains_any(low, PREDICATE_CODE)
        )
        return (
            F.when(counter, "counter")
            .when(n.contains("is_lower") | low.contains(".islower("), "is_lower")
            .when(n.contains("is_upper") | low.contains(".isupper("), "is_upper")
            .when(anagram, "anagram")
            .when(palindrome, "palindrome")
            .when(string_predicate, "string_predicate")
            .when(predicate, "predicate")
            .when(v["expects_strings"], "expects_strings")
            .otherwise("base")
        )

    return let(
        F.struct(
            as_col(name).alias("name"),
            as_col(code).alias("code"),
            facts["parse_ok"].alias("parse_ok"),
            facts["bool_return"].alias("bool_return"),
            facts["is_attr_call"].alias("is_attr_call"),
            (facts["str_method_call"] | facts["sorted_compare"]).alias("expects_strings"),
        ),
        body,
    )


# --- gates ------------------------------------------------------------------------


def submission_mode(c: Column | str) -> Column:
    mode = F.lower(strip(F.coalesce(as_col(c), F.lit("base"))))
    return F.when(mode == "edge", "edge").otherwise("base")


# Reasons that need an upload's text, and those that need the parser.
TEXT_REASONS = ("upload_too_long",)
PARSER_REASONS = ("not_python", "no_function")


def admission_rules(
    pasted: Column,
    file_bytes: Column,
    code: Column,
    facts: Column,
    n_items: Column | None = None,
    item_limit: Column | None = None,
) -> list[Rule]:
    """Rules of a submission, in order. ``code`` is the pasted text, else the decoded upload."""
    has_paste = F.coalesce(pasted != "", F.lit(False))
    has_file = file_bytes.isNotNull()
    rules: list[Rule] = []
    if n_items is not None:
        rules.append(("session_full", n_items >= item_limit))
    return rules + [
        ("paste_too_long", has_paste & (F.length(pasted) > MAX_CODE_CHARS)),
        ("file_too_large", has_file & (F.octet_length(file_bytes) > MAX_FILE_BYTES)),
        ("nothing_given", ~has_paste & ~has_file),
        ("upload_too_long", ~has_paste & (F.length(code) > MAX_CODE_CHARS)),
        ("not_python", ~F.coalesce(facts["parse_ok"], F.lit(False))),
        ("no_function", F.size(facts["functions"]) == 0),
    ]


def client_file_rules(file_name: Column, size: Column) -> list[Rule]:
    return [
        ("not_a_py_file", ~F.coalesce(file_name.endswith(".py"), F.lit(False))),
        ("file_too_large", size > MAX_CLIENT_FILE_BYTES),
    ]


def registration_rules(username: Column, email: Column, password_length: Column | None = None) -> list[Rule]:
    user, mail = strip(F.coalesce(username, F.lit(""))), strip(F.coalesce(email, F.lit("")))
    rules = [
        ("username_required", user == ""),
        ("username_too_short", F.length(user) < 3),
        ("username_too_long", F.length(user) > 150),
        ("email_required", mail == ""),
        ("email_too_long", F.length(mail) > 254),
        ("email_invalid", ~mail.rlike(EMAIL)),
    ]
    if password_length is not None:
        rules.append(("password_too_short", F.coalesce(password_length, F.lit(0)) < 8))
    return rules


# A dotted local part, then host labels and a top-level label of 2+ letters.
EMAIL = (
    r"\A[A-Za-z0-9!#$%&'*+/=?^_`{}|~-]+(\.[A-Za-z0-9!#$%&'*+/=?^_`{}|~-]+)*"
    r"@([A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}\z"
)


def has_foreign_calls(facts: Column, target: Column, mode: Column | str = "base") -> Column:
    """A call to a bare name that is neither the target nor allowed, or an attribute
    call on an unknown bare name. Chained bases are not looked at; text that does
    not parse counts as foreign."""
    base = F.array(*[F.lit(n) for n in ALLOWED_CALLS])
    edge = F.array(*[F.lit(n) for n in ALLOWED_CALLS + ALLOWED_EDGE_CALLS])
    if isinstance(mode, str):
        allowed = edge if mode == "edge" else base
    else:
        allowed = F.when(mode == "edge", edge).otherwise(base)

    def offends(call: Column) -> Column:
        name_call = (call["kind"] == "name") & (call["name"] != target) & ~F.array_contains(allowed, call["name"])
        return name_call | ((call["kind"] == "attribute") & ~call["module"].isin(*ALLOWED_MODULES))

    return ~facts["parse_ok"] | F.exists(facts["calls"], offends)


def structural_rules(
    text: Column,
    facts: Column,
    target: Column,
    mode: str = "base",
    flow: str = "generate",
    max_asserts: int = MAX_ASSERTS,
    min_focus: float = 1.0,
) -> list[Rule]:
    """Structure of a candidate test. ``generate`` and ``regenerate`` differ in order,
    and only an edge test that is being generated may rely on ``pytest.raises`` alone."""
    n = fx.n_asserts(facts)
    bad_count = ~n.between(MIN_ASSERTS, max_asserts)
    unfocused = F.coalesce(fx.focus_ratio(facts, target), F.lit(0.0)) < min_focus
    raises_only = F.lit(False)
    if mode == "edge" and flow == "generate":
        raises_only = (n == 0) & text.contains("pytest.raises")
    syntax = ("syntax", ~facts["parse_ok"])
    calls = ("does_not_call_target", ~fx.has_call(facts, target))
    foreign = ("foreign_calls", has_foreign_calls(facts, target, mode))
    count = ("bad_assert_count", ~raises_only & bad_count)
    focus = ("assert_without_target", ~raises_only & unfocused)
    if flow == "generate":
        return [syntax, calls, foreign, count, focus]
    return [syntax, count, calls, focus, foreign]


def keep_target_asserts(facts: Column, target: Column) -> Column:
    """Source of the module-level asserts to keep: those calling the target, or all
    of them when no assert would be left. Asserts inside a function are never touched."""

    def body(top: Column) -> Column:
        hits = F.filter(top, lambda a: F.array_contains(a["call_names"], target))
        return F.transform(F.when(F.size(hits) == 0, top).otherwise(hits), lambda a: a["src"])

    return let(F.filter(facts["asserts"], lambda a: a["top_level"]), body)


