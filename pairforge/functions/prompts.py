"""Prompts as columns: training prompts, routed generation prompts, regeneration prompts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairforge.functions.text import as_col, strip

# Prompt texts. {name} is the function, {code} its source,
# {previous} the earlier test.
TRAINING = {
    "base": (
        "Given this Python function:\n```python\n{code}\n```, write a PyTest unit test function in Python "
        "with at least one assert statement to verify its behavior."
    ),
    "edge": (
        "Given this Python function:\n```python\n{code}\n```, write a PyTest unit test function in Python "
        "that focuses on edge cases and boundary conditions (empty inputs, None, extremes, errors, "
        "invalid types, etc.) with assert statements to verify behavior."
    ),
}
INSTRUCTION = (
    "You are given a Python file that may contain several functions.\n"
    "Your task is to write tests **only** for the function `{name}` shown below.\n"
    "Do not test or call any other functions from the file.\n"
    "\n"
    "Target function:\n"
    "```python\n"
    "{code}\n"
    "```\n"
    "Write ONE PyTest unit test function named `test_<function_name>` with at least two assert statements.\n"
    "- Every assert must call **exactly** `{name}` (use this exact name).\n"
    "- Do not call any other user-defined helpers.\n"
    "- Use only these builtins if needed: abs, round, int, float, len, sum, max, min, and math.\n"
    "- If the code uses string methods (e.g., `.islower()`, `.isupper()`, `.lower()`, `.replace()`), "
    "pass **string arguments** like 'abc'.\n"
    "- If it compares `sorted(a) == sorted(b)`, pass **string pairs** like ('listen', 'silent').\n"
    "- No pytest fixtures, no parametrize, no classes, no print statements.\n"
    "- Output ONLY the test function (no extra text).\n"
)
# Text before and after the instruction, by route.
BEFORE = {
    "counter": """\
### String counter examples
# Use short literals; include empty string and mixed cases.
```python
def test_count_uppercase_small():
    assert count_uppercase('Hello World') == 2
    assert count_uppercase('no caps') == 0
    assert count_uppercase('ABCdef') == 3
    assert count_uppercase('') == 0
```
RULE: For counter functions returning integers, compare with numeric values (0, 1, 2...), never booleans.
""",
    "is_lower": """\
### String predicate examples (LOWER)
Given this function:
```python
def is_lower(s: str) -> bool:
    return s.islower()
```
Correct truth pattern:
- 'hello' -> True
- 'Hello' -> False
- 'HELLO' -> False
- '123'   -> False (no cased letters)
Tests:
```python
def test_is_lower():
    assert is_lower('hello') == True
    assert is_lower('Hello') == False
    assert is_lower('123') == False
```

""",
    "is_upper": """\
### String predicate examples (UPPER)
Given this function:
```python
def is_upper(s: str) -> bool:
    return s.isupper()
```
Correct truth pattern:
- 'HELLO' -> True
- 'Hello' -> False
- 'hello' -> False
- '123'   -> False (no cased letters)
Tests:
```python
def test_is_upper():
    assert is_upper('HELLO') == True
    assert is_upper('Hello') == False
    assert is_upper('123') == False
```

""",
    "anagram": """\
### is_anagram examples
Given this function:
```python
def is_anagram(a: str, b: str) -> bool:
    return sorted(a) == sorted(b)
```
Correct tests:
```python
def test_is_anagram():
    assert is_anagram('listen','silent') == True
    assert is_anagram('rat','car') == False
```

""",
    "palindrome": """\
### is_palindrome examples
Given this function:
```python
def is_palindrome(s: str) -> bool:
    return s == s[::-1]
```
Correct tests:
```python
def test_is_palindrome():
    assert is_palindrome('madam') == True
    assert is_palindrome('python') == False
```

""",
    "string_predicate": """\
### String predicate examples
# Always pass alphabetic strings; digits like '4' are not uppercase letters.
```python
def test_is_upper_basic():
    assert is_upper('HELLO') == True
    assert is_upper('Hello') == False
    assert is_upper('hello') == False
    assert is_upper('123') == False
```
```python
def test_is_lower_basic():
    assert is_lower('hello') == True
    assert is_lower('Hello') == False
    assert is_lower('HELLO') == False
    assert is_lower('abc123') == False
```
""",
    "predicate": """\
### Example A
Given this Python function:
```python
def is_even(n):
    return n % 2 == 0
```
Correct style:
```python
def test_is_even():
    assert is_even(4) == True
    assert is_even(9) == False
```

### Example B
Given this Python function:
```python
def is_prime(n):
    if n <= 1: return False
    if n <= 3: return True
    if n % 2 == 0 or n % 3 == 0: return False
    i = 5
    while i * i <= n:
        if n % i == 0 or n % (i+2) == 0: return False
        i += 6
    return True
```
Correct style (note both asserts call `is_prime`):
```python
def test_is_prime():
    assert is_prime(7) == True
    assert is_prime(32) == False
```

""",
}
AFTER = {
    "counter": (
        "\nRULE: Every assert must call EXACTLY `{name}`; do NOT call `is_upper`/`islower` directly.\n"
        "RULE: Compare the result to integers (0, 1, 2, ...), never booleans.\n"
        "RULE: Include examples with mixed case, empty strings, and no uppercase letters."
    ),
    "is_lower": (
        "\nRULE: For `is_lower`, 'HELLO' must be False, 'hello' must be True, and '123' must be False.\n"
        "Avoid numeric strings as positives."
    ),
    "is_upper": "\nRULE: For `is_upper`, 'HELLO' must be True, 'hello' must be False, and '123' must be False.",
    "anagram": "\nRULE: Every assert must call `{name}` with exactly two string arguments.",
    "palindrome": (
        "\nRULE: Use alphabetic strings or phrases; avoid numbers unless they form true palindromes."
    ),
    "string_predicate": (
        "\nRULE: For string predicates, use alphabetic examples; avoid numeric literals.\n"
    ),
    "expects_strings": (
        "\nAdditional constraints:\n"
        "- Use **string** inputs (e.g., 'HELLO'/'Hello', 'racecar'/'python', 'listen'/'silent').\n"
        "- Avoid numbers for these tests.\n"
    ),
}
# What a regeneration prompt adds.
REGENERATE = (
    "\n\nThe following test function was generated earlier:\n"
    "```python\n"
    "{previous}\n"
    "```\n"
    "Now write a *different* valid PyTest test function for `{name}`:\n"
    "- Use different input combinations or assertions than the previous test.\n"
    "- You may still test similar behavior, but avoid copying the same literal values.\n"
    "- Follow all previous rules (no fixtures, no classes, focus on this function only).\n"
)


def fill(template: str, **values: Column) -> Column:
    """Template with columns in its placeholders; their text is never searched again."""
    parts = re.split(r"\{(name|code|previous)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def by_kind(kind: Column, texts: dict[str, str], **values: Column) -> Column:
    chosen = F.lit("")
    for k, text in texts.items():
        chosen = F.when(kind == k, fill(text, **values)).otherwise(chosen)
    return chosen


def training_prompt(code: Column | str, mode: Column | str = "base") -> Column:
    kind = F.lit(mode) if isinstance(mode, str) else mode
    edge = fill(TRAINING["edge"], code=as_col(code))
    return F.when(kind == "edge", edge).otherwise(fill(TRAINING["base"], code=as_col(code)))


def generation_prompt(kind: Column | str, name: Column | str, code: Column | str) -> Column:
    """Prompt of one function for a route of :func:`pairforge.functions.rules.route_prompt`."""
    kind, name = as_col(kind), as_col(name)
    return F.concat(
        by_kind(kind, BEFORE), fill(INSTRUCTION, name=name, code=strip(code)), by_kind(kind, AFTER, name=name)
    )


def regeneration_prompt(kind: Column | str, name: Column | str, code: Column | str, previous: Column | str) -> Column:
    return F.concat(
        generation_prompt(kind, name, code), fill(REGENERATE, name=as_col(name), previous=strip(previous))
    )
