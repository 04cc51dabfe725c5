"""Tables whose contents decide results and therefore must not vary."""

# Decoding parameters by kind of task
# (kind, beam_candidates, num_beams, sample_candidates, temperature, top_k).
PRESETS = [
    ("string", 4, 4, 12, 0.85, 100),
    ("numeric", 6, 6, 4, 0.4, 20),
]

# Probes of arithmetic functions (family, a, b, expected).
PROBES = [
    ("add", 3.0, 4.0, 7.0),
    ("add", -2.0, 5.0, 3.0),
    ("add", 0.5, 0.25, 0.75),
    ("subtract", 5.0, 3.0, 2.0),
    ("subtract", -2.0, -3.0, 1.0),
    ("subtract", 0.5, 0.25, 0.25),
    ("multiply", 2.0, 3.0, 6.0),
    ("multiply", -1.0, 5.0, -5.0),
    ("multiply", 2.5, 4.0, 10.0),
    ("power", 2.0, 3.0, 8.0),
    ("power", 3.0, 0.0, 1.0),
    ("power", 9.0, -1.0, 1 / 9),
]

# Modules a test or an expected value may call into.
ALLOWED_MODULES = ("pytest", "math", "decimal", "fractions")

# The test used for a well-known function when no candidate passed.
FALLBACK_TESTS = {
    "add": (
        "def test_add():\n"
        "   assert add(3, 4) == 7\n"
        "   assert add(-2, 5) == 3\n"
    ),
    "subtract": (
        "def test_subtract():\n"
        "   assert subtract(5, 3) == 2\n"
        "   assert subtract(-2, -3) == 1\n"
    ),
    "multiply": (
        "def test_multiply():\n"
        "   assert multiply(2, 3) == 6\n"
        "   assert multiply(-1, 5) == -5\n"
    ),
    "divide": (
        "def test_divide():\n"
        "   assert divide(8, 4) == 2\n"
        "   assert divide(-6, 3) == -2"
    ),
    "power": (
        "def test_power():\n"
        "   assert power(2, 3) == 8\n"
        "   assert power(3, 0) == 1"
    ),
    "count_vowels": (
        "def test_count_vowels():\n"
        "   assert count_vowels('hello') == 2\n"
        "   assert count_vowels('bcd') == 0\n"
        "   assert count_vowels('AEiou') == 5\n"
    ),
    "is_even": (
        "def test_is_even():\n"
        "   assert is_even(2) == True\n"
        "   assert is_even(3) == False\n"
        "   assert is_even(0) == True\n"
    ),
    "is_odd": (
        "def test_is_odd():\n"
        "   assert is_odd(2) == False\n"
        "   assert is_odd(3) == True\n"
        "   assert is_odd(1) == True\n"
    ),
    "is_lower": (
        "def test_is_lower():\n"
        "   assert is_lower('hello') == True\n"
        "   assert is_lower('Hello') == False\n"
        "   assert is_lower('HELLO') == False\n"
    ),
    "is_upper": (
        "def test_is_upper():\n"
        "   assert is_upper('HELLO') == True\n"
        "   assert is_upper('Hello') == False\n"
        "   assert is_upper('123') == False\n"
    ),
    "is_palindrome": (
        "def test_is_palindrome():\n"
        "   assert is_palindrome('racecar') == True\n"
        "   assert is_palindrome('python') == False\n"
    ),
    "reverse_string": (
        "def test_reverse_string():\n"
        "   assert reverse_string('abc') == 'cba'\n"
        "   assert reverse_string('') == ''\n"
    ),
    "repeat_string": (
        "def test_repeat_string():\n"
        "    assert repeat_string('hi', 3) == 'hihihi'\n"
        "    assert repeat_string('a', 0) == ''\n"
        "    assert repeat_string('', 5) == ''\n"
    ),
    "remove_duplicates": (
        "def test_remove_duplicates():\n"
        "   assert remove_duplicates([1,1,2,3,2]) == [1,2,3]\n"
        "   assert remove_duplicates([]) == []\n"
    ),
    "is_anagram": (
        "def test_is_anagram():\n"
        "   assert is_anagram('listen','silent') == True\n"
        "   assert is_anagram('rat','car') == False\n"
    ),
    "reverse_words": (
        "def test_reverse_words():\n"
        "    assert reverse_words('hello world') == 'world hello'\n"
        "    assert reverse_words('a b c') == 'c b a'\n"
        "    assert reverse_words('single') == 'single'\n"
    ),
    "normalize_whitespace": (
        "def test_normalize_whitespace():\n"
        "    assert normalize_whitespace('  hello   world  ') == 'hello world'\n"
        "    assert normalize_whitespace('\\tfoo  bar\\n') == 'foo bar'\n"
    ),
    "strip_punctuation": (
        "def test_strip_punctuation():\n"
        "    assert strip_punctuation('Hello, world!') == 'Hello world'\n"
        "    assert strip_punctuation('Good-morning!!!') == 'Goodmorning'\n"
    ),
    "count_uppercase": (
        "def test_count_uppercase():\n"
        "    assert count_uppercase('Hello World') == 2\n"
        "    assert count_uppercase('no caps') == 0\n"
        "    assert count_uppercase('ABCdef') == 3\n"
        "    assert count_uppercase('123!') == 0\n"
        "    assert count_uppercase('') == 0\n"
    ),
    "strip_numbers": (
        "def test_strip_numbers():\n"
        "    assert strip_numbers('abc123') == 'abc'\n"
        "    assert strip_numbers('no digits') == 'no digits'\n"
        "    assert strip_numbers('42life') == 'life'\n"
    ),
    "replace_substring": (
        "def test_replace_substring():\n"
        "    assert replace_substring('hello world', 'world', 'there') == 'hello there'\n"
        "    assert replace_substring('abcabc', 'a', 'x') == 'xbcxbc'\n"
        "    assert replace_substring('nochange', 'z', 'q') == 'nochange'\n"
    ),
    "remove_vowels": (
        "def test_remove_vowels():\n"
        "    assert remove_vowels('hello') == 'hll'\n"
        "    assert remove_vowels('AEIOU') == ''\n"
        "    assert remove_vowels('xyz') == 'xyz'\n"
    ),
    "count_consonants": (
        "def test_count_consonants():\n"
        "    assert count_consonants('hello') == 3\n"
        "    assert count_consonants('aeiou') == 0\n"
        "    assert count_consonants('bcd') == 3\n"
    ),
    "count_words": (
        "def test_count_words():\n"
        "    assert count_words('hello world') == 2\n"
        "    assert count_words('single') == 1\n"
        "    assert count_words('') == 0\n"
    ),
    "is_positive": (
        "def test_is_positive():\n"
        "    assert is_positive(5) is True\n"
        "    assert is_positive(-1) is False\n"
        "    assert is_positive(0) is False\n"
    ),
    "harmonic_mean": (
        "def test_harmonic_mean():\n"
        "    assert harmonic_mean([1, 1, 1]) == 1\n"
        "    assert harmonic_mean([1, 2, 4]) == pytest.approx(1.7142857)\n"
        "    assert harmonic_mean([]) == 0\n"
    ),
}
