"""Column expressions with the string semantics of Python: white space, digits, case and accents.

Character classes and translation tables come from the Unicode database by rule.
"""

import unicodedata
from functools import lru_cache

from pyspark.sql import functions as F

_SURROGATES = range(0xD800, 0xE000)
_HANGUL_FIRST, _HANGUL_LAST = 0xAC00, 0xD7A3


def _class_of(predicate, shortest=1):
    r"""Regex class body matching the characters for which ``predicate`` holds.

    Ranges of fewer than ``shortest`` characters are left out. Both Java and RE2 read the ``\x{...}`` form.
    """
    ranges = []
    for code in range(0x110000):
        if code in _SURROGATES or not predicate(chr(code)):
            continue
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(
        rf"\x{{{lo:x}}}" if lo == hi else rf"\x{{{lo:x}}}-\x{{{hi:x}}}"
        for lo, hi in ranges
        if hi - lo + 1 >= shortest
    )


@lru_cache(None)
def space_class():
    return _class_of(str.isspace)


@lru_cache(None)
def digit_class():
    r"""Digits as ``str.isdigit`` sees them: decimal digits plus superscripts, circled digits and the like."""
    return r"\p{Nd}" + _class_of(lambda c: c.isdigit() and unicodedata.category(c) != "Nd")


def is_ascii(col):
    return F.octet_length(col) == F.char_length(col)


def is_blank(col):
    """No character but white space; the search ends at the first other character."""
    return ~F.regexp_like(col, F.lit(f"[^{space_class()}]"))


def strip(col):
    """Remove leading and trailing Unicode white space. Most texts have none, which their two ends tell."""
    s = space_class()
    padded = F.regexp_like(F.concat(F.left(col, F.lit(1)), F.right(col, F.lit(1))), F.lit(f"[{s}]"))
    # The look-behind keeps long inner runs of white space linear.
    return F.when(padded, F.regexp_replace(col, rf"\A[{s}]++|(?<![{s}])[{s}]++\z", "")).otherwise(col)


def count_char(col, char):
    return F.char_length(col) - F.char_length(F.replace(col, F.lit(char), F.lit("")))


def count_digits(col):
    ascii_only = F.char_length(col) - F.char_length(F.translate(col, "0123456789", ""))
    return F.when(is_ascii(col), ascii_only).otherwise(F.regexp_count(col, F.lit(f"[{digit_class()}]")))


def has_digit(col):
    return F.regexp_like(col, F.lit(f"[{digit_class()}]"))


def entropy(col):
    """Shannon entropy in bits of the characters of ``col``; 0 for the empty string.

    With n characters of which c_i are of kind i, it is log2(n) - sum(c_i * log2(c_i)) / n.
    """
    n = F.char_length(col)
    weighted = F.aggregate(
        F.array_distinct(F.split(col, "")),
        F.lit(0.0),
        lambda total, char: total + _c_log_c(n - F.char_length(F.replace(col, char, F.lit("")))),
    )
    return F.when(n > 0, F.abs(F.log2(n) - weighted / n)).otherwise(F.lit(0.0))


def _c_log_c(count):
    # A single occurrence adds nothing; ``greatest`` also keeps the logarithm defined.
    return count * F.log2(F.greatest(count, F.lit(1)))


@lru_cache(None)
def _decompositions():
    """Characters changed by compatibility decomposition without combining marks, except Hangul syllables."""
    changed = {}
    for code in range(0x80, 0x110000):
        if code in _SURROGATES or _HANGUL_FIRST <= code <= _HANGUL_LAST:
            continue
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if plain != char:
            changed[char] = plain
    return changed


@lru_cache(None)
def _accent_tables():
    changed = _decompositions()
    single = {c: p for c, p in changed.items() if len(p) == 1}
    removed = [c for c, p in changed.items() if p == ""]
    several = {c: p for c, p in changed.items() if len(p) > 1}
    # ``translate`` deletes characters that have no counterpart, so the removed ones go last.
    source = "".join(single) + "".join(removed)
    target = "".join(single.values())

    def expands(char):
        return char in several or _HANGUL_FIRST <= ord(char) <= _HANGUL_LAST

    # All characters that become several.
    expanding = "".join(several) + "".join(map(chr, range(_HANGUL_FIRST, _HANGUL_LAST + 1)))
    return source, target, several, _class_of(expands), expanding


def _given(col, f):
    """``f`` of a column that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(col), f), F.lit(0))


def strip_accents(col):
    """Compatibility decomposition without combining marks; text in ASCII passes through untouched."""
    source, target, several, expanding_class, expanding = _accent_tables()
    # One literal and not thousands keeps plans small; the map is folded once.
    pairs = "\x01".join(f"{char}\x02{plain}" for char, plain in several.items())
    table = F.str_to_map(F.lit(pairs), F.lit("\x01"), F.lit("\x02"))

    def expand(text, char):
        return F.replace(text, char, F.coalesce(F.try_element_at(table, char), _jamo(char)))

    def expanded(text):
        return F.aggregate(F.array_distinct(F.regexp_extract_all(text, F.lit(f"([{expanding_class}])"), F.lit(1))), text, expand)

    def plain(text, rest):
        has_several = F.octet_length(F.translate(rest, expanding, "")) < F.octet_length(rest)
        has_others = F.translate(rest, source, target) != rest
        return F.when(has_several, F.translate(expanded(text), source, target)).when(
            has_others, F.translate(text, source, target)).otherwise(text)

    # Taking characters out is a lookup for each; a search with a class of many ranges costs ten times that. What may
    # change is looked for among the characters beyond ASCII, of which most texts have few.
    def beyond_ascii(text):
        return F.regexp_replace(text, r"[\x00-\x7f]++", "")

    return _given(col, lambda text: F.when(is_ascii(text), text).otherwise(
        _given(beyond_ascii(text), lambda rest: plain(text, rest))))


def _jamo(syllable):
    """The two or three letters that make up a Hangul syllable (arithmetic of the Unicode standard)."""
    index = F.ascii(syllable) - F.lit(_HANGUL_FIRST)
    leads, vowels, tails = (
        "".join(map(chr, range(first, first + n))) for first, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27))
    )
    lead = F.substr(F.lit(leads), (F.floor(index / 588) + 1).cast("int"), F.lit(1))
    vowel = F.substr(F.lit(vowels), (F.floor(index % 588 / 28) + 1).cast("int"), F.lit(1))
    tail = F.when(index % 28 > 0, F.substr(F.lit(tails), (index % 28).cast("int"), F.lit(1))).otherwise(F.lit(""))
    return F.concat(lead, vowel, tail)
