"""Text scalars as column expressions; all stay inside the JVM.

Patterns carry ``(?U)`` where letters, digits or white space beyond ASCII
count, which Java otherwise leaves out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.config import CHARS_PER_TOKEN

#: Fixed by the definition of a search token: ASCII letters and digits, and U+1000 to U+109F.
TOKEN = "[a-z0-9က-႟]+"
FOLDED_DIGITS = ("၀၁၂၃၄၅၆၇၈၉", "0123456789")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tokens(text: Column) -> Column:
    """Lower-case search tokens in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """What lies between white space, empties dropped."""
    return F.filter(F.split(text, "(?U)\\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """P7."""
    return F.size(words(text))


def strip(text: Column) -> Column:
    """White space of any kind off both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(text, "(?U)\\A\\s+|\\s+\\z", "")


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)\\s+", " ")


def compact_length(text: Column) -> Column:
    """Characters that are not white space."""
    return F.length(F.regexp_replace(text, "(?U)\\s+", ""))


def fold_digits(text: Column) -> Column:
    """P19a."""
    return F.translate(text, *FOLDED_DIGITS)


def digits(text: Column) -> Column:
    """Digits only, folded to ASCII."""
    return F.regexp_replace(fold_digits(text), "(?U)\\D", "")


def loose(text: Column) -> Column:
    """Lower case without white space and commas."""
    return F.lower(F.regexp_replace(fold_digits(text), "(?U)[\\s,\\u00A0]", ""))


def script(text: Column) -> Column:
    """The script most letters belong to; ties go to the first listed."""
    letters = F.regexp_extract_all(text, F.lit("\\p{L}"), F.lit(0))
    count = lambda pattern: F.size(F.filter(letters, lambda c: c.rlike(pattern)))
    latin, myanmar, cjk = count("[\\x{0}-\\x{24F}]"), count("[\\x{1000}-\\x{109F}]"), count("[\\x{3000}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]")
    other = F.size(letters) - latin - myanmar - cjk
    top = F.greatest(latin, myanmar, cjk, other)
    return F.when(F.size(letters) == 0, "unknown").when(latin == top, "latin").when(myanmar == top, "myanmar").when(cjk == top, "cjk").otherwise("other")


def token_estimate(chars: Column) -> Column:
    """Rounded half to even."""
    return F.bround(chars / F.lit(CHARS_PER_TOKEN), 0).cast("long")


def last_entries(items: Column, n: int) -> Column:
    """The last ``n``; a negative slice past the start would give none."""
    return F.when(F.size(items) > n, F.slice(items, -n, n)).otherwise(items)


def secret_hint(secret: Column) -> Column:
    """First and last four characters of what is long enough to hide the rest."""
    return F.when(F.length(secret) > 12, F.concat(F.left(secret, F.lit(4)), F.lit("..."), F.right(secret, F.lit(4)))).when(F.length(secret) > 0, F.lit("set")).otherwise(F.lit(""))


def eval_norm(fact: Column, kind: Column) -> Column:
    """A phone is its last nine digits, all else collapsed lower case."""
    return F.when(kind == "phone", F.right(F.regexp_replace(fact, "(?U)\\D", ""), F.lit(9))).otherwise(F.lower(strip(collapse(fact))))


def eval_hay(text: Column, kind: Column) -> Column:
    """A text in the normal form of ``kind``."""
    return F.when(kind == "phone", F.regexp_replace(text, "(?U)\\D", "")).otherwise(F.lower(collapse(text)))


def eval_contains(text: Column, fact: Column, kind: Column) -> Column:
    """Does the text hold the fact, both in the same normal form?"""
    return F.contains(eval_hay(text, kind), eval_norm(fact, kind))
