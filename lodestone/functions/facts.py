"""Hard facts: extraction, canonical forms, and whether a text holds them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import digits, fold_digits, loose, strip

# What counts as a fact.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH = "|".join([*MONTHS, *(m[:3] for m in MONTHS if m != "may")])
EMAIL = "(?U)[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_-]+\\.[\\p{L}\\p{N}_.-]*[\\p{L}\\p{N}_]"
MONEY = "(?iU)(?:RM|MYR)\\s?\\d[\\d,]*(?:\\.\\d{1,2})?"
DATE = (
    "(?iU)\\d{4}-\\d{2}-\\d{2}"
    "|\\b\\d{1,2}/\\d{1,2}/\\d{2,4}\\b"
    f"|\\b\\d{{1,2}}\\s+(?:{MONTH})\\.?,?\\s+\\d{{4}}\\b"
    f"|\\b(?:{MONTH})\\.?\\s+\\d{{1,2}},?\\s+\\d{{4}}\\b"
    f"|\\b(?:{MONTH})\\.?\\s+\\d{{4}}\\b"
)
PHONE = "(?U)\\+?\\d[\\d\\u00A0 (). -]{5,}\\d"
PATTERNS = (("email", EMAIL), ("amount", MONEY), ("date", DATE), ("phone", PHONE))
PHONE_DIGITS = (7, 15)
#: A separate set for what a changed page must be reviewed for.
CRITICAL = {"phone": "(?U)(?:\\+?6?0)\\d[\\d\\s\\-]{6,12}\\d", "money": "(?U)\\bRM\\s?\\d[\\d,]*(?:\\.\\d{2})?", "email": "(?U)[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_-]+\\.[\\p{L}\\p{N}_.]+"}
LABELS = {"phone": "phone number", "email": "email address", "amount": "amount", "date": "date"}


def find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def phones(text: Column) -> Column:
    """phone candidates with 7 to 15 digits."""
    return F.filter(F.transform(find_all(text, PHONE), strip), lambda p: F.length(digits(p)).between(*PHONE_DIGITS))


def date_key(value: Column) -> Column:
    """``YYYY-MM-DD`` or ``YYYY-MM`` of five spellings, else null."""
    v = fold_digits(strip(value))
    part = lambda pattern, k: F.regexp_extract(v, f"(?iU)^(?:{pattern})$", k)
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    month = lambda name: F.lpad(F.array_position(F.array(*(F.lit(m[:3]) for m in MONTHS)), F.substring(F.lower(name), 1, 3)).cast("string"), 2, "0")
    iso, slash = "(\\d{4})-(\\d{2})-(\\d{2})", "(\\d{1,2})/(\\d{1,2})/(\\d{2,4})"
    dmy, mdy, my = f"(\\d{{1,2}})\\s+({MONTH})\\.?,?\\s+(\\d{{4}})", f"({MONTH})\\.?\\s+(\\d{{1,2}}),?\\s+(\\d{{4}})", f"({MONTH})\\.?\\s+(\\d{{4}})"
    year = part(slash, 3).cast("int")
    return (
        F.when(part(iso, 1) != "", F.concat_ws("-", part(iso, 1), two(part(iso, 2)), two(part(iso, 3))))
        .when(part(slash, 1) != "", F.concat_ws("-", F.when(year < 100, year + 2000).otherwise(year).cast("string"), two(part(slash, 2)), two(part(slash, 1))))
        .when(part(dmy, 1) != "", F.concat_ws("-", part(dmy, 3), month(part(dmy, 2)), two(part(dmy, 1))))
        .when(part(mdy, 1) != "", F.concat_ws("-", part(mdy, 3), month(part(mdy, 1)), two(part(mdy, 2))))
        .when(part(my, 1) != "", F.concat_ws("-", part(my, 2), month(part(my, 1))))
    )


def haystack_dates(text: Column) -> Column:
    """P19f: keys of all dates; a full date also stands for its month."""
    keys = F.filter(F.transform(find_all(text, DATE), date_key), lambda k: k.isNotNull())
    return F.array_distinct(F.flatten(F.transform(keys, lambda k: F.array(k, F.substring(k, 1, 7)))))


def phone_variants(value: Column) -> Column:
    """P19d: with the country code and without."""
    d = digits(value)
    return F.when(d.startswith("60"), F.array(d, F.concat(F.lit("0"), F.substring(d, 3, 1 << 20)))).when(d.startswith("0"), F.array(d, F.concat(F.lit("60"), F.substring(d, 2, 1 << 20)))).otherwise(F.array(d))


def money_variants(value: Column) -> Column:
    """P19e: with either currency mark, zero cents dropped."""
    amount = F.regexp_replace(loose(F.regexp_replace(value, "(?i)^(?:rm|myr)", "")), "\\.0+$", "")
    return F.array(F.concat(F.lit("rm"), amount), F.concat(F.lit("myr"), amount))


def extract(text: Column) -> Column:
    """``array<struct<kind, value>>``; each kind blanks what it took before
    the next one looks."""
    def named(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), strip(v).alias("value")))

    parts, rest = [], text
    for kind, pattern in PATTERNS:
        parts.append(named(kind, find_all(rest, pattern)))
        rest = F.regexp_replace(rest, pattern, " ")
    return F.filter(F.concat(*parts), lambda f: (f["kind"] != "phone") | F.length(digits(f["value"])).between(*PHONE_DIGITS))


def fact_key(kind: Column, value: Column) -> Column:
    """Two facts with the same key are one."""
    return F.when(kind == "phone", digits(value)).when(kind == "date", F.coalesce(date_key(value), loose(value))).otherwise(loose(value))


def unverified(answer: Column, haystack: Column) -> Column:
    """Facts of the answer that the haystack lacks, the first
    spelling of each key, in order of kind and place."""
    hay_loose, hay_digits, hay_dates = loose(haystack), digits(haystack), haystack_dates(haystack)
    found = F.transform(extract(answer), lambda f: F.struct(f["kind"].alias("kind"), f["value"].alias("value"), fact_key(f["kind"], f["value"]).alias("key")))

    def there(f: Column) -> Column:
        canon = date_key(f["value"])
        return (
            F.when(f["kind"] == "phone", F.exists(phone_variants(f["value"]), lambda v: F.contains(hay_digits, v)))
            .when(f["kind"] == "amount", F.exists(money_variants(f["value"]), lambda v: F.contains(hay_loose, v)))
            .when((f["kind"] == "date") & canon.isNotNull(), F.array_contains(hay_dates, canon))
            .otherwise(F.contains(hay_loose, f["key"]))
        )

    missing = F.filter(found, lambda f: ~there(f))
    keys = F.transform(missing, lambda f: f["key"])
    first = F.filter(missing, lambda f, i: F.array_position(keys, f["key"]) == i + 1)
    return F.transform(first, lambda f: F.struct(f["kind"].alias("kind"), f["value"].alias("value")))


def describe(facts: Column) -> Column:
    """One plain sentence that names the values in doubt; null if none."""
    label = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    items = F.array_join(F.transform(facts, lambda f: F.concat_ws(" ", F.coalesce(F.element_at(label, f["kind"]), F.lit("value")), f["value"])), ", ")
    return F.when(F.size(facts) > 0, F.concat(F.lit("Check before relying on this: not found in the sources -- "), items, F.lit(".")))


def critical(text: Column, kind: str) -> Column:
    """The set of critical facts of one kind, sorted."""
    return F.sort_array(F.array_distinct(F.transform(find_all(text, CRITICAL[kind]), strip)))
