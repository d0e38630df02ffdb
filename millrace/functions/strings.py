"""String helpers as Column functions; null handling is stated with each."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's trim() strips every character up to U+0020 at both ends.
_TRIM = r"\A[\x00-\x20]+|[\x00-\x20]+\z"


def trim_all(s: Column) -> Column:
    return F.regexp_replace(s, _TRIM, "")


def nullify(s: Column) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(trim_all(s), F.lit(""))


def unnullify(s: Column) -> Column:
    return F.coalesce(s, F.lit(""))


def addslashes(s: Column) -> Column:
    """Only a value that is exactly one bar gets a backslash."""
    return F.when(s == "|", F.lit("\\|")).otherwise(s)


def join_items(items: Column, separator: str) -> Column:
    return F.array_join(items, separator)


def xml_items(items: Column, element: str) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit(f"<{element}>"), x, F.lit(f"</{element}>"))), "")


def first_part(s: Column) -> Column:
    """Leading run of letters."""
    return F.regexp_extract(s, r"\A\p{L}*", 0)


def smart_concat(prefix: Column, suffix: Column) -> Column:
    """One space between, unless the prefix is empty or ends in one; a null prefix gives the suffix."""
    glue = F.when((prefix == "") | prefix.endswith(" "), F.lit("")).otherwise(F.lit(" "))
    return F.when(prefix.isNull(), suffix).otherwise(F.concat(prefix, glue, suffix))


def correct_case(s: Column) -> Column:
    """First character upper, the rest lower."""
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 2147483647)))


def array_to_string(items: Column) -> Column:
    return F.concat(F.lit("[ "), F.array_join(items, " "), F.lit(" ]"))


def array_member(items: Column, x: Column) -> Column:
    return F.coalesce(F.array_contains(items, x), F.lit(False))


def starts_with(s: Column, needle: Column) -> Column:
    """A null needle is found in anything; nothing is found in a null."""
    return F.when(needle.isNull(), F.lit(True)).otherwise(F.coalesce(F.startswith(s, needle), F.lit(False)))


def ends_with(s: Column, needle: Column) -> Column:
    return F.when(needle.isNull(), F.lit(True)).otherwise(F.coalesce(F.endswith(s, needle), F.lit(False)))


def find_pos(s: Column, char: str) -> Column:
    """Zero-based position of a character, or -1."""
    return F.coalesce(F.locate(char, s) - 1, F.lit(-1))


def maybe_print(label: str, s: Column) -> Column:
    """Label and value; empty for null or UNKNOWN."""
    return F.when(s.isNull() | (s == "UNKNOWN"), F.lit("")).otherwise(F.concat(F.lit(f"{label}: "), s))


def escape_sequences(s: Column, sequences: list[str], escape: str, compat: bool = False) -> Column:
    """The escape before every special sequence; compat leaves one at the start alone."""
    any_of = "|".join(re.escape(x) for x in sorted(sequences, key=len, reverse=True))
    pattern = f"(?<!\\A)({any_of})" if compat else f"({any_of})"
    return F.regexp_replace(s, pattern, escape.replace("\\", "\\\\").replace("$", "\\$") + "$1")


def is_integer(s: Column) -> Column:
    return F.coalesce(s.rlike(r"\A[+-]?[0-9]+\z") & s.try_cast("int").isNotNull(), F.lit(False))


def string_to_ip(s: Column, strict: bool = True) -> Column:
    """Dotted quad as a number; null for another form, and in strict mode for octets above 255."""
    p = F.split(s, r"\.")
    octets = [F.get(p, F.lit(i)) for i in range(4)]
    fine = reduce(lambda a, b: a & b, [is_integer(o) for o in octets], F.size(p) == 4)
    n = [o.try_cast("long") for o in octets]
    if strict:
        fine = reduce(lambda a, b: a & b, [x.between(0, 255) for x in n], fine)
    else:
        n = [F.pmod(x, F.lit(256)) for x in n]
    return F.when(fine, n[0] * 16777216 + n[1] * 65536 + n[2] * 256 + n[3])


def remove_trailing(s: Column, suffix: str) -> Column:
    return F.when(s.endswith(suffix), F.substring(s, F.lit(1), F.length(s) - len(suffix))).otherwise(s)


def remove_trailing_semicolon(s: Column) -> Column:
    return remove_trailing(s, ";")


def chain(s: Column, *transformers) -> Column:
    """Column to column transformers, one after the other."""
    return reduce(lambda c, f: f(c), transformers, s)
