"""Scalar column expressions: rounding, sets, tokens, slugs, hashes.

All are compositions of built-in functions, so they stay inside code generation.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_60 = 1152921504606846976


def to_fixed2(x: Column) -> Column:
    """A value in [0, 1] rounded to two decimals by its exact binary value, halves up.

    ``round`` works on the shortest decimal and rounds 1.005 up and 0.285 to 0.29.
    """
    scaled = (x * F.lit(float(_TWO_60))).cast("bigint").cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)")
    # integral division: the quotient of decimals is rounded at its last digit
    whole = F.call_function("div", scaled + F.lit(_TWO_60 // 2).cast("decimal(20,0)"), F.lit(_TWO_60).cast("decimal(20,0)"))
    return whole.cast("double") / F.lit(100.0)


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays as sets; 0 when both are empty."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def first_match(value: Column, rules: Iterable[tuple[str, str]], otherwise: Column | str) -> Column:
    """The name of the first rule (name, pattern) that matches."""
    otherwise = F.lit(otherwise) if isinstance(otherwise, str) else otherwise
    return reduce(lambda rest, rule: F.when(value.rlike(rule[1]), F.lit(rule[0])).otherwise(rest), reversed(list(rules)), otherwise)


def any_match(value: Column, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (value.rlike(p) for p in patterns))


def tags(value: Column, rules: Iterable[tuple[str, Sequence[str]]]) -> Column:
    """Distinct tags of all rules (pattern, tags) that match, in rule order."""
    lists = [F.when(value.rlike(p), F.array(*map(F.lit, t))).otherwise(F.array().cast("array<string>")) for p, t in rules]
    return F.array_distinct(F.concat(*lists))


def present(values: Column) -> Column:
    """An array without nulls and empty strings."""
    return F.filter(values, lambda x: F.coalesce(x != "", F.lit(False)))


def distinct_sorted(values: Column) -> Column:
    return F.array_sort(F.array_distinct(present(values)))


def normalize_path(path: Column) -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(p.startswith("./"), F.regexp_replace(p, r"^\./+", "")).otherwise(p)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory_of(path: Column) -> Column:
    p = normalize_path(path)
    return F.when(F.contains(p, F.lit("/")), F.substr(p, F.lit(1), F.length(p) - F.length(F.substring_index(p, "/", -1)) - 1)).otherwise(F.lit("repo root"))


def ext_name(path: Column) -> Column:
    """The suffix from the last dot of the base name, lower case; none for a leading dot alone."""
    return F.regexp_extract(F.lower(base_name(path)), r"^.*[^.]+?(\.[^.]*)\z|^\z", 1)


def tokenize(value: Column, min_length: int = 3) -> Column:
    """Lower-case words at camel case and non-alphanumeric borders."""
    spaced = F.lower(F.regexp_replace(value, "([a-z])([A-Z])", "$1 $2"))
    return F.filter(F.split(spaced, "[^a-z0-9]+"), lambda t: F.length(t) >= min_length)


def split_identifier(value: Column) -> Column:
    """Words of an identifier, also split between a digit and a capital."""
    spaced = F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1 $2")
    return present(F.transform(F.split(spaced, "[^A-Za-z0-9]+"), F.lower))


def without_last_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+\z", "")


def path_terms(path: Column) -> Column:
    """Tokens of every path part, its last extension cut."""
    return F.flatten(F.transform(F.split(path, "/"), lambda part: tokenize(without_last_extension(part))))


def slug(value: Column, fallback: str = "") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), r"^-+|-+\z", "")
    return F.when(s == "", F.lit(fallback)).otherwise(s)


def title(value: Column) -> Column:
    """Words at spaces and hyphens with a capital first letter."""
    words = present(F.split(value, r"[\s-]+"))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def singular(term: Column) -> Column:
    ies = F.concat(F.substring(term, F.lit(1), F.length(term) - 3), F.lit("y"))
    return F.when(term.endswith("ies") & (F.length(term) > 4), ies).when(term.endswith("s") & ~term.endswith("ss") & (F.length(term) > 3), F.substring(term, F.lit(1), F.length(term) - 1)).otherwise(term)


def stable_hash(value: Column) -> Column:
    """First 16 hexadecimal digits of the sha256 of a struct's JSON text."""
    return F.substring(F.sha2(F.to_json(value), 256), 1, 16)


def ranked(counts: Column, limit: int) -> Column:
    """The names of an array of (n, name) structs, most frequent first, ties by name."""
    ordered = F.array_sort(F.transform(counts, lambda x: F.struct((-x["n"]).alias("n"), x["name"].alias("name"))))
    return F.slice(F.transform(ordered, lambda x: x["name"]), 1, limit)
