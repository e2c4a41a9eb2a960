"""Names: countries, drugs, sponsors, node ids and token labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from trialspark import fixed_values as fixed
from trialspark.functions.text import collapse_space, lookup, strip


# --- token labels ---------------------------------------------------------------


def title_case(token: Column) -> Column:
    """``NOT_YET_RECRUITING`` -> ``Not Yet Recruiting``."""
    return F.initcap(F.lower(F.translate(token, "_", " ")))


def status_label(token: Column) -> Column:
    return F.coalesce(lookup(fixed.STATUS_LABELS, token), title_case(token))


def intervention_type_label(token: Column) -> Column:
    label = F.coalesce(lookup(fixed.INTERVENTION_TYPE_LABELS, token), token)
    return F.when(token == fixed.UNKNOWN, F.lit(fixed.UNKNOWN_LABEL)).otherwise(label)


def country_label(value: Column) -> Column:
    return F.when(value == fixed.UNKNOWN, F.lit(fixed.UNKNOWN_LABEL)).otherwise(value)


# --- countries ------------------------------------------------------------------


def country_alias(name: Column) -> Column:
    """The canonical country behind a known spelling, null for any other text."""
    key = F.rtrim(F.lower(collapse_space(name)), F.lit("."))
    return lookup(fixed.COUNTRY_ALIASES, key)


def canonical_country(name: Column) -> Column:
    """Canonical country name; other text comes back trimmed, blank text as null."""
    return F.coalesce(country_alias(name), F.nullif(strip(name), F.lit("")))


# --- drugs and sponsors -----------------------------------------------------------


def _words(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def _without_trailing(text: Column, words: tuple[str, ...]) -> Column:
    # Each stripped word needs a blank before it, so the first word always stays.
    return F.regexp_replace(text, f"(?: (?:{'|'.join(words)}))+$", "")


def _or_raw(key: Column, raw: Column) -> Column:
    """A name without a single a-z0-9 keeps its own trimmed lower-case text as key."""
    return F.coalesce(F.nullif(key, F.lit("")), F.lower(strip(raw)))


def _bare_drug(name: Column) -> Column:
    low = F.lower(name)
    has_number = low.rlike(r"(?U)\d")
    undosed = F.when(has_number, F.regexp_replace(low, fixed.DOSE_PATTERN, " ")).otherwise(low)
    return _without_trailing(_words(undosed), fixed.DRUG_TRAILING_WORDS)


def drug_key(name: Column) -> Column:
    """Active-ingredient key: no dose, no punctuation, no trailing salt, form or route."""
    return _or_raw(_bare_drug(name), name)


def drug_keys(names: Column | str) -> Column:
    """:func:`drug_key` of each name of a list, each pattern tried once.

    Inside a list an expression that is used twice is computed twice, so every
    step is a list of its own.
    """
    bare = F.transform(names, _bare_drug)
    return F.zip_with(bare, names, lambda k, n: F.when(k != "", k).otherwise(F.lower(strip(n))))


# Compatibility forms that NFKC folds to a-z0-9 and that occur in names: the
# full-width block by rule, and the ligatures.
_WIDE = "".join(chr(0xFF10 + i) for i in range(10)) + "".join(chr(0xFF41 + i) for i in range(26))
_NARROW = "0123456789abcdefghijklmnopqrstuvwxyz"
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def sponsor_key(name: Column) -> Column:
    """Sponsor key: no punctuation, no trailing legal words, one same-company alias."""
    folded = F.translate(F.lower(name), _WIDE, _NARROW)
    for form, plain in _LIGATURES.items():
        folded = F.replace(folded, F.lit(form), F.lit(plain))
    key = _without_trailing(_words(folded), fixed.SPONSOR_TRAILING_WORDS)
    return _or_raw(F.coalesce(lookup(fixed.SPONSOR_ALIASES, key), key), name)


def _plain_slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def _hashed_slug(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, 8)


def slug(text: Column) -> Column:
    """``a-z0-9-`` form of a key; a key with none of those gets 8 digits of its md5."""
    return F.coalesce(F.nullif(_plain_slug(text), F.lit("")), _hashed_slug(text))


def slugs(texts: Column | str) -> Column:
    """:func:`slug` of each key of a list, see :func:`drug_keys`."""
    return F.zip_with(F.transform(texts, _plain_slug), texts, lambda p, t: F.when(p != "", p).otherwise(_hashed_slug(t)))


def is_placebo(name: Column, other_names: Column) -> Column:
    """A placebo or standard-of-care marker anywhere in the name or the other names."""
    # A line feed keeps a marker from being found across two names.
    text = F.lower(F.concat_ws("\n", name, other_names))
    return text.rlike("|".join(fixed.PLACEBO_MARKERS))


def is_combination(name: Column) -> Column:
    """The name spells out more than one component."""
    return name.rlike(fixed.COMBINATION_PATTERN)
