"""Name normalisation, book keys and secret redaction."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Generational suffixes and common short first names.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")
FIRST_NAMES = {"gabe": "gabriel", "mike": "michael", "will": "william"}


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, dict[str, str]]:
    """Compatibility decomposition of every character that has an ASCII part.

    Derived from the Unicode database: characters folding to one ASCII character as a
    translation pair of strings, the others as a map.
    """
    single, target, longer = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.decomposition(char) == "":
            continue
        folded = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            single.append(char)
            target.append(folded)
        elif folded:
            longer[char] = folded
    return "".join(single), "".join(target), longer


def ascii_fold(name: Column) -> Column:
    """Compatibility-decomposed ASCII, inside the JVM.

    Decomposition works per character and marks are dropped anyway, so a character table is
    exact. Plain ASCII names are returned untouched.
    """
    single, target, longer = _folds()
    several = "[" + "".join(longer) + "]"
    # A foldable expression: the optimizer turns it into one literal map.
    expansions = F.from_json(F.lit(json.dumps(longer)), "map<string,string>")
    spelled = F.array_join(
        F.transform(
            F.regexp_extract_all(name, F.lit("(?s)(.)"), 1),
            lambda c: F.coalesce(F.try_element_at(expansions, c), c),
        ),
        "",
    )
    text = F.when(name.rlike(several), spelled).otherwise(name)
    folded = F.regexp_replace(F.translate(text, single, target), r"[^\x00-\x7f]", "")
    return F.when(name.rlike(r"[^\x00-\x7f]"), folded).otherwise(name)


def normalize_name(name: Column) -> Column:
    """Lower-case alphanumeric tokens without suffix, initials merged, first name expanded.

    A chain of replacements in which every step reads its input once.
    """
    text = F.trim(F.regexp_replace(F.lower(ascii_fold(name)), "[^a-z0-9]+", " "))
    text = F.regexp_replace(text, f"(^| )({'|'.join(SUFFIXES)})$", "")
    # Two leading one-character tokens merge while a further token follows.
    text = F.regexp_replace(text, "^([a-z0-9]) ([a-z0-9]) ", "$1$2 ")
    for short, full in FIRST_NAMES.items():
        text = F.regexp_replace(text, f"^{short}(?= |$)", full)
    return text


def book_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), " ", "-")


def redact_secrets(message: Column, secret: str | None = None) -> Column:
    """Mask key material in an error text and keep the first 1,000 characters."""
    if secret:
        message = F.replace(message, F.lit(secret), F.lit("[REDACTED]"))
    masked = F.regexp_replace(message, r"(?i)(api[_-]?key=)[^&\s]+", "$1[REDACTED]")
    return F.substring(masked, 1, 1000)
