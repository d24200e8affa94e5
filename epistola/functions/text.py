"""Accent- and case-tolerant matching that stays in the JVM."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column, functions as F

#: Letters and digits: what words are made of.
WORD = r"\p{L}\p{N}\p{Co}"


@cache
def fold_map() -> tuple[str, str]:
    """Latin letters with marks and the plain letters they fold to."""
    pairs = {}
    for point in range(0x80, 0x2000):
        c = chr(point)
        base = [x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)]
        if c.isalpha() and c == c.lower() and len(base) == 1 and base[0] != c and "LATIN" in unicodedata.name(c, ""):
            pairs[c] = base[0]
    return "".join(pairs), "".join(pairs.values())


def fold_text(value: str) -> str:
    """The same folding of a query's words."""
    return value.lower().translate(str.maketrans(*fold_map()))


def fold(column: Column) -> Column:
    return F.translate(F.lower(column), *fold_map())


def ascii_lower(column: Column) -> Column:
    """Lower case for A to Z alone, as case-blind comparison of addresses and folders has it."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(value: str) -> list[str]:
    """The folded words of a query value."""
    out, now = [], ""
    for c in fold_text(value):
        if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co":
            now += c
        elif now:
            out.append(now)
            now = ""
    return out + [now] if now else out


def phrase_pattern(tokens: list[str]) -> str:
    """Words one after the other, the last as a prefix, on a folded text."""
    return f"(?<![{WORD}])" + f"[^{WORD}]+".join(map(re.escape, tokens))


def has_phrase(folded: Column, value: str) -> Column:
    """Whether a folded text has the words of the value in a row; no words match nothing."""
    tokens = words(value)
    return F.coalesce(folded.rlike(phrase_pattern(tokens)), F.lit(False)) if tokens else F.lit(False)


def has_part(folded: Column, value: str) -> Column:
    """Whether a folded text contains the value anywhere; fewer than three characters match nothing."""
    return F.coalesce(folded.contains(fold_text(value)), F.lit(False)) if len(value) >= 3 else F.lit(False)


#: What is written for what in another spelling, fixed values. Only the first pair goes both ways: ü is found by u, so it needs no ue.
SPELLINGS = (("ß", "ss"), ("ss", "ß"), ("ae", "ä"), ("oe", "ö"), ("ue", "ü"))


def spellings(value: str, most: int = 8, rounds: int = 3) -> list[str]:
    """The value, then its other spellings in lower case, `most` in all: each round changes one kind of letters in all that are there."""
    found = {value.lower(): value}
    for _ in range(rounds):
        for known in list(found):
            for written, other in SPELLINGS:
                if written in known and len(found) < most:
                    found.setdefault(known.replace(written, other), known.replace(written, other))
    return list(found.values())


def glob_pattern(glob: str, negation: str = "^") -> str:
    """A whole-string regular expression for * ? and [...]; negation is the sign that turns a class round."""
    out, i = "", 0
    while i < len(glob):
        c, end = glob[i], -1
        if c == "[":
            end = glob.find("]", i + 2 + (glob[i + 1 : i + 2] == negation))
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = glob[i + 1 : end]
            turned = inner.startswith(negation)
            inner = inner[turned:].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&").replace("^", r"\^")
            out += f"[{'^' * turned}{inner}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def like_pattern(value: str) -> str:
    """A containing LIKE pattern in which the user's % and _ stay wild; backslashes are plain."""
    return "%" + value.replace("\\", "\\\\") + "%"
