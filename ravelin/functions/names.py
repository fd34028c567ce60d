"""Names of columns as words, and numbers and labels for people."""

from __future__ import annotations

import re

_PART = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")


def name_tokens(name: str) -> list[str]:
    """Words of a column name in lower case: camel case, snake case and other separators."""
    return [p.lower() for p in _PART.findall(str(name))]


def stem(word: str) -> str:
    """A word without the ending of a plural or participle."""
    for ending, rest in (("ies", "y"), ("ing", ""), ("ed", ""), ("es", ""), ("s", "")):
        if word.endswith(ending) and len(word) - len(ending) >= 3:
            return word[: len(word) - len(ending)] + rest
    return word


def same_word(a: str, b: str) -> bool:
    """Whether two words are forms of one word: equal stems, or one begins with the other (4 letters at least)."""
    a, b = a.lower(), b.lower()
    if a == b or stem(a) == stem(b):
        return True
    short, long = sorted((stem(a), stem(b)), key=len)
    return len(short) >= 4 and long.startswith(short)


def humanize(name: str) -> str:
    """A column name as a label, without the letter that stands for its table."""
    words = name_tokens(name) or [str(name)]
    words = words[1:] if len(words) > 1 and len(words[0]) == 1 else words
    return " ".join([words[0].capitalize(), *words[1:]])


def format_number(value) -> str:
    """A number for a sentence: thousands separated, at most two decimals, no trailing zeros."""
    if value is None:
        return "no value"
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    if value != value:
        return "no value"
    if float(value).is_integer():
        return f"{int(value):,}"
    text = f"{value:,.2f}" if abs(value) >= 0.01 else f"{value:.4g}"
    return text.rstrip("0").rstrip(".") if "." in text and "e" not in text else text
