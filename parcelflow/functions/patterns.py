"""Regex building blocks.

The jobs follow Python ``str`` regex semantics.  Java's shorthands differ (``\\s`` is ASCII, ``\\b``
and ``\\w`` depend on flags and JDK), so the classes are spelled out here once.  Printable ASCII is
tested first in each, which decides most characters without a walk through all ranges.
"""

import re

# What Python calls whitespace, as the inside of a character class and as plain characters.
WS = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS_CHARS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

S = f"[[^!-~]&&[{WS}]]"
NOT_S = f"[!-~[^{WS}]]"
W = r"[a-zA-Z0-9_\p{L}\p{N}]"
NOT_W = r"[^a-zA-Z0-9_\p{L}\p{N}]"
D = r"\p{Nd}"


def run_but_one_space(kind: str) -> str:
    """A run of ``kind`` (which takes the space) that is not just one space."""
    return f"{kind}(?:(?<! )|(?={kind})){kind}*+"


# Word boundaries: before a word character, after one, and the general form.
WORD_START = f"(?<!{W})"
WORD_END = f"(?!{W})"
BOUNDARY = f"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"

# Python's "$" without MULTILINE.
END = r"(?=\n?\z)"

# Python's str.splitlines separators.
LINE_BREAK = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\x{2028}\x{2029}]"


def word(alternatives: str, ignore_case: bool = True) -> str:
    """Pattern for ``\\b(alternatives)\\b`` where every alternative starts and ends with a word char."""
    flags = "(?iu)" if ignore_case else ""
    return f"{flags}{WORD_START}(?:{alternatives}){WORD_END}"


def starts_with_any(words: list[str]) -> str:
    """Lookahead for the first letters of ``words`` in any case; empty where that is not plain.

    It spares most positions a try of every word.  K, S and I have further forms in other scripts.
    """
    first = {w[0].lower() for w in words if w}
    if not all(len(c) == 1 and "a" <= c <= "z" and c not in "ksi" for c in first):
        return ""
    return f"(?=[{''.join(sorted(first | {c.upper() for c in first}))}])"


def quote(text: str) -> str:
    """Literal text as a pattern."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def quote_replacement(text: str) -> str:
    """Literal text as a Java replacement string."""
    return text.replace("\\", "\\\\").replace("$", "\\$")
