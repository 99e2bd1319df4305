r"""Spelling of the shared pattern texts for Java regex (Spark) and RE2 (DuckDB).

The fixed patterns are written once, in ECMAScript notation, because their meaning is
defined there: ``\b`` is an ASCII word edge, ``\s`` includes the Unicode spaces, ``.``
stops at four line terminators, and ``^``/``$`` mean the ends of the text. Java and RE2
each differ from that in some point, so both get an explicit spelling.
"""

import re
from collections.abc import Callable

from .fixed import (
    API_CONNECTION_PATTERNS,
    API_PATTERNS,
    DB_CONNECTION_PATTERNS,
    DEPENDENCY_PATTERNS,
    DIAGRAM_BLOCK,
    FUNCTION_PATTERNS,
    HTML_TABLE,
    MARKDOWN_BLOCK,
)

SPACES = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# Fixed value: the characters that count as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
ANY_IN_LINE = r"[^\n\r\x{2028}\x{2029}]"
LONG_RUN = r"[a-zA-Z0-9]{32,}"
ANYTHING = r"(?s:.)"

# Same matches, found by Java with less backtracking: a name is entered at its first letter
# only and never given back; an optional prefix outside the wanted group is left out; a
# long run of letters, only ever asked for as a yes or no, is tried from its start.
LESS_BACKTRACKING = {
    FUNCTION_PATTERNS[2]: r"(?i)(?:function|def|func|fn|method|sub)\s++([a-zA-Z_][a-zA-Z0-9_]*+)\s*+\(",
    FUNCTION_PATTERNS[3]: r"(?<![a-zA-Z_])([a-zA-Z_][a-zA-Z0-9_]*+)\s*+\([^)]*+\)\s*+\{",
    DEPENDENCY_PATTERNS[2][0]: r"(?i)(?=[fi])(?:from\s+([^\s]+)\s+import|import\s+([^\s]+))",
    DEPENDENCY_PATTERNS[6][0]: r"(?i)(?=r)(?:require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)|require\s+['\"]([^'\"]+)['\"])",
    DEPENDENCY_PATTERNS[7][0]: r"(?i)(?=i)(?:import\s*\(\s*[\s\S]*?\"([^\"]+)\"[\s\S]*?\s*\)|import\s+\"([^\"]+)\")",
    LONG_RUN: r"(?<![a-zA-Z0-9])[a-zA-Z0-9]{32,}",
    API_PATTERNS[2]: r"(?i)(?:https?:\/\/[^\/\s]+|(?:(?<![a-zA-Z_])|\G)[a-zA-Z_][a-zA-Z0-9_]*+\.(?:com|org|net|io|dev|api))",
}

# A text without this character (or word) cannot match the pattern and need not be searched.
NEEDS = {
    FUNCTION_PATTERNS[0]: "(",
    FUNCTION_PATTERNS[1]: "(",
    FUNCTION_PATTERNS[2]: "(",
    FUNCTION_PATTERNS[3]: "{",
    DEPENDENCY_PATTERNS[1][0]: "(",
    DEPENDENCY_PATTERNS[3][0]: "(",
    DEPENDENCY_PATTERNS[4][0]: "#",
    DEPENDENCY_PATTERNS[7][0]: '"',
    DB_CONNECTION_PATTERNS[0][0]: "=",
    DB_CONNECTION_PATTERNS[1][0]: "=",
    DB_CONNECTION_PATTERNS[2][0]: "://",
    API_CONNECTION_PATTERNS[0][0]: "://",
    DIAGRAM_BLOCK: "```mermaid",
    MARKDOWN_BLOCK: "```markdown",
    HTML_TABLE: "<",
}

# The same for patterns with a part that is quickly searched for alone.
NEEDS_MATCH = {
    FUNCTION_PATTERNS[3]: r"\)\s*\{",
    API_PATTERNS[2]: r"(?i)\.(?:com|org|net|io|dev|api)|:\/\/",
}

_JAVA_EDGES = (r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])")
_RE2_EDGES = (r"\b", r"\b")


def _spell(pattern: str, edges: tuple[str, str]) -> str:
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        if not in_class and pattern.startswith(r"[\s\S]", i):
            out.append(ANYTHING)
            i += 6
            continue
        ch = pattern[i]
        if ch == "\\":
            pair = pattern[i : i + 2]
            i += 2
            if pair == r"\s":
                out.append(SPACES if in_class else f"[{SPACES}]")
            elif pair == r"\S":
                out.append(f"[^{SPACES}]")
            elif pair == r"\b":
                # an edge in front of a word character opens a word, any other closes one
                follows = pattern[i : i + 1]
                opens = follows.isalnum() or follows in ("_", "(", "[") or pattern[i : i + 2] == r"\d"
                out.append(edges[0] if opens else edges[1])
            else:
                out.append(pair)
            continue
        if in_class:
            if ch == "]":
                in_class = False
            out.append(r"\[" if ch == "[" else ch)
        elif ch == "[":
            in_class = True
            out.append(ch)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
        elif ch == ".":
            out.append(ANY_IN_LINE)
        elif ch == "^":
            out.append(r"\A")
        elif ch == "$":
            out.append(r"\z")
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def _first_letters(pattern: str) -> str:
    """Let a word, or a group of words, be tried only where one of its first letters stands."""

    def guarded(group: re.Match) -> str:
        letters = "".join(dict.fromkeys(word[0] for word in group["words"].split("|")))
        return f"(?=[{letters}]){group['edge']}(?:{group['words']})"

    pattern = re.sub(r"\\b(?!NAME)([A-Za-z_])", r"(?=\1)\\b\1", pattern)
    return re.sub(r"(?P<edge>\\b|)\(\?:(?P<words>\w+(?:\|\w+)+)\)(?![?*])", guarded, pattern)


def java(pattern: str) -> str:
    """Spelling for Spark's ``rlike`` and ``regexp_*`` functions."""
    return _spell(_first_letters(LESS_BACKTRACKING.get(pattern, pattern)), _JAVA_EDGES)


def re2(pattern: str) -> str:
    """Spelling for DuckDB's ``regexp_*`` functions."""
    return _spell(pattern, _RE2_EDGES)


def any_of(patterns: list[str], spell: Callable[[str], str]) -> str:
    """One alternation of several patterns, each keeping its own case flag."""
    spelled = [spell(p) for p in patterns]
    return "|".join(f"(?i:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})" for p in spelled)
