"""Source text as tokens: comments are left out, strings are one token, brackets know their partner.

The rules are those that families of languages share: how comments begin, which quotes there are, whether blocks stand in
braces or end in a word. What a file declares, imports and calls is read from the tokens in codeweft.sources.extract.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cache, cached_property

NAME, STRING, MARK = "n", "s", "p"
#: How comments begin and which quotes make strings. A string in single or double quotes ends with its line at the latest.
_HASH = frozenset("python ruby shell powershell yaml toml php".split())
_SLASHES = frozenset("rust go java javascript typescript jsx tsx c cpp csharp php kotlin swift zig css".split())
_DASHES = frozenset("sql lua".split())
_BACKTICKS = frozenset("javascript typescript jsx tsx go".split())
_TRIPLES = frozenset("python kotlin swift".split())


@cache
def _lexer(language: str) -> re.Pattern:
    parts = []
    if language in _SLASHES or language not in _HASH | _DASHES:
        parts += [r"//[^\n]*", r"/\*[\s\S]*?(?:\*/|\Z)"]
    if language in _HASH:
        parts.append(r"\#(?!\[)[^\n]*" if language == "php" else r"\#[^\n]*")
    if language in _DASHES:
        parts.append(r"--[^\n]*")
    strings = []
    if language in _TRIPLES:
        strings += [r'"""[\s\S]*?(?:"""|\Z)'] + ([r"'''[\s\S]*?(?:'''|\Z)"] if language == "python" else [])
    strings.append(r'"(?:\\[\s\S]|[^"\\\n])*"?')
    # In Rust a lone quote before a name is a lifetime.
    strings.append(r"'(?:\\[^\n]+?|[^'\\\n])'" if language == "rust" else r"'(?:\\[\s\S]|[^'\\\n])*'?")
    if language in _BACKTICKS:
        strings.append(r"`(?:\\[\s\S]|[^`\\])*`?")
    return re.compile(f"(?P<skip>{'|'.join(parts)})|(?P<string>{'|'.join(strings)})|(?P<name>[^\\W\\d]\\w*)|(?P<number>\\d\\w*)|(?P<mark>::|->|=>|[^\\s\\w])")


class Source:
    """The tokens of a file: kinds, values, lines (from 1), whether one is the first in its line, and the partners of brackets."""

    def __init__(self, text: str, language: str) -> None:
        self.text, self.language = text, language
        self.rows = text.split("\n")
        starts = [0]
        for row in self.rows[:-1]:
            starts.append(starts[-1] + len(row) + 1)
        self.kinds: list[str] = []
        self.values: list[str] = []
        self.lines: list[int] = []
        self.last_lines: list[int] = []
        self.spans: list[tuple[int, int]] = []
        for m in _lexer(language).finditer(text):
            kind, value = m.lastgroup, m.group()
            if kind == "skip":
                continue
            if kind == "string":
                quote = 3 if value[:3] in ('"""', "'''") else 1
                value = value[quote:-quote] if len(value) >= 2 * quote and value.endswith(value[:quote]) else value[quote:]
            self.kinds.append({"string": STRING, "name": NAME}.get(kind, MARK))
            self.values.append(value)
            self.spans.append(m.span())
            self.lines.append(bisect_right(starts, m.start()))
            self.last_lines.append(bisect_right(starts, m.end() - 1))
        self.size = len(self.kinds)
        self.first = [k == 0 or self.last_lines[k - 1] < self.lines[k] for k in range(self.size)]
        self.partner: dict[int, int] = {}
        #: The opening brace or parenthesis that a token stands in, -1 for none.
        self.inside: list[int] = []
        open_at: list[int] = []
        for k in range(self.size):
            value = self.values[k] if self.kinds[k] == MARK else ""
            if value in (")", "]", "}") and value:
                want = {")": "(", "]": "[", "}": "{"}[value]
                if any(self.values[o] == want for o in open_at[-8:]):
                    while self.values[open_at[-1]] != want:
                        open_at.pop()
                    self.partner[open_at[-1]] = k
                    self.partner[k] = open_at.pop()
            self.inside.append(open_at[-1] if open_at else -1)
            if value in ("(", "[", "{") and value:
                open_at.append(k)

    def is_(self, k: int, *values: str) -> bool:
        """Whether token k is one of these marks or names (not a string)."""
        return 0 <= k < self.size and self.kinds[k] != STRING and self.values[k] in values

    def named(self, k: int) -> bool:
        return 0 <= k < self.size and self.kinds[k] == NAME

    def string(self, k: int) -> bool:
        return 0 <= k < self.size and self.kinds[k] == STRING

    @cached_property
    def angles(self) -> dict[int, int]:
        """Which > closes each <, as far as one does."""
        found, open_at = {}, []
        for k in range(self.size):
            if self.is_(k, "<"):
                open_at.append(k)
            elif self.is_(k, ">") and open_at:
                found[open_at.pop()] = k
        return found

    @cached_property
    def line_starts(self) -> list[int]:
        """The last token at or before each one that is the first of its line."""
        out = []
        for k in range(self.size):
            out.append(k if self.first[k] else out[-1])
        return out

    @cached_property
    def next_breaks(self) -> list[int]:
        """The first brace or semicolon at or after each token; the size if there is none."""
        out = [self.size] * (self.size + 2)
        for k in range(self.size - 1, -1, -1):
            out[k] = k if self.is_(k, "{", ";", "}") else out[k + 1]
        return out

    def past(self, k: int, left: str, right: str) -> int:
        """The place after a bracketed run that begins at k, such as <...> of up to 200 tokens; k itself if none does."""
        if not self.is_(k, left):
            return k
        if left == "<":
            return self.angles[k] + 1 if self.angles.get(k, k + 200) < k + 200 else k
        return self.partner[k] + 1 if k in self.partner else k

    def dotted(self, k: int, *marks: str) -> tuple[str, int]:
        """Names joined by the given marks from k on, and the place after them."""
        out, at = "", k
        while self.named(at) or (at > k and self.is_(at, "*")):
            out += self.values[at]
            at += 1
            if not (self.is_(at, *marks) and self.named(at + 1)):
                break
            out += self.values[at]
            at += 1
        return out, at

    def signature(self, start: int, end: int) -> str:
        """The first line; where it neither opens a brace nor is long, joined by the lines after it (five at most) up to one
        that does or that completes the declaration."""
        if not 0 < start <= len(self.rows):
            return ""
        told = self.rows[start - 1]
        if len(told) > 200:
            return told[:200]
        told = told.rstrip("\r")
        if "{" in told:
            return told
        for row in self.rows[start : min(end, start + 5)]:
            told += " " + row[:400].strip()
            if "{" in told or (":" in told and ("->" in told or told.endswith(":"))):
                break
        return told[:300]
