"""Symbols, imports, calls, routes, client calls, bases and decorators found in source files (path, content, language).

Python is parsed; other languages are read from their tokens, with the lines where declarations begin and end. A file is
read once for all kinds. Rows come from batches of files.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions import patterns as P
from codeweft.sources.scan import Source

FUNCTION, CLASS = "Function", "Class"
#: Words that declare what follows, by language.
_C, _F = CLASS, FUNCTION
_WORDS = {
    "rust": {"fn": _F, "struct": _C, "enum": _C, "trait": _C, "impl": _C},
    "go": {"func": _F, "type": _F},
    "java": {"class": _C, "interface": _C},
    "csharp": {"class": _C},
    "c": {"struct": _C},
    "cpp": {"class": _C},
    "php": {"function": _F, "class": _C},
    "ruby": {"def": _F, "class": _C, "module": _C},
    "kotlin": {"fun": _F, "class": _C, "interface": _C, "object": _C},
    "swift": {"func": _F, "class": _C, "struct": _C, "enum": _C, "protocol": _C},
    "shell": {"function": _F},
    **dict.fromkeys(("javascript", "jsx", "typescript", "tsx"), {"function": _F, "class": _C}),
}
_GENERIC = {"fn": _F, "def": _F, "func": _F}
_JS = ("javascript", "jsx", "typescript", "tsx")
#: Languages in which a name, its parameters and a block make a method without a word before them.
_BARE = {"java", "csharp", "c", "cpp", *_JS}
_STATEMENTS = frozenset("if for while switch catch return new throw else do synchronized using lock foreach await yield case function super this sizeof".split())
_VERBS = frozenset("get post put delete patch".split())
_GO_ROUTES = frozenset("HandleFunc GET POST PUT DELETE PATCH".split())
_MAPPINGS = frozenset(f"{v}Mapping" for v in ("Get", "Post", "Put", "Delete", "Patch", "Request"))
_ENDED = frozenset("class module def begin case".split())
_CONDITIONS = frozenset("if unless while until for".split())

SYMBOL_SCHEMA = "qualified_name string, name string, label string, file_path string, line_start long, line_end long, signature string"
FOUND_SCHEMA = "kind string, file_path string, name string, label string, line long, line_end long, detail string"


@dataclass
class Found:
    """What a file holds: rows (name, label, line, line_end, detail) by kind."""

    symbols: list[tuple] = field(default_factory=list)
    imports: list[tuple] = field(default_factory=list)
    calls: list[tuple] = field(default_factory=list)
    routes: list[tuple] = field(default_factory=list)
    clients: list[tuple] = field(default_factory=list)
    bases: list[tuple] = field(default_factory=list)
    decorators: list[tuple] = field(default_factory=list)

    def add(self, kind: str, name: str, label: str | None, line: int, end: int | None = None, detail: str | None = None) -> None:
        getattr(self, kind).append((name, label, line, end if end is not None else line, detail))


# --- declarations ------------------------------------------------------------------------------------------------------


def _ruby_ends(s: Source) -> dict[int, int]:
    """The line of the `end` that closes each block, by the place of the word that opens it."""
    found, open_at = {}, []
    for at in range(s.size):
        if not s.named(at) or s.is_(at - 1, ".", ":"):
            continue
        word = s.values[at]
        if word in _ENDED or (word in _CONDITIONS and (s.first[at] or s.is_(at - 1, "="))):
            open_at.append(at)
        elif word == "do" and not any(s.is_(x, "while", "until", "for") and s.lines[x] == s.lines[at] for x in range(max(0, at - 12), at)):
            open_at.append(at)
        elif word == "end" and open_at:
            found[open_at.pop()] = s.lines[at]
    return found


class _Ends:
    """Where declarations end: with their block, their semicolon or their line. Found from the last token to the first, so that
    each is looked at once however many declarations there are."""

    def __init__(self, s: Source) -> None:
        self.s, by_line = s, s.language in ("kotlin", "swift", "go", "shell", *_JS)
        self.after = [s.last_lines[-1] if s.size else 1] * (s.size + 2)
        for at in range(s.size - 1, -1, -1):
            line = self._at(at)
            if line is None and by_line and s.first[at] and not s.is_(at, "=", ":", "where", ".") and not s.is_(at - 1, ",", "=", ":", "->", "=>", "("):
                line = s.last_lines[at - 1]
            self.after[at] = line if line is not None else self.after[self._next(at)]

    def _at(self, at: int) -> int | None:
        s = self.s
        if s.is_(at, "{"):
            return s.lines[s.partner.get(at, s.size - 1)]
        return s.lines[at] if s.is_(at, ";") else s.last_lines[at - 1] if s.is_(at, "}") else None

    def _next(self, at: int) -> int:
        return self.s.partner[at] + 1 if self.s.is_(at, "(", "[") and at in self.s.partner else at + 1

    def line(self, at: int) -> int:
        """The last line of a declaration whose head goes on at `at`."""
        if at >= self.s.size:
            return self.after[self.s.size]
        line = self._at(at)
        return line if line is not None else self.after[self._next(at)]


def _heads(s: Source, joined: tuple[str, ...] = ()) -> list[int]:
    """The first token of the run of words (and of the marks given) on a line that each token ends."""
    out: list[int] = []
    for k in range(s.size):
        more = k and not s.first[k] and (s.named(k - 1) and (bool(joined) or s.values[k - 1] not in _STATEMENTS) or s.is_(k - 1, *joined))
        out.append(out[-1] if more else k)
    return out


def _declared_name(s: Source, k: int) -> int:
    """The place of the name that the word at k declares, -1 if it declares none."""
    word, at = s.values[k], k + 1
    if s.language == "go" and word == "func":
        at = s.past(at, "(", ")")
    elif word in ("impl", "fun"):
        at = s.past(at, "<", ">")
    elif word == "function" and s.is_(at, "*", "&"):
        at += 1
    if word == "impl":  # impl Type, impl Trait for Type
        for x in range(at, min(s.size, at + 60)):
            if s.is_(x, "for"):
                at = x + 1
            if s.is_(x, "{", "where"):
                break
        while s.is_(at + 1, "::"):
            at += 2
        return at if s.named(at) and not s.is_(at + 1, "<") else -1
    if s.language == "ruby" and s.is_(at, "self") and s.is_(at + 1, "."):
        at += 2
    if s.language == "kotlin" and word == "fun":  # extension functions name their receiver first
        while s.named(at) and s.is_(at + 1, ".") and s.named(at + 2):
            at += 2
    if s.language == "go" and word == "type" and not s.named(at):
        return -1
    if word in ("struct", "enum") and s.language == "c" and not s.is_(at + 1, "{"):
        return -1  # a use, not a definition
    return at if s.named(at) else -1


def _bare_method(s: Source, k: int) -> int:
    """The place after the parameters if the name at k begins a method or function without a word before it, else 0."""
    if not s.is_(k + 1, "(") or k + 1 not in s.partner or s.values[k] in _STATEMENTS:
        return 0
    after = params = s.partner[k + 1] + 1
    before_ok = s.named(k - 1) and s.values[k - 1] not in _STATEMENTS or s.is_(k - 1, ">", "]", "*", "&")
    if s.language in _JS:
        holder = s.inside[k]
        in_class = holder >= 0 and s.is_(holder, "{") and _opens_class(s, holder)
        if s.is_(after, ":"):  # a type after the parameters
            after = s.next_breaks[params + 1]
        return after if in_class and s.is_(after, "{") and not s.is_(k - 1, ".", "=", "(") else 0
    if not before_ok:
        return 0
    at = after
    while s.named(at) or s.is_(at, ",", ".", ":", "::"):  # throws A, B; const; override; where T : X
        at += 1
    if s.is_(at, "{") or (s.language == "csharp" and s.is_(at, "=>")):
        return after
    holder = s.inside[k]
    abstract = s.language in ("java", "csharp") and s.is_(at, ";") and holder >= 0 and _opens_class(s, holder)
    return after if abstract else 0


def _opens_class(s: Source, brace: int) -> bool:
    for x in range(brace - 1, max(-1, brace - 80), -1):
        if s.is_(x, "{", "}", ";", ")"):
            return False
        if s.is_(x, "class", "interface", "enum", "record", "struct"):
            return True
    return False


def _symbols(s: Source, found: Found) -> set[int]:
    """Add the symbols; returns the places of their names."""
    words, names = _WORDS.get(s.language, _GENERIC), set()
    ends, heads, bare_heads = _Ends(s), _heads(s), _heads(s, ("<", ">", "[", "]", ",", "*", "&", "?", ".")) if s.language in _BARE else []
    ruby_ends = _ruby_ends(s) if s.language == "ruby" else {}
    for k in range(s.size):
        if not s.named(k) or k in names:
            continue
        word = s.values[k]
        if word in words and not s.is_(k - 1, ".", "::") and not (s.language == "kotlin" and word == "class" and s.is_(k - 1, "::")):
            if s.language not in _WORDS and not s.first[k]:
                continue
            at = _declared_name(s, k)
            if at < 0 or at in names:
                continue
            names.add(at)
            line = s.lines[heads[k]]  # pub, export, async, static, ... stand before
            end = ruby_ends.get(k, s.lines[-1]) if s.language == "ruby" else ends.line(at + 1)
            found.add("symbols", s.values[at], words[word], line, end, s.signature(line, end))
        elif s.language in _BARE and (after := _bare_method(s, k)):
            names.add(k)
            line, end = s.lines[bare_heads[k]], ends.line(after)
            found.add("symbols", word, FUNCTION, line, end, s.signature(line, end))
        elif s.language == "shell" and s.first[k] and s.is_(k + 1, "(") and s.is_(k + 2, ")") and s.is_(k + 3, "{"):
            names.add(k)
            line, end = s.lines[k], s.lines[s.partner.get(k + 3, s.size - 1)]
            found.add("symbols", word, FUNCTION, line, end, s.signature(line, end))
    return names


# --- imports, calls, routes, bases -------------------------------------------------------------------------------------


def _imports(s: Source, found: Found) -> None:
    lang, put = s.language, lambda name, kind, k: found.add("imports", name, kind, s.lines[k])
    for k in range(s.size):
        if s.kinds[k] == "p" and lang in ("c", "cpp") and s.is_(k, "#") and s.first[k] and s.is_(k + 1, "include"):
            row = s.rows[s.lines[k] - 1]
            for left, right in (("<", ">"), ('"', '"')):
                a = row.find(left)
                b = row.find(right, a + 1)
                if 0 <= a < b:
                    put(row[a + 1 : b], "include", k)
                    break
        if not s.named(k):
            continue
        word, first = s.values[k], s.first[k]
        if lang == "rust" and first and word in ("use", "mod") or (lang == "rust" and s.is_(k - 1, "pub") and word in ("use", "mod")):
            name, after = s.dotted(k + 1, "::")
            if name and (word == "use" or s.is_(after, ";")):
                put(name + ("::" if word == "use" and s.is_(after, "::") else ""), word, k)
        elif lang in _JS and word in ("import", "export") and not s.is_(k - 1, "."):
            if s.is_(k + 1, "(") and s.string(k + 2):
                put(s.values[k + 2], "dynamic", k)
            else:
                for x in range(k + 1, min(s.size, k + 400)):
                    if s.is_(x, "from") and s.string(x + 1):
                        put(s.values[x + 1], "esm" if word == "import" else "reexport", k)
                        break
                    if s.string(x) or s.is_(x, ";", "=", "(") or (s.first[x] and s.is_(x, "import", "export", "const", "function", "class")):
                        break
        elif lang in _JS and word == "require" and s.is_(k + 1, "(") and s.string(k + 2):
            put(s.values[k + 2], "cjs", k)
        elif lang == "go" and word == "import" and first:
            if s.is_(k + 1, "(") and k + 1 in s.partner and s.inside[k] < 0:
                for x in range(k + 2, s.partner[k + 1]):
                    if s.string(x):
                        put(s.values[x], "import_block", x)
            else:
                x = k + 1 if s.string(k + 1) else k + 2
                if s.string(x):
                    put(s.values[x], "import", k)
        elif lang in ("java", "kotlin") and first and (word == "import" or (lang == "kotlin" and word == "package")):
            name, after = s.dotted(k + 1, ".")
            if name and not (lang == "java" and not s.is_(after, ";")):
                put(name, word, k)
        elif lang == "swift" and first and word == "import":
            at = k + 2 if s.is_(k + 1, "class", "struct", "func", "protocol", "enum") and s.named(k + 2) else k + 1
            if s.named(at):
                put(s.values[at], "import", k)
        elif lang == "csharp" and first and word == "using":
            name, after = s.dotted(k + 1, ".")
            if name and s.is_(after, ";"):
                put(name, "using", k)
        elif lang == "ruby" and first and word in ("require", "require_relative"):
            at = k + 2 if s.is_(k + 1, "(") else k + 1
            if s.string(at):
                put(s.values[at], word, k)
        elif lang == "php" and first and word == "use":
            name, after = s.dotted(k + 1, "\\")
            if name and s.is_(after, ";"):
                put(name, "use", k)
        elif lang == "php" and word.removesuffix("_once") in ("require", "include"):
            at = k + 2 if s.is_(k + 1, "(") else k + 1
            if s.string(at):
                put(s.values[at], word.removesuffix("_once"), k)


def _calls(s: Source, found: Found, names: set[int]) -> None:
    for k in range(s.size):
        if s.named(k) and s.is_(k + 1, "(") and k not in names and s.values[k] not in P.NOISE_CALLEES and not s.is_(k - 1, "new", "@", "def", "fun", "func", "function", "fn"):
            found.add("calls", s.values[k], None, s.lines[k])


def _first_string(s: Source, paren: int) -> int:
    """The place of the string that is the first argument after the parenthesis, `value =` before it allowed; -1 if there is none."""
    at = paren + 3 if s.is_(paren + 1, "value") and s.is_(paren + 2, "=") else paren + 1
    return at if s.is_(paren, "(") and s.string(at) and s.values[at] else -1


def _web(s: Source, found: Found) -> None:
    """Routes that frameworks serve, and calls of HTTP clients: a few fixed shapes of tokens before a string."""
    lang = s.language
    for k in range(s.size):
        if not s.named(k):
            continue
        word, at = s.values[k], _first_string(s, k + 1)
        owner = s.values[k - 2] if s.is_(k - 1, ".", "::") and s.named(k - 2) else ""
        dotted = s.is_(k - 1, ".")
        route = client = None
        if lang == "python":
            decorator = s.is_(k - 3, "@") and s.first[k - 3] and dotted and owner in ("app", "router", "bp", "api")
            if decorator and (word in _VERBS or word == "route"):
                route = "decorator"
            elif word in _VERBS and s.is_(k - 1, "@") and s.first[k - 1]:
                route = "fastapi"
            elif dotted and word in _VERBS and owner in ("requests", "httpx", "client", "session"):
                client = owner if owner in ("requests", "httpx") else "client"
            elif word == "urlopen":
                client = "urlopen"
        elif lang in _JS:
            if dotted and word in _VERBS:
                route = "express"
                client = owner if owner in ("axios",) else "http" if owner in ("http", "https") else None
            elif word == "fetch" and not dotted:
                client = "fetch"
            elif word == "axios" and s.is_(k + 1, "(") and s.is_(k + 2, "{") and s.is_(k + 3, "url") and s.is_(k + 4, ":") and s.string(k + 5):
                client, at = "axios", k + 5
        elif lang == "rust":
            if dotted and word == "route":
                route = "axum"
            elif dotted and word in _VERBS:
                route, client = "axum_method", "client"
            elif word in _VERBS and s.is_(k - 1, "::") and owner == "reqwest":
                client = "reqwest"
        elif lang == "go":
            if dotted and word in _GO_ROUTES:
                route = "go_http"
            elif dotted and owner == "http" and word in ("Get", "Post", "Put", "Delete"):
                client = "http"
            elif word == "NewRequest" and at >= 0 and s.is_(at + 1, ",") and s.string(at + 2):
                client, at = "request", at + 2
        elif lang in ("java", "kotlin"):
            if word in _MAPPINGS and s.is_(k - 1, "@"):
                route = "spring"
            elif dotted and word in _VERBS:
                client = "client"
            elif dotted and owner == "Uri" and word in ("parse", "of"):
                client = "uri"
        if at < 0 or not s.values[at]:
            continue
        if route:
            start = s.line_starts[k] if s.language in ("python", "java", "kotlin") else k
            found.add("routes", s.values[at], route, s.lines[start])
        if client:
            found.add("clients", s.values[at], client, s.lines[k])


def _bases(s: Source, found: Found) -> None:
    lang = s.language

    def types(at: int, stop: tuple[str, ...]) -> tuple[list[str], int]:
        """Names of the types listed from `at` on, without what stands in brackets, and where the list ends."""
        out, mark = [], True
        while at < s.size and not s.is_(at, "{", ";", *stop):
            if s.is_(at, "<", "("):
                past = s.past(at, *("<>" if s.is_(at, "<") else "()"))
                at = past if past > at else at + 1
                continue
            if s.is_(at, ","):
                mark = True
            elif s.named(at) and s.values[at] not in ("public", "private", "protected", "virtual", "by", "where"):
                if mark:
                    out.append(s.values[at])
                elif s.is_(at - 1, ".", "::", "\\") and out:
                    out[-1] = s.values[at]
                mark = False
            if s.first[at] and lang in ("ruby", "swift", "kotlin") and not s.is_(at - 1, ",", ":", "<"):
                break
            if s.is_(at, "impl") if lang == "rust" else s.is_(at, "class", "interface", "struct", "object") and s.named(at + 1):
                break  # the next declaration
            at += 1
        return out, at

    for k in range(s.size):
        if lang == "rust" and s.is_(k, "impl") and not s.is_(k - 1, "->", ":", "(", ","):
            at = s.past(k + 1, "<", ">")
            trait, at = types(at, ("for", "where"))
            kind, _ = types(at + 1, ("where",)) if s.is_(at, "for") else ([], at)
            if trait and kind:
                found.add("bases", kind[0], "IMPLEMENTS", s.lines[k], None, trait[0])
        if not s.is_(k, "class", "interface", "struct", "object") or not s.named(k + 1) or lang in ("rust", "go", "c", "shell"):
            continue
        name, at = s.values[k + 1], s.past(k + 2, "<", ">")
        put = lambda names, kind: [found.add("bases", name, kind, s.lines[k], None, b) for b in names if b != name]  # noqa: B023, E731
        if lang == "ruby":
            if s.is_(at, "<"):
                base, _ = s.dotted(at + 1, "::")
                put([base] if base else [], "INHERITS")
        elif lang in ("kotlin", "csharp", "swift", "cpp"):
            at = s.past(at, "(", ")") if lang == "kotlin" else at
            if s.is_(at, ":"):
                put(types(at + 1, ())[0], "INHERITS")
        elif lang in ("java", "php", *_JS):
            while s.is_(at, "extends", "implements"):
                names, after = types(at + 1, ("extends", "implements"))
                put(names, "INHERITS" if s.is_(at, "extends") else "IMPLEMENTS")
                at = after


def _decorators(s: Source, found: Found) -> None:
    for k in range(s.size):
        if s.is_(k, "@") and s.first[k] and s.named(k + 1):
            found.add("decorators", s.dotted(k + 1, ".")[0], None, s.lines[k])


def _python(s: Source, tree: ast.Module, found: Found) -> None:
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            found.add("symbols", node.name, CLASS if isinstance(node, ast.ClassDef) else FUNCTION, node.lineno, node.end_lineno, s.signature(node.lineno, node.end_lineno))
        if isinstance(node, ast.ClassDef):
            for b in node.bases:
                if isinstance(b, (ast.Name, ast.Attribute)):
                    found.add("bases", node.name, "INHERITS", node.lineno, None, b.id if isinstance(b, ast.Name) else b.attr)
        elif isinstance(node, ast.Call):
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else ""
            if name and name not in P.NOISE_CALLEES:
                found.add("calls", name, None, node.lineno)
        elif isinstance(node, ast.Import):
            for alias in node.names:
                found.add("imports", alias.name, "import", node.lineno)
        elif isinstance(node, ast.ImportFrom):
            found.add("imports", "." * node.level + (node.module or ""), "from_rel" if node.level else "from", node.lineno)


def _broken_python(s: Source, found: Found) -> set[int]:
    """Declarations and imports of a file that does not parse: a block ends before the next line that is indented no deeper."""
    names: set[int] = set()
    depth = [len(r) - len(r.lstrip()) if r.strip() else None for r in s.rows]
    for k in range(s.size):
        if s.is_(k, "def", "class") and s.named(k + 1) and (s.first[k] or s.is_(k - 1, "async")):
            line = s.lines[k]
            end = line
            while end < len(depth) and (depth[end] is None or depth[end] > (depth[line - 1] or 0)):
                end += 1
            while end > line and depth[end - 1] is None:
                end -= 1
            names.add(k + 1)
            found.add("symbols", s.values[k + 1], CLASS if s.is_(k, "class") else FUNCTION, line, end, s.signature(line, end))
        elif s.is_(k, "from", "import") and s.first[k]:
            at = k + 1
            while s.is_(at, "."):
                at += 1
            name, _ = s.dotted(at, ".")
            level = "." * (at - k - 1)
            if level + name:
                found.add("imports", level + name, "import" if s.is_(k, "import") else "from_rel" if level else "from", s.lines[k])
    return names


def read(text: str, language: str) -> Found:
    """Everything found in one file, in the order of its lines within each kind (parsed Python: breadth first)."""
    s, found = Source(text, language), Found()
    if language == "python":
        try:
            _python(s, ast.parse(text), found)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            found = Found()
            _calls(s, found, _broken_python(s, found))
    else:
        names = _symbols(s, found)
        _imports(s, found)
        _calls(s, found, names)
        _bases(s, found)
    _web(s, found)
    _decorators(s, found)
    return found


# --- tables ------------------------------------------------------------------------------------------------------------

KINDS = ("symbols", "imports", "calls", "routes", "clients", "bases", "decorators")


def findings(files: DataFrame) -> DataFrame:
    """Rows (kind, file_path, name, label, line, line_end, detail) of all kinds, each file read once.

    Null texts are empty, unknown or null languages are read by words that many share; repeated files give repeated rows.
    """
    names = [c.split()[0] for c in FOUND_SCHEMA.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, text, language in part.itertuples(index=False):
                found = read(text or "", language or "")
                rows += [(kind, path, *row) for kind in KINDS for row in getattr(found, kind)]
            yield pd.DataFrame(rows, columns=names).astype({"line": "int64", "line_end": "int64"})

    return files.select("path", "content", "language").mapInPandas(run, FOUND_SCHEMA)


def of_kind(found: DataFrame, kind: str) -> DataFrame:
    """The findings of one kind under their own column names."""
    rows, c = found.where(F.col("kind") == kind), F.col
    if kind == "symbols":
        key = F.concat("file_path", F.lit("::"), "label", F.lit("::"), "name", F.lit("@L"), "line")
        return rows.select(key.alias("qualified_name"), "name", "label", "file_path", c("line").alias("line_start"), "line_end", c("detail").alias("signature"))
    if kind == "imports":  # the first kind of each specifier
        first = rows.groupBy("file_path", "name").agg(F.min_by("label", F.struct("line", "label")).alias("kind"))
        return first.select("file_path", c("name").alias("specifier"), "kind")
    if kind == "calls":
        return rows.select("file_path", c("name").alias("callee"), "line")
    if kind == "routes":
        return rows.select("file_path", c("name").alias("route"), c("label").alias("framework"), "line")
    if kind == "clients":
        return rows.select("file_path", c("name").alias("url"), c("label").alias("client"), "line")
    if kind == "bases":
        return rows.select("file_path", "name", c("detail").alias("base"), c("label").alias("edge_type"))
    return rows.select("file_path", c("name").alias("decorator"), "line")


def extract(files: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind from all files. For several kinds cut findings() once and take each with of_kind()."""
    return of_kind(findings(files), kind)
