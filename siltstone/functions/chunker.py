"""Chunks of a file: whole declarations where the language is known, else windows of lines.

Python is parsed by its own grammar; languages with braces are read by masking strings and comments and
matching brackets; Ruby by its ``end``. What declarations leave over are runs of top-level lines.
"""

from __future__ import annotations

import ast
import math
import posixpath
import re
from dataclasses import dataclass, field

from siltstone.functions.languages import fallback_language, language_of


@dataclass
class Chunk:
    repo_root: str
    file_path: str
    chunk_index: int
    content: str
    language: str
    start_line: int
    end_line: int
    annotation: str
    signature: str


@dataclass
class Unit:
    """A declaration. start, end: offsets; cuts: offsets where a long one may be cut."""

    kind: str
    signature: str
    parent: str
    start: int
    end: int
    cuts: list[int] = field(default_factory=list)


def count_tokens(text: str) -> int:
    return len(text.split())


def squeeze(text: str) -> str:
    return " ".join(text.split())


def annotation(language: str, path: str, parent: str, signature: str) -> str:
    return f"[{language}] [{path}] [{parent}] [{signature}]"


def chunk_file(path: str, repo_root: str, content: bytes | str, most: int, least: int) -> list[Chunk]:
    """most, least: tokens of a chunk, as words between white space."""
    if most <= 0:
        raise ValueError(f"the most tokens must be positive, not {most}")
    if least < 0:
        raise ValueError(f"the least tokens can't be negative: {least}")
    text = content if isinstance(content, str) else content.decode("utf-8", "replace")
    path = posixpath.normpath(path)
    language = language_of(path)
    if language is None:
        name = fallback_language(path)
        parts = [(a, b, t) for a, b, _, t in line_windows(text, most, 0) if count_tokens(t) >= least]
        return [Chunk(repo_root, path, i, t, name, a, b, f"[{name}] [{path}]", "") for i, (a, b, t) in enumerate(parts)]
    if not text:
        return []
    starts = line_starts(text)
    line_of = lambda at: _rank(starts, at)
    found: list[tuple[int, int, int, Chunk]] = []
    covered = [False] * (len(starts) + 1)
    for unit in units(text, language):
        last = line_of(max(unit.start, unit.end - 1))
        for n in range(line_of(unit.start), last + 1):
            covered[n] = True
        for a, b in _parts(text, unit, most):
            body = text[a:b]
            if count_tokens(body) <= most:
                pieces = [(line_of(a), line_of(max(a, len(body.rstrip("\n")) + a - 1)), 0, body)]
            else:
                pieces = line_windows(body, most, line_of(a) - 1)
            note = annotation(language, path, unit.parent, unit.signature)
            found += [(s, e, a + o, Chunk(repo_root, path, 0, t, language, s, e, note, unit.signature)) for s, e, o, t in pieces]
    for first, last in _runs(covered):
        begin = starts[first - 1]
        end = starts[last] - 1 if last < len(starts) else len(text)
        found.append((first, last, begin, Chunk(repo_root, path, 0, text[begin:end], language, first, last, annotation(language, path, path, ""), "")))
    kept = sorted((f for f in found if count_tokens(f[3].content) >= least), key=lambda f: f[:3])
    for i, f in enumerate(kept):
        f[3].chunk_index = i
    return [f[3] for f in kept]


def line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def _rank(starts: list[int], at: int) -> int:
    import bisect

    return bisect.bisect_right(starts, at)


def _runs(covered: list[bool]) -> list[tuple[int, int]]:
    """Runs of lines (from 1) that no declaration covers."""
    out, begin = [], 0
    for n in range(1, len(covered)):
        if not covered[n] and not begin:
            begin = n
        if covered[n] and begin:
            out.append((begin, n - 1))
            begin = 0
    return [*out, (begin, len(covered) - 1)] if begin else out


def _parts(text: str, unit: Unit, most: int) -> list[tuple[int, int]]:
    if count_tokens(text[unit.start : unit.end]) <= most:
        return [(unit.start, unit.end)]
    edges = sorted({unit.start, unit.end, *(c for c in unit.cuts if unit.start < c < unit.end)})
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if text[a:b].strip()]


def line_windows(text: str, most: int, before: int) -> list[tuple[int, int, int, str]]:
    """(first line, last line, offset, text): whole lines up to ``most`` tokens; windows overlap by a tenth, in whole lines. before: lines ahead of the text."""
    if not text:
        return []
    lines = text.split("\n")
    sizes = [count_tokens(s) for s in lines]
    at = [0]
    for s in lines:
        at.append(at[-1] + len(s) + 1)
    overlap = max(1, math.ceil(most * 0.10))
    out, first = [], 0
    while first < len(lines):
        if sizes[first] > most:
            out += [(before + first + 1, before + first + 1, at[first] + o, t) for o, t in token_windows(lines[first], most, overlap)]
            first += 1
            continue
        total, end = 0, first
        while end < len(lines) and (end == first or total + sizes[end] <= most):
            total += sizes[end]
            end += 1
        out.append((before + first + 1, before + end, at[first], "\n".join(lines[first:end])))
        back, shared = end, 0
        while back > first and shared < overlap:
            back -= 1
            shared += sizes[back]
        first = back if first < back else end
    return out


def token_windows(line: str, most: int, overlap: int) -> list[tuple[int, str]]:
    """Of one line: the first window from its beginning, the last to its end."""
    spans = [m.span() for m in re.finditer(r"\S+", line)]
    out, i = [], 0
    while i < len(spans):
        j = min(i + most, len(spans))
        a, b = (0 if i == 0 else spans[i][0]), (len(line) if j == len(spans) else spans[j - 1][1])
        out.append((a, line[a:b]))
        i = j - overlap if j - overlap > i else j
    return out


# Declarations -------------------------------------------------------------------------------------------


def units(text: str, language: str) -> list[Unit]:
    """Declarations in order, none inside another."""
    if language == "python":
        return _python_units(text)
    if language == "ruby":
        return _ruby_units(text)
    return _brace_units(text, language)


def _python_units(text: str) -> list[Unit]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return _indented_units(text)
    starts = line_starts(text)
    lines = text.split("\n")

    def offset(line: int, col: int) -> int:
        return starts[line - 1] + len(lines[line - 1].encode()[:col].decode("utf-8", "replace"))

    out: list[Unit] = []

    def walk(node: ast.AST, parent: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                start, end = starts[first - 1] + len(lines[first - 1]) - len(lines[first - 1].lstrip()), offset(child.end_lineno, child.end_col_offset)
                if not child.decorator_list:
                    start = _with_comments(text, start, ("#",))
                if isinstance(child, ast.ClassDef):
                    signature, inner = child.name, (ast.FunctionDef, ast.AsyncFunctionDef)
                else:
                    returns = f" {ast.unparse(child.returns)}" if child.returns else ""
                    signature, inner = f"{child.name}({ast.unparse(child.args)}){returns}", (ast.If, ast.For, ast.While, ast.Try, ast.With, ast.Match, ast.AsyncFor, ast.AsyncWith)
                cuts = []
                for stmt in _outermost(child, inner):
                    if starts[stmt.lineno - 1] > start:
                        top = min([stmt.lineno, *(d.lineno for d in getattr(stmt, "decorator_list", []))])
                        cuts += [starts[top - 1], starts[stmt.end_lineno] if stmt.end_lineno < len(starts) else len(text)]
                out.append(Unit("class" if isinstance(child, ast.ClassDef) else "function", squeeze(signature), parent, start, end, cuts))
            else:
                walk(child, parent)

    walk(tree, "")
    return out


def _outermost(node: ast.AST, kinds: tuple[type, ...]) -> list[ast.AST]:
    """Nodes of these kinds below ``node`` that are in no other such node, in order."""
    out: list[ast.AST] = []
    for child in ast.iter_child_nodes(node):
        out += [child] if isinstance(child, kinds) else _outermost(child, kinds)
    return out


_PY = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)", re.M)


def _indented_units(text: str) -> list[Unit]:
    """Python that doesn't parse: a declaration goes on while lines are indented deeper."""
    out: list[Unit] = []
    for m in _PY.finditer(text):
        if out and m.start() < out[-1].end:
            continue
        depth, end = len(m[1]), m.end()
        for line in re.finditer(r"[^\n]*(?:\n|\Z)", text[m.end() :]):
            body = line[0]
            if line.start() and body.strip() and len(body) - len(body.lstrip()) <= depth:
                break
            if body.strip():
                end = m.end() + line.start() + len(body.rstrip("\n"))
            if not body:
                break
        head = text[m.start(3) : text.find("\n", m.start(3)) if "\n" in text[m.start(3) :] else len(text)]
        out.append(Unit(m[2], m[3] if m[2] == "class" else squeeze(head.rstrip(": ")), "", _with_comments(text, m.start(), ("#", "@")), end))
    return out


_RUBY = re.compile(r"^[ \t]*(def|class|module)[ \t]+([\w.:?!=]+)([^\n]*)", re.M)
_RUBY_BLOCK = re.compile(r"^[ \t]*(?:def|class|module|if|unless|while|until|for|case|begin)\b|\bdo\b[ \t]*(?:\|[^|\n]*\|)?[ \t]*$|^[ \t]*(end)\b", re.M)


def _ruby_units(text: str) -> list[Unit]:
    plain = mask(text, "ruby")
    out: list[Unit] = []
    for m in _RUBY.finditer(plain):
        if out and m.start() < out[-1].end:
            continue
        depth, end = 0, len(text)
        for b in _RUBY_BLOCK.finditer(plain, m.start()):
            depth += -1 if b[1] else 1
            if depth == 0:
                end = b.end()
                break
        name = m[2]
        signature = name if m[1] != "def" else squeeze(name + (m[3].strip() if m[3].strip().startswith("(") else "()"))
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        out.append(Unit(m[1], signature, "", _with_comments(text, start, ("#",)), end))
    return out


_STRINGS = {
    "go": r'"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\.|[^\'\\\n])+\'',
    "rust": r'r(#*)"[\s\S]*?"\1|"(?:\\.|[^"\\])*"|\'(?:\\.[^\']*|[^\'\\\n])\'',
    "ruby": r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'',
    "swift": r'"""[\s\S]*?"""|"(?:\\.|[^"\\\n])*"',
    "kotlin": r'"""[\s\S]*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'',
}
_SCRIPT = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`'
_PLAIN_STRINGS = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\''


def mask(text: str, language: str) -> str:
    """The text with strings and comments blanked, of the same length."""
    strings = _STRINGS.get(language, _SCRIPT if language in ("typescript", "javascript") else _PLAIN_STRINGS)
    comments = r"#[^\n]*" if language in ("ruby", "python") else r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
    return re.sub(f"{comments}|{strings}", lambda m: re.sub(r"[^\n]", " ", m[0]), text)


_NAME = r"[A-Za-z_$][\w$]*"
_GENERIC = r"(?:<[^;{}()]*>)?"
#: Of each language: (kind, pattern); ``name`` is what is declared; kinds in CLASSES have no parameters.
_DECLARED: dict[str, list[tuple[str, str]]] = {
    "go": [("method", rf"^func[ \t]*\((?P<receiver>[^)]*)\)[ \t]*(?P<name>{_NAME})"), ("function", rf"^func[ \t]+(?P<name>{_NAME})(?:\[[^\]]*\])?"), ("type", rf"^type[ \t]+(?P<name>{_NAME})"), ("type", r"^type[ \t]*(?P<name>)\(")],
    "rust": [
        ("function", rf"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:(?:async|const|unsafe|extern)[ \t]+)*fn[ \t]+(?P<name>{_NAME})"),
        ("impl", r"^[ \t]*(?:unsafe[ \t]+)?(?P<name>impl\b[^{;]*)"), ("class", rf"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:struct|enum|(?:unsafe[ \t]+)?trait)[ \t]+(?P<name>{_NAME})"),
    ],
    "java": [("class", rf"^[ \t]*(?:(?:public|protected|private|static|final|abstract|sealed|strictfp)\s+)*(?:class|interface)\s+(?P<name>{_NAME})"), ("function", rf"^[ \t]*(?:(?:public|protected|private|static|final|abstract|synchronized|default)\s+)+(?:[\w.\[\]]+{_GENERIC}\s+)?(?P<name>{_NAME})[ \t]*(?=\()")],
    "kotlin": [("class", rf"^[ \t]*(?:\w+[ \t]+)*?(?:class|object|interface)[ \t]+(?P<name>{_NAME})"), ("function", rf"^[ \t]*(?:\w+[ \t]+)*?fun[ \t]+{_GENERIC}[ \t]*(?:[\w.<>?]+\.)?(?P<name>{_NAME})")],
    "swift": [("class", rf"^[ \t]*(?:@?\w+[ \t]+)*?(?:class|struct|protocol|enum|extension|actor)[ \t]+(?P<name>{_NAME})"), ("function", rf"^[ \t]*(?:@?\w+[ \t]+)*?func[ \t]+(?P<name>{_NAME})")],
    "c": [("class", rf"^[ \t]*(?:typedef[ \t]+)?struct[ \t]+(?P<name>{_NAME})(?=\s*\{{)"), ("function", rf"^(?!\s*(?:return|else|typedef)\b)[A-Za-z_][\w \t\*]*?[\s\*](?P<name>{_NAME})[ \t]*(?=\([^;{{}}]*\)\s*\{{)")],
    "cpp": [
        ("class", rf"^[ \t]*(?:inline[ \t]+)?namespace[ \t]*(?P<name>(?:{_NAME}(?:::{_NAME})*)?)(?=\s*\{{)"), ("class", rf"^[ \t]*(?:template[ \t]*<[^{{;]*>\s*)?(?:class|struct)[ \t]+(?P<name>{_NAME})(?=[^;()]*\{{)"),
        ("function", rf"^(?!\s*(?:return|else|typedef|using)\b)[ \t]*(?:template[ \t]*<[^{{;]*>\s*)?[A-Za-z_][\w:<>,&\* \t]*?[\s\*&](?P<name>(?:{_NAME}::)*~?{_NAME})[ \t]*(?=\([^;{{}}]*\)[^;{{}}]*\{{)"),
    ],
    "typescript": [],
}
_DECLARED["typescript"] = _DECLARED["javascript"] = [
    ("class", rf"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:abstract[ \t]+)?(?P<node>class[ \t]+(?P<name>{_NAME}))"),
    ("function", rf"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?P<node>(?:async[ \t]+)?function\*?[ \t]+(?P<name>{_NAME}))"),
    ("arrow", rf"\b(?:const|let|var)[ \t]+(?P<name>{_NAME})(?:[ \t]*:[^=;\n]+)?[ \t]*=[ \t]*(?P<node>(?:async[ \t]*)?)(?={_GENERIC}\([^;{{}}]*?\)[^;{{}}=]*=>)"),
    ("function", rf"^[ \t]*(?P<node>(?:(?:public|private|protected|static|async|get|set|readonly)[ \t]+)*(?!(?:if|for|while|switch|catch|function|return|new|typeof|await)\b)(?P<name>#?{_NAME}))[ \t]*{_GENERIC}(?=\([^;{{}}]*\)\s*(?::[^;={{]+)?\{{)"),
]
_COMPILED = {k: [(kind, re.compile(p, re.M)) for kind, p in v] for k, v in _DECLARED.items()}
_FLOW = re.compile(r"^[ \t]*(?:\}[ \t]*)?(?:if|for|while|switch|select|match|loop|do|try|when|guard|repeat)\b", re.M)
_MEMBER = re.compile(rf"^[ \t]*(?:[\w@]+[ \t]+)*?(?:fn|func|fun)?[ \t]*{_NAME}[ \t]*{_GENERIC}\([^;{{}}]*\)[^;{{}}]*\{{", re.M)
CLASSES = ("class", "impl", "type")


def _closing(plain: str, at: int, pair: str) -> int:
    """The offset after the bracket that closes the one at ``at``."""
    depth = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(plain, at):
        depth += 1 if m[0] == pair[0] else -1
        if depth == 0:
            return m.end()
    return len(plain)


def _brace_units(text: str, language: str) -> list[Unit]:
    plain = mask(text, language)
    found = sorted((m.start("node") if "node" in m.re.groupindex else m.start() + len(m[0]) - len(m[0].lstrip()), i, kind, m) for i, (kind, p) in enumerate(_COMPILED[language]) for m in p.finditer(plain))
    out: list[Unit] = []
    for start, _, kind, m in found:
        if out and start < out[-1].end:
            continue
        at, params, returns = m.end(), "", ""
        name = squeeze(text[m.start("name") : m.end("name")])
        if kind not in CLASSES:
            if (paren := plain.find("(", at)) >= 0 and not plain[at:paren].strip(" \t<>,?\n" + "".join(set(plain[at:paren]) if "<" in plain[at:paren] or "[" in plain[at:paren] else "")):
                at = _closing(plain, paren, "()")
                params = text[paren:at]
        stop = re.compile(r"[{;]|=>|\n(?=\s*\n)|\n(?=[^\s{])").search(plain, at)
        here = stop.start() if stop else len(text)
        returns = squeeze(text[at:here])
        if stop and stop[0] == "=>":
            body = re.compile(r"\s*").match(plain, stop.end()).end()
            end = _closing(plain, body, "{}") if plain[body : body + 1] == "{" else next((x.start() for x in re.compile(r"[;\n]").finditer(plain, body)), len(text))
        elif stop and stop[0] == "{":
            end = _closing(plain, here, "{}")
        elif kind == "type" and plain[m.end() - 1 : m.end()] == "(":
            end = _closing(plain, m.end() - 1, "()")
        else:
            if kind in ("function", "method", "arrow") and language not in ("kotlin", "swift", "rust", "java"):
                continue
            end = stop.end() if stop and stop[0] == ";" else here
        if kind in CLASSES:
            signature = name or squeeze(text[start:end].split("\n", 1)[0])
        else:
            returns = re.sub(r"^(?:->|:)\s*", "", returns)
            signature = squeeze(f"{name or 'anonymous'}{params or '()'} {returns}")
        parent = _receiver(m["receiver"]) if kind == "method" else ""
        cuts = []
        body = plain.find("{", start)
        if 0 <= body < end:
            close = body
            for c in (_MEMBER if kind in CLASSES else _FLOW).finditer(plain, body + 1, end):
                if c.start() >= close:  # of those inside each other the outermost, however deep it stands
                    opened = plain.find("{", c.start(), end)
                    close = _closing(plain, opened, "{}") if opened >= 0 else c.end()
                    nl = plain.find("\n", close)
                    cuts += [c.start(), nl + 1 if 0 <= nl < end else close]
        marks = ("//", "/*", "*", "@", "#[") if language == "rust" else ("//", "/*", "*", "@")
        out.append(Unit(kind, signature, parent, _with_comments(text, start, marks), end, cuts))
    return out


def _receiver(text: str) -> str:
    """The bare type of a method's receiver."""
    kind = re.sub(r"\[.*", "", text.strip().split()[-1] if text.strip() and "[" not in text else re.sub(r"\[[\s\S]*", "", text).strip().split()[-1] if text.strip() else "")
    return kind.strip("*&( )").rsplit(".", 1)[-1]


def _with_comments(text: str, start: int, marks: tuple[str, ...]) -> int:
    """Back over comments and decorators that stand right before a declaration, blank lines between them."""
    line = text.rfind("\n", 0, start) + 1
    if text[line:start].strip():
        return start
    best, at = start, line
    while at > 0:
        before = text.rfind("\n", 0, at - 1) + 1
        body = text[before : at - 1].strip()
        if body.startswith(marks) or body.endswith("*/"):
            best = before + len(text[before : at - 1]) - len(text[before : at - 1].lstrip())
        elif body:
            break
        at = before
    return best
