"""Names that a piece of code refers to."""

from __future__ import annotations

import re

from siltstone.functions.chunker import mask
from siltstone.functions.languages import CANONICAL

#: Words of the languages and names too common to tell anything, sorted.
NOISE = frozenset("""
Array BigInt Boolean False None Number Object Promise String Symbol True abstract and any append as assert async await bool boolean break byte
bytearray bytes cap case catch chan class classmethod close cls complex complex64 complex128 console const continue copy declare def default defer
del delete dict elif else enum error except export exports extends fallthrough false finally float float32 float64 for from func global go goto if
implements import in init instanceof int int8 int16 int32 int64 interface iota is lambda len let list main make map module never new nil nonlocal
not null number object or package panic pass print println private property protected public raise range readonly recover require return rune self
select set static staticmethod str string struct super switch test this throw true try tuple type typeof uint uint8 uint16 uint32 uint64 uintptr
undefined unknown var void while with yield
""".split())  # fmt: skip

_IDENT = re.compile(r"[^\W\d]\w*")
_AFTER_DECLARATION = re.compile(r"(?:\bfunc(?:\s*\([^)]*\))?|\bdef|\bfunction|\bfn|\bfun|\bclass|\bstruct|\binterface|\btrait|\benum)\s*$")


def references(content: str, language: str) -> list[tuple[str, str]]:
    """(name, kind) in order of appearance, each once: kind is call, type, field or identifier. A language without grammar has none."""
    if language.strip().lower() not in CANONICAL:
        return []
    plain = mask(content, language)
    out: dict[tuple[str, str], None] = {}

    def add(name: str, kind: str) -> None:
        if len(name.encode()) >= 2 and name not in NOISE:
            out.setdefault((name, kind))

    for m in _IDENT.finditer(plain):
        name, before, after = m[0], plain[: m.start()].rstrip(" \t")[-24:], plain[m.end() : m.end() + 2].lstrip(" \t")
        member = before.endswith((".", "->", "::", "?."))
        if _AFTER_DECLARATION.search(before + " "):
            add(name, "identifier")
        elif after.startswith("("):
            add(name, "call")
            add(name, "field" if member else "identifier")
        elif member:
            add(name, "field")
        elif name[0].isupper() and (after.startswith(("{", "<", "[")) or re.search(r"[:*&\]]$|\bvar\s+\w+$|\bnew$|->$|\b\w+$", before) and not before.endswith((":=", "return"))):
            add(name, "type")
        else:
            add(name, "identifier")
    return list(out)


def first_name(signature: str) -> str:
    """The name that a signature begins with; of an implementation block that of its type."""
    s = re.sub(r"^\s*impl(?:<[^>]*>)?\s+(?:[^{]*\bfor\s+)?", "", signature)
    m = _IDENT.search(s)
    return m[0] if m else ""


def without_own(refs: list[tuple[str, str]], signature: str) -> list[tuple[str, str]]:
    own = first_name(signature)
    return [r for r in refs if not own or r[0] != own]
