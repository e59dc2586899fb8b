"""Text functions as column expressions; all run inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.languages import EXTENSIONS


def normalize_for_hash(text: Column) -> Column:
    """Line ends as \\n, no blanks at line ends, no empty lines at the end. Indentation counts."""
    unix = F.regexp_replace(text, "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(unix, "(?dm)[ \t]+$", ""), "\n+\\z", "")


def content_hash(text: Column) -> Column:
    return F.sha2(normalize_for_hash(text), 256)


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, "\\s+"), lambda t: t != "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def language_of_path(path: Column) -> Column:
    """By extension; one without a grammar is its own name, none is ``text``."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    known = F.create_map(*(F.lit(x) for e, n in EXTENSIONS.items() for x in (e.removeprefix("."), n)))
    return F.when(ext == "", "text").otherwise(F.coalesce(known[ext], ext))


def first_line(text: Column) -> Column:
    return F.trim(F.substring_index(text, "\n", 1))


def preview(text: Column, most: int = 120) -> Column:
    """The first line, cut to ``most`` code points with three dots."""
    line = first_line(text)
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 3), F.lit("..."))).otherwise(line)


def first_name(signature: Column) -> Column:
    """The first word of a signature, as a name: a letter or underscore, then letters, digits, underscores."""
    return F.regexp_extract(signature, r"[\p{L}_][\p{L}\p{Nd}_]*", 0)


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 3)


def embed_text(annotation: Column, content: Column) -> Column:
    return F.concat(annotation, F.lit("\n\n"), content)


def _marked_letters() -> dict[str, str]:
    """Letters that canonical decomposition makes a plain Latin letter and marks, and that letter."""
    out = {}
    for c in map(chr, range(0xC0, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and base.isascii() and base.isalpha() and all(unicodedata.combining(m) for m in marks):
            out[c] = base.lower()
    return out


#: Letters that lose their marks in search terms; marks that stand alone after a letter go too.
_LETTERS = _marked_letters()


_BETWEEN = r"[^\p{L}\p{N}]+"


def _unmarked(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(text), "".join(_LETTERS), "".join(_LETTERS.values())), r"\p{M}+", "")


def search_terms(text: Column) -> Column:
    """Runs of letters and digits, lower case, without marks."""
    return F.filter(F.split(_unmarked(text), _BETWEEN), lambda t: t != "")


def spaced_terms(text: Column) -> Column:
    """The same terms as one string, with a space before, between and after them."""
    return F.concat(F.lit(" "), F.regexp_replace(_unmarked(text), _BETWEEN, " "), F.lit(" "))


def phrases(query: str) -> list[str]:
    """A query is words between white space, each a phrase; quotes inside a word are part of it."""
    return query.split()


def quoted(query: str) -> str:
    """The query as full-text engines write it: each word in quotes, quotes doubled."""
    return " ".join('"' + w.replace('"', '""') + '"' for w in phrases(query))
