"""Token counts by the whole-token shortcut.

It is proved once, on the driver, which strings of the vocabulary encode alone as one token: each is
run through all merges. A pre-token among them counts as one token with no merging; only the others
are merged, once for each distinct one that a worker has not met lately.

Nulls and empty texts: 0 bytes, 0 tokens. A null id stays null; repeated rows give repeated results;
very long texts are split and counted piece by piece. Columns besides the two that are named are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import islice

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.byte_bpe import SPLIT, byte_alphabet
from siltstone.llm.texts import PLAIN, by_block
from siltstone.session import column, ship

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Distinct merged pre-tokens that a worker remembers; then it starts anew.
REMEMBERED = 1 << 18

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


class _Merger:
    """The merges of a tokenizer, with neither normalizer nor pre-tokenizer before them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec["pre_tokenizer"] or {}
        #: Whether the file splits texts as SPLIT does, and no added token takes more of a text than its own characters.
        self.plain = (
            spec["normalizer"] is None and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space")
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        )
        self.bare = Tokenizer(self.full.model)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]

    def counts(self, pieces: list[str]) -> list[int]:
        """pieces: in the byte-level alphabet."""
        return [len(e.ids) for e in self.bare.encode_batch(pieces, add_special_tokens=False)]


@lru_cache(maxsize=2)
def _merger(path: str) -> _Merger:
    return _Merger(path)


def whole_tokens(path: str) -> frozenset[str]:
    """The proof: strings of the vocabulary (byte-level alphabet) which all merges turn into one token."""
    m = _merger(path)
    if not m.plain:
        return frozenset()
    vocab = [s for s in m.full.get_vocab(with_added_tokens=False) if s not in m.special]
    return frozenset(s for s, n in zip(vocab, m.counts(vocab), strict=True) if n == 1)


class TokenCounter:
    """Counts tokens of texts. solo: what ``whole_tokens`` proved."""

    def __init__(self, path: str, solo: Iterable[str]):
        import regex

        self.path, self.find = path, regex.compile(SPLIT)
        alphabet = byte_alphabet()
        self.table = {i: c for i, c in enumerate(alphabet)}
        back = {c: bytes([b]) for b, c in enumerate(alphabet)}
        self.solo: dict[str, int] = {}
        for s in solo:
            try:
                self.solo[b"".join(map(back.__getitem__, s)).decode()] = 1
            except UnicodeDecodeError:
                pass  # part of a character: never a whole pre-token
        self.known = dict(self.solo)
        special = _merger(path).special
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.odd = re.compile(f"[^{PLAIN}]")

    def _segments(self, text: str) -> tuple[int, list[str]]:
        if self.special is None or not self.special.search(text):
            return 0, [text]
        parts = self.special.split(text)
        return len(parts) - 1, parts

    def _pieces(self, segment: str) -> Iterable[str]:
        if self.odd.search(segment):  # classes of such characters may differ by library: its own splitter decides
            back = {c: b for b, c in self.table.items()}
            return (bytes(map(back.__getitem__, s)).decode("utf-8", "surrogateescape") for s, _ in _merger(self.path).full.pre_tokenizer.pre_tokenize_str(segment))
        return (m[0] for m in self.find.finditer(segment)) if len(segment) > 1 << 22 else self.find.findall(segment)

    def _learn(self, new: set[str]) -> None:
        if len(self.known) > REMEMBERED + len(self.solo):
            fresh = new | (self.known.keys() & new)
            self.known = dict(self.solo)
            new = {p for p in fresh if p not in self.known}
        words = list(new)
        shown = [w.encode("utf-8", "surrogateescape").decode("latin-1").translate(self.table) for w in words]
        self.known.update(zip(words, _merger(self.path).counts(shown), strict=True))

    def count(self, text: str) -> int:
        if not _merger(self.path).plain:  # the file splits texts by rules of its own: the library counts
            return len(_merger(self.path).full.encode(text, add_special_tokens=False).ids)
        total, segments = self._segments(text)
        for s in segments:
            pieces = iter(self._pieces(s))
            while block := list(islice(pieces, 1 << 18)):
                if new := set(block).difference(self.known):
                    self._learn(set(block) if len(self.known) + len(new) > REMEMBERED + len(self.solo) else new)
                total += sum(map(self.known.__getitem__, block))
        return total


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``. One pass, no shuffle."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    ship(docs.sparkSession)
    solo = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # bounded by the vocabulary
    made: list[TokenCounter] = []

    def rows(ids: list, texts: list[str]) -> dict[str, object]:
        if not made:
            made.append(TokenCounter(path, solo.value))
        n = [made[0].count(t) for t in texts]
        return {"doc_id": ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    run = by_block(rows, SCHEMA)
    return docs.select(column(docs, id_col).cast("long"), column(docs, text_col)).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
