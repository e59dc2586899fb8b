"""Byte-level BPE tokenizers kept in JSON files, by a merge engine that works from the ranks.

``ByteBpe`` gives the ids that the tokenizers library gives (``add_special_tokens=False``; special
strings inside a text become their ids, as is that library's default).
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: How the byte-level pre-tokenizer splits.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in set(shown))
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class ByteBpe:
    """Ids by ranks where the file allows it (see ``exact``), else by the library itself."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        vocab, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        made = [vocab[a + b] for a, b in merges]
        self.exact = (
            model["type"] == "BPE" and not model.get("ignore_merges") and not model.get("dropout")
            and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
            and spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
            and made == sorted(set(made))
        )
        if self.exact:
            import tiktoken

            back = {c: b for b, c in enumerate(byte_alphabet())}
            ranks = {bytes(back[c] for c in s): i for s, i in vocab.items() if s not in self.special}
            self._engine = tiktoken.Encoding("siltstone", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=self.special)
        else:
            from tokenizers import Tokenizer

            self._engine = Tokenizer.from_file(path)
            self._engine.no_truncation()
            self._engine.no_padding()

    def ids(self, text: str) -> np.ndarray:
        if self.exact:
            return self._engine.encode_to_numpy(text, allowed_special="all")
        return np.array(self._engine.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    """One per Python worker."""
    return ByteBpe(path)
