"""BPE encoding and decoding, speculate and verify.

For a tokenizer whose words end in a marked symbol. Greedy longest match proposes the tokens of every
new word in one pass of an automaton over all of them; a vectorised check tests each adjacent pair of
proposed tokens, by undoing their merges from the last to the first, for whether merging would have
joined them across their border. A word all of whose pairs hold is encoded; only failing words undergo
exact merging. What a worker has encoded it remembers, up to ``REMEMBERED`` words.

Why that is right: BPE's encoding of a string is the only sequence of its tokens in which each adjacent
pair is what BPE makes of the two tokens' text, given that each merge makes a token of its own and needs
only tokens made before (``WordBpe`` raises if the file is not so).

Nulls and empty texts: no tokens, decoded to an empty text. Special strings in a text become their ids,
as is the library's default. A null id stays null; repeated rows give repeated results. Columns besides
the two that are named are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.byte_bpe import byte_alphabet
from siltstone.llm.texts import PLAIN, by_block
from siltstone.session import column, ship

TOKENIZER = "word_bpe_49k.json"
REMEMBERED = 1 << 18
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
#: The last byte of a word is shown by a character so much further on.
LAST = 0x100


class WordBpe:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not self.end or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
            raise ValueError(f"{path}: not a lower-casing BPE with marked word ends")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.find = regex.compile(split).findall
        self.odd = re.compile(f"[^{PLAIN}]")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("|".join(f"({re.escape(s)})" for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.back = {c: b for b, c in enumerate(byte_alphabet())}

        # Symbols: 0 to 255 are bytes, 256 to 511 bytes that end a word; then one for each merge, in their order.
        single = [vocab[c] for c in byte_alphabet()] + [vocab[c + self.end] for c in byte_alphabet()]
        symbol_of = {i: s for s, i in enumerate(single)}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right = np.zeros(512 + len(merges), np.int64), np.zeros(512 + len(merges), np.int64)
        for k, (a, b) in enumerate(merges):
            made = vocab[a + b]
            if made in symbol_of:
                raise ValueError(f"{path}: two merges make {a + b!r}")
            left[512 + k], right[512 + k] = symbol_of[vocab[a]], symbol_of[vocab[b]]  # a KeyError: made later than it is needed
            symbol_of[made] = 512 + k
        self.left, self.right = left, right
        self.n = len(left)
        keys = left[512:] * self.n + right[512:]
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.id_of = np.zeros(self.n, np.uint32)
        for i, s in symbol_of.items():
            self.id_of[s] = i
        self.automaton = ahocorasick.Automaton()
        for i, s in symbol_of.items():
            self.automaton.add_word(self._shown(self.names[i]), s)
        self.automaton.make_automaton()
        self.length = np.zeros(self.n, np.int64)
        for i, s in symbol_of.items():
            self.length[s] = len(self._shown(self.names[i]))
        self.known: dict[str, tuple[bytes, str]] = {}
        self.merged = self.proposed = 0

    def _shown(self, token: str) -> str:
        """A token with a character for each byte, the one that ends a word moved by LAST."""
        ends = token.endswith(self.end)
        b = [self.back[c] for c in (token[: -len(self.end)] if ends else token)]
        if ends:
            b[-1] += LAST
        return "".join(map(chr, b))

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge; one beyond all where there is none."""
        k = a * self.n + b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.order[at], self.n)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of symbols, whether merging their joined text gives just these two again.

        x and y are the parts of a and b at their border, walked back in time: the later of the two merges
        that made them is undone first. A merge of x and y that comes before either goes on kills the pair;
        if it is the very merge by which x goes on, the left one is done first and the pair lives.
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        good = np.ones(len(x), bool)
        x_goes, y_goes = np.full(len(x), self.n), np.full(len(x), self.n)
        live = np.arange(len(x))
        while len(live):
            xl, yl = x[live], y[live]
            r = self.pair_ranks(xl, yl)
            bad = (r < self.n) & (r < x_goes[live]) & (r <= y_goes[live])
            good[live[bad]] = False
            made_x, made_y = xl - 512, yl - 512  # below 0: a byte
            undo_x = made_x > made_y
            on = ~bad & ((made_x >= 0) | (made_y >= 0))
            ux, uy = live[on & undo_x], live[on & ~undo_x]
            x_goes[ux], x[ux] = made_x[on & undo_x], self.right[x[ux]]
            y_goes[uy], y[uy] = made_y[on & ~undo_x], self.left[y[uy]]
            live = live[on]
        return good

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Exact merging, of many words side by side: in each round every word does its merge of lowest rank."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        s = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        s[np.cumsum(size) - 1] += LAST
        out: list[np.ndarray] = [s[:0]] * len(words)
        word = np.repeat(np.arange(len(words)), size)
        ranks = np.full(len(s), self.n)  # of a symbol with the next one
        ranks[:-1] = np.where(word[1:] == word[:-1], self.pair_ranks(s[:-1], s[1:]), self.n)
        while len(s):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(ranks, first)
            size = np.diff(np.concatenate([first, [len(s)]]))
            if (done := least == self.n).any():
                for w, a, n in zip(word[first[done]].tolist(), first[done].tolist(), size[done].tolist(), strict=True):
                    out[w] = s[a : a + n]
                keep = np.repeat(~done, size)
                s, word, ranks, size, least = s[keep], word[keep], ranks[keep], size[~done], least[~done]
                if not len(s):
                    break
            hit = ranks == np.repeat(least, size)
            if (hit[1:] & hit[:-1]).any():  # a symbol three times or more: pairs from the left
                at = np.arange(len(s))
                begin = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), at, 0))
                hit &= (at - begin) % 2 == 0
            gone = np.concatenate([[False], hit[:-1]])
            s = np.where(hit, 512 + ranks, s)
            s, word, ranks = s[~gone], word[~gone], ranks[~gone]
            new = hit[~gone]
            anew = np.flatnonzero(new[:-1] | new[1:])  # pairs with a merged symbol on either side
            ranks[-1:] = self.n
            ranks[anew] = np.where(word[anew + 1] == word[anew], self.pair_ranks(s[anew], s[anew + 1]), self.n)
        return out

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Symbols of each word (not empty), in UTF-8."""
        shown = [w[:-1].decode("latin-1") + chr(w[-1] + LAST) for w in words]
        got = np.fromiter((s for _, s in self.automaton.iter_long("".join(shown))), np.int64)
        ends = np.cumsum(self.length[got])
        borders = np.cumsum(np.fromiter(map(len, shown), np.int64, len(shown)))
        last = np.searchsorted(ends, borders)  # the token that ends each word
        pairs = np.ones(len(got), bool)  # of a token with the next one
        inner = np.ones(len(got), bool)
        whole = len(ends) and ends[-1] == borders[-1] and bool((ends[np.minimum(last, len(ends) - 1)] == borders).all())
        if not whole:  # the proposals don't tile the words
            return self.merge(words)
        inner[last] = False
        at = np.flatnonzero(inner)
        both, where = np.unique(got[at] * self.n + got[at + 1], return_inverse=True)
        pairs[at] = self.compatible(both // self.n, both % self.n)[where]
        bad_before = np.concatenate([[0], np.cumsum(~pairs)])
        starts = np.concatenate([[0], last[:-1] + 1])
        failing = bad_before[last + 1] > bad_before[starts]
        out = [got[a : b + 1] for a, b in zip(starts.tolist(), last.tolist(), strict=True)]
        anew = np.flatnonzero(failing).tolist()
        for i, s in zip(anew, self.merge([words[i] for i in anew]), strict=True):
            out[i] = s
        self.proposed += len(words)
        self.merged += int(failing.sum())
        return out

    def _learn(self, new: list[str]) -> None:
        coded = self.encode_words([w.encode() for w in new])
        ids = self.id_of[np.concatenate(coded)]
        raw, names, at = ids.astype("<u4").tobytes(), list(map(self.names.__getitem__, ids.tolist())), 0
        for w, s in zip(new, coded, strict=True):
            end = at + len(s)
            self.known[w] = (raw[4 * at : 4 * end], " ".join(names[at:end]))
            at = end

    def words(self, text: str) -> list[str]:
        """Normalised words; a special string stands as its id's name after chr(0)."""
        if self.at_special is None or not self.at_special.search(text):
            return self._words(text)
        out: list[str] = []
        for part in self.at_special.split(text):
            if part in self.special:
                out.append("\0" + part)
            elif part:
                out += self._words(part)
        return out

    def _words(self, text: str) -> list[str]:
        if self.odd.search(text):  # such characters may differ by library: its own normaliser and splitter decide
            shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(map(self.back.__getitem__, s)).decode() for s, _ in shown]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.find(text.lower())

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian 32-bit integers, and the text decoded from them."""
        split = [self.words(t) for t in texts]
        if new := set().union(*split).difference(self.known):
            if len(self.known) + len(new) > REMEMBERED:
                self.known, new = {}, set().union(*split)
            for w in [w for w in new if w[0] == "\0" and w[1:] in self.special]:
                self.known[w] = (np.uint32(self.special[w[1:]]).astype("<u4").tobytes(), w[1:])
                new.discard(w)
            if new:
                self._learn(sorted(new))
        out = []
        for words in split:
            got = list(map(self.known.__getitem__, words))
            out.append((b"".join([g[0] for g in got]), " ".join([g[1] for g in got])))
        return out


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One per Python worker."""
    return WordBpe(path)


def encode_decode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row. One pass, no shuffle."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    ship(docs.sparkSession)

    def rows(ids: list, texts: list[str]) -> dict[str, object]:
        bpe = word_bpe(path)
        coded = bpe.encode(texts)
        return {
            "doc_id": ids, "n_tokens": [len(b) // 4 for b, _ in coded],
            "ids_sha256": [hashlib.sha256(b).hexdigest() for b, _ in coded],
            "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for _, d in coded],
        }

    run = by_block(rows, SCHEMA)
    return docs.select(column(docs, id_col).cast("long"), column(docs, text_col)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
