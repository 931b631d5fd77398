"""Token ids of whole texts with a public tokenizer file, as used for packing.

``WordTokens`` returns what ``Tokenizer.encode(text, add_special_tokens=False)`` returns. It relies
on one property of the tokenizer file, checked when it is loaded: its pre-tokenizer never lets a
token span white space, so a text's ids are the ids of its words in a row. Words seen before are
looked up in a memo of bounded size; only new ones are merged.
"""

from __future__ import annotations

import json
import re

import numpy as np

# ASCII white space, which every part of the tokenizer treats as such.
CHUNK = re.compile(r"[^\x20\x09-\x0D]+")
# Texts of these characters only are in normal form, and lower() is one character to one.
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
# Lower-cased plain texts by the split rule of the file: each match is a token run of its own.
PLAIN_WORD = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^ \t\n\ra-zß-öø-ÿ0-9]+")
# The rules of the tokenizer file. Fixed values of that file.
SPLIT_RULE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
END = "</w>"


class WordTokens:
    """Ids of texts. The memo has at most ``2 * memo`` words and what one call adds: its older half
    goes when the younger one is full."""

    def __init__(self, path: str, memo: int = 250_000) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        split = form["pre_tokenizer"]["pretokenizers"][0]
        same = (
            [n["type"] for n in form["normalizer"]["normalizers"]] == NORMALIZERS
            and split["pattern"] == {"Regex": SPLIT_RULE}
            and split["behavior"] == "Removed"
            and not form["post_processor"]
            and form["model"]["type"] == "BPE"
            and form["model"]["end_of_word_suffix"] == END
        )
        if not same:
            raise ValueError(f"{path}: not the word-wise tokenizer this module knows")
        self.specials = [t["content"] for t in form["added_tokens"]]
        self.tokenizer = Tokenizer.from_file(path)
        vocab = form["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocab.items() if w.endswith(END)]] = True
        self.memo = memo
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, words: list[str]) -> None:
        """Ids of plain words. Each is one run for the tokenizer, so exactly one END token ends it."""
        for i in range(0, len(words), 256):
            some = words[i : i + 256]
            ids = self._ids(" ".join(some))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):
                raise ValueError("the tokenizer split a word in a way its rules do not say")
            raw, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
            self.young.update((w, raw[at[k] : at[k + 1]]) for k, w in enumerate(some))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.young) > self.memo:
            self.old, self.young = self.young, {}
        rows: list[list[str] | bytes] = []
        for t in texts:
            if PLAIN.fullmatch(t) and not any(s in t for s in self.specials):
                rows.append(PLAIN_WORD.findall(t.lower()))
            else:  # rare characters: piece by piece, which keeps the library's memory small
                rows.append(b"".join(self._ids(c).tobytes() for c in CHUNK.findall(t)))
        young, old = self.young, self.old
        new: dict[str, None] = {}
        for words in rows:
            if isinstance(words, list):
                for w in words:
                    if w not in young:
                        if w in old:
                            young[w] = old[w]
                        else:
                            new[w] = None
        self._learn(list(new))
        get = young.__getitem__
        return [b"".join(map(get, r)) if isinstance(r, list) else r for r in rows]
