"""Byte-level BPE encoding by merge ranks: the same ids as the tokenizer gives.

Where a vocabulary's ids are its merge ranks, texts are cut by the byte-level pattern and merged by rank, which is the same and faster; texts that hold
one of its added tokens, and other vocabularies, go to the tokenizer. The byte-level pattern looks ahead only to leave a run's last space to the word that
follows; texts are cut there first, so that the pattern used, FLAT, does without, which is faster.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

FLAT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
#: What \s is in FLAT (Python's own has four signs more), and the places before the last of two or more that something follows.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CUT = re.compile(f"(?<=[{SPACE}])(?=[{SPACE}][^{SPACE}])")
#: Bytes of UTF-8: 1 for ASCII spaces, 2 for those that the other spaces (and more) begin with.
KINDS = bytes(2 if chr(b) in "\xc2\xe1\xe2\xe3" else chr(b) in "\t\n\x0b\x0c\r " for b in range(256))


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """text -> its ids as little-endian `kind`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = max(self.tokenizer.get_vocab().values()) + 1
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.ranked = self._ranked(path)

    @staticmethod
    def _parts(text: str) -> list[str]:
        kinds = text.encode().translate(KINDS)
        return CUT.split(text) if b"\1\1" in kinds or b"\2" in kinds else [text]

    def _ranked(self, path: str):
        """The encoding by merge ranks; None where ids aren't ranks."""
        import tiktoken

        model, letter = json.load(open(path))["model"], byte_letters()
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        ranks = {bytes(letter[c] for c in w): i for w, i in vocab.items() if w not in self.added}
        special = {w: self.size + i for i, w in enumerate(self.added or ["<|none|>"])}  # encoded as other text is; with none at all, encode_to_numpy would stop at every place
        return tiktoken.Encoding("ranks", pat_str=FLAT, mergeable_ranks=ranks, special_tokens=special).encode_to_numpy

    def encode(self, text: str) -> bytes:
        if self.ranked is None or any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return b"".join([self.ranked(x, disallowed_special=()).astype(self.kind).tobytes() for x in self._parts(text)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One a worker process; the file must be at this path on every machine."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
