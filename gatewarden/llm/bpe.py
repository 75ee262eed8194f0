"""What the token operators share: a byte-level BPE vocabulary, and where a text may be cut without changing its tokens.

A text's pre-tokens hold white space only as their first character or as nothing but white space. So a white-space
character after another character always begins a pre-token, whatever surrounds it, and pre-tokens from there on depend
only on what follows. Encoding the two sides of such a *stable* place apart gives the tokens of the whole.
"""

from __future__ import annotations

import json
import re

#: Unicode's White_Space, which the pre-tokenizer's \\s stands for.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Marks that, after a letter, begin a pre-token too: none holds a letter before such a mark, and no special token may.
MARKS = ".,;:!?"
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: Pieces of a text that end at stable places.
PIECE = re.compile(f"[{WHITE}]*[{LATIN}]+(?=[{MARKS}{WHITE}])|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
FIRST_STABLE = re.compile(f"[^{WHITE}](?=[{WHITE}])")
LAST_STABLE = re.compile(f".*[^{WHITE}](?=[{WHITE}])", re.DOTALL)
#: The pre-token pattern of this kind of vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in a vocabulary file, to the bytes they stand for."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Token bytes to ids and special strings to ids of a byte-level BPE file in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        kind = (model.get("pre_tokenizer") or {}).get("type"), model.get("normalizer"), model["model"].get("ignore_merges")
        if kind[0] != "ByteLevel" or kind[1] is not None or kind[2] or model["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        of = byte_characters()
        self.special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        if any(re.search(f"[{WHITE}{MARKS}]", s) for s in self.special):
            raise ValueError(f"{path}: special tokens with white space or {MARKS}")
        if any(a != b and a in b or any(a.endswith(b[:k]) for k in range(1, len(b))) for a in self.special for b in self.special):
            raise ValueError(f"{path}: special tokens that overlap")
        self.ids = {bytes(of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in self.special}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}

    def encoding(self):
        """A compiled encoder of the same vocabulary; ids rise in the order of merges, so they serve as ranks."""
        import tiktoken

        return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=self.ids, special_tokens=self.special)


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """Loaded once a process."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
