"""Token ids of public tokenizer files.

A byte-level BPE file of the tokenizers library is read once a task; its merges are applied by
tiktoken, which gives the same ids several times faster (a test compares them). A text that holds
a special token's string goes to the tokenizers library itself, as do JSON files of any other kind. Files of
tiktoken ranks are read as they are.
"""

from __future__ import annotations

import base64
import json


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level BPE files: printable Latin-1 characters
    stand for themselves, the others follow from code point 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """encode(text) -> ids, add_special_tokens=False."""

    def __init__(self, path: str):
        if path.endswith(".tiktoken"):
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
            self.special: list[str] = []
            self.fast = self._of(ranks)
            return
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.slow = Tokenizer.from_file(path)
        self.special = [t["content"] for t in self.spec.get("added_tokens") or []]
        self.fast = self._ranks() if self._is_byte_bpe() else None

    def _is_byte_bpe(self) -> bool:
        pre = self.spec.get("pre_tokenizer") or {}
        return self.spec["model"].get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not self.spec.get("normalizer") and not self.spec.get("post_processor")

    def _ranks(self):
        alphabet = _byte_alphabet()
        return self._of({bytes(alphabet[c] for c in t): i for t, i in self.spec["model"]["vocab"].items() if t not in self.special})

    @staticmethod
    def _of(ranks: dict[bytes, int]):
        import public_tokenizers
        import tiktoken

        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
