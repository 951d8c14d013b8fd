"""Token ids of whole texts with a public byte-level BPE file in the tokenizers format.

The file's vocabulary and merges run in the tiktoken library's engine, several times faster than in
the tokenizers library, whenever the file is one that both treat alike: plain byte-level
splitting and merges in the order of their ids. Any other file, and any text with a run too long
for that engine, is encoded by the tokenizers library itself. The ids are the same either way.
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property, lru_cache

import numpy as np

#: How a byte-level pre-tokenizer with its own pattern splits (fixed value of the public tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A piece longer than this goes to the tokenizers library.
LONG = 20_000
_RUN = re.compile(r"\S{%d}|\s{%d}" % (LONG, LONG))


def byte_chars() -> dict[str, int]:
    """The character that shows each byte in a byte-level vocabulary: printable Latin-1 as itself, the rest from code point 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}


def id_type(size: int) -> np.dtype:
    """The narrowest type for ids below `size`."""
    return np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")


def _size(spec: dict) -> int:
    return 1 + max([*spec["model"]["vocab"].values(), *(a["id"] for a in spec.get("added_tokens", []))], default=-1)


@lru_cache(maxsize=2)
def vocabulary_size(path: str) -> int:
    """One more than the highest id, without an engine."""
    with open(path, encoding="utf-8") as f:
        return _size(json.load(f))


class Encoder:
    """encode(texts): for each text its ids, as bytes of `dtype`, little-endian. The tokenizers library loads its own form of the file only for a text that needs it."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.size = _size(spec)
        self.dtype = id_type(self.size)
        self.added = {a["id"]: a["content"] for a in spec.get("added_tokens", [])}
        self.engine = self._engine(spec)

    @cached_property
    def tok(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(self.path)
        tok.encode_special_tokens = True
        return tok

    def _engine(self, spec: dict):
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not spec.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not model.get("dropout") and not model.get("ignore_merges")
        if not plain:
            return None
        chars, special = byte_chars(), {a["content"] for a in spec.get("added_tokens", [])}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merged = [model["vocab"]["".join(p)] for p in pairs]
        words = {t: i for t, i in model["vocab"].items() if t not in special}
        if merged != sorted(merged) or len(words) != len(merged) + 256 or any(c not in chars for t in words for c in t):
            return None
        import tiktoken

        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={bytes(chars[c] for c in t): i for t, i in words.items()}, special_tokens={})

    def _slow(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.engine is None:
            return [self._slow(t or "") for t in texts]
        fast, dtype = self.engine.encode_to_numpy, self.dtype
        return [b"" if not t else self._slow(t) if len(t) >= LONG and _RUN.search(t) else fast(t, disallowed_special=()).astype(dtype).tobytes() for t in texts]


    def token_bytes(self) -> list[bytes]:
        """The bytes of each id of a byte-level vocabulary."""
        if self.engine is not None:
            return [self.added[i].encode() if i in self.added else self.engine.decode_single_token_bytes(i) for i in range(self.size)]
        chars, out = byte_chars(), [b""] * self.size
        for token, i in self.tok.get_vocab(with_added_tokens=True).items():
            out[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)
