"""Byte-level BPE identifiers of whole texts."""

from __future__ import annotations

import base64
import json
import re
from array import array


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens() -> dict[str, int]:
    """The added tokens of the given tokenizers file, which it takes out of a text before anything else."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    for token in found:
        if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
            raise ValueError(f"the added token {token['content']} isn't matched literally")
    return {token["content"]: token["id"] for token in found}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit identifiers.

    A text is one call of the tokenizer, and nothing is remembered between texts:
    time and memory follow the text alone, however many different words there are.
    ``added`` tokens are found first, and what stands between them is encoded
    apart; without any, such strings are ordinary text.
    """

    def __init__(self, path: str, added: dict[str, int] | None = None) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # the token is never allowed, so it is ordinary text; with no special token at all, an empty one is looked for at each byte
        self._encoding = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)}
        )
        self._added = {a: array("I", [i]).tobytes() for a, i in (added or {}).items()}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")") if added else None

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._split and any(map(text.__contains__, self._added)):
            return b"".join(self._added[part] if k % 2 else self._plain(part) for k, part in enumerate(self._split.split(text)))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        return self._encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
