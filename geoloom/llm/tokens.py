"""Token ids under a byte-level BPE file of the ``tokenizers`` library.

The ids are those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.
For ordinary text they come from ``tiktoken`` over the same file's vocabulary, whose
ranks are the ids (several times faster, and equal id by id); a text that holds one
of the file's added tokens is encoded by ``tokenizers`` itself.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np

_LOADED: dict = {}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level BPE files use, by the rule that defines them."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """A function from text to its ids (uint32), loaded once for each process."""
    if path not in _LOADED:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {x["content"] for x in spec.get("added_tokens", [])}
        letters = byte_alphabet()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        slow = Tokenizer.from_file(path)

        def encode(text: str) -> np.ndarray:
            if any(x in text for x in added):
                return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            return np.asarray(fast.encode_to_numpy(text), dtype=np.uint32) if text else np.empty(0, dtype=np.uint32)

        _LOADED[path] = encode
    return _LOADED[path]
