"""Byte-level BPE ids.

The vocabulary is the public 50,257-entry byte-level BPE. A document's ids are
those ``tokenizers.Tokenizer.encode(text, add_special_tokens=False)`` gives for
``byte_bpe_50k.json`` (tests compare them on hostile texts). The same vocabulary
is read here as tiktoken ranks: that encoder needs a quarter of the CPU time.
"""

from __future__ import annotations

import base64
from array import array

END_OF_TEXT = "<|endoftext|>"
END_OF_TEXT_ID = 50256
MODEL = "byte_bpe_50k"


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class ByteBpe:
    """Encoder over one ranks file."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as fh:
            ranks = {base64.b64decode(tok): int(rank) for tok, rank in map(bytes.split, fh)}
        self.encoding = tiktoken.Encoding(
            MODEL, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> list[int]:
        """Ids of one text (None counts as empty); the end-of-text string is its special id."""
        if not text:
            return []
        if END_OF_TEXT not in text:
            return self.encoding.encode_ordinary(text)
        out: list[int] = []
        for k, run in enumerate(text.split(END_OF_TEXT)):
            if k:
                out.append(END_OF_TEXT_ID)
            out.extend(self.encoding.encode_ordinary(run))
        return out

    def packed(self, text: str | None) -> array:
        """The same ids as an array of unsigned 32-bit integers."""
        return array("I", self.ids(text))


_ENCODERS: dict[str, ByteBpe] = {}


def encoder(path: str | None = None) -> ByteBpe:
    """One encoder per Python worker and ranks file."""
    key = path or ranks_path()
    if key not in _ENCODERS:
        _ENCODERS[key] = ByteBpe(key)
    return _ENCODERS[key]
