"""Byte-level BPE ids of whole texts.

Where the vocabulary also lies beside the tokenizer as merge ranks, texts are encoded
from those by a faster library.  Its pattern ends in a look-ahead that only acts
inside runs of white space; a text without such a run is cut by the pattern without
it, which gives the same parts at less cost.  A text that holds the string of a
special token goes through the tokenizer itself, which gives that token's id.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from functools import lru_cache

_RUN = re.compile(r"\s\s")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Texts to ids as little-endian uint32 bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        self.fast = None
        if os.path.exists(ranks):  # the same vocabulary, merged by a faster library
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            make = lambda name, pattern: tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=table, special_tokens={})
            self.fast = make("byte_bpe", public_tokenizers.PATTERN)
            single = public_tokenizers.PATTERN.replace(r"|\s+(?!\S)|\s+", r"|\s")
            self.plain = make("byte_bpe_single", single)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.fast is None or any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        fast = self.fast if _RUN.search(text) else self.plain
        return array("I", fast.encode_ordinary(text)).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)
