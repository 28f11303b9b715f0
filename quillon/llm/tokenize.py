"""Byte-level BPE ids of texts, as the `tokenizers` library gives them for a public vocabulary file."""

from __future__ import annotations

import base64
import functools
import os

import numpy as np

SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256


class Bpe:
    """Ids of a byte-level BPE vocabulary with `add_special_tokens=False`.

    `path`: a tokenizers .json file, whose ids count. With `ranks`, the .tiktoken file of the same vocabulary and its
    split pattern, the faster library encodes; the .json file's special token is cut out first, as tokenizers does.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None) -> None:
        self.fast = None
        if ranks and pattern:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding(os.path.basename(ranks), pat_str=pattern, mergeable_ranks=table, special_tokens={})
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(path)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        if SPECIAL not in text:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)
        parts = []
        for i, piece in enumerate(text.split(SPECIAL)):
            parts += [np.array([SPECIAL_ID], np.uint32)] * (i > 0) + [self.fast.encode_to_numpy(piece, disallowed_special=()).astype(np.uint32)]
        return np.concatenate(parts)


@functools.cache
def bpe(path: str, ranks: str | None = None, pattern: str | None = None) -> Bpe:
    """One tokenizer for each worker process."""
    return Bpe(path, ranks, pattern)


def public_bpe() -> tuple[str, str, str]:
    """Arguments of `bpe` for the installed public 50k vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
