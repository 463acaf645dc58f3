"""Tokenization with a given byte-level vocabulary; nothing is trained here."""

from __future__ import annotations

import base64
import os
import re
from array import array

import numpy as np
import tiktoken

#: Default vocabulary file; every operator that tokenizes takes another as ``vocab``.
VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where no white space follows white space the look-ahead changes nothing, and without it splitting takes half the time.
_SIMPLE = PATTERN.replace(r"|\s+(?!\S)", "")
_OTHER_SPACES = "\t\v\f\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_SPACES = f"[ \n{_OTHER_SPACES}]"
#: Between a run of white space and its last character, where something else follows: there a pre-token always ends.
_CUT = re.compile(f"(?<={_SPACES})(?={_SPACES}[^ \n{_OTHER_SPACES}])")
_loaded: dict[str, "Tokenizer"] = {}


class Tokenizer:
    """Exact encoding with the vocabulary's pattern; texts are cut where its look-ahead would matter and then split without it."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        name = os.path.basename(path)
        self.encoding = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._simple = tiktoken.Encoding(name + "-simple", pat_str=_SIMPLE, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        self.ends_mark, self.ends_line, self.begins_white = (np.zeros(len(self.length), bool) for _ in range(3))
        for token, i in ranks.items():
            self.length[i] = len(token)
            self.ends_mark[i] = token[-1:] in (b".", b"!", b"?")
            self.ends_line[i] = token[-1:] == b"\n"
            self.begins_white[i] = token[:1] in (b" ", b"\t", b"\r", b"\n")

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        encode, out = self._simple.encode_ordinary, []
        for text in texts:
            if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(c in text for c in _OTHER_SPACES):
                ids = array("I")
                for part in _CUT.split(text):
                    ids.extend(encode(part))
            else:
                ids = array("I", encode(text))
            out.append(ids.tobytes())
        return out


def tokenizer(path: str = VOCAB) -> Tokenizer:
    """One per process and vocabulary."""
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]
