"""Token ids of a public tokenizer, one pre-token at a time.

The two files' pre-tokenizers cut a text into pieces that the model encodes on their own. Texts of common
Latin characters are cut by the same expressions here, and a piece goes to the library's model once and to a
cache from then on; every other text, every text that holds an added token of the file, and every other file, goes
the library's whole way. tests/llm/test_operators.py holds this against the library on whole texts.
"""

from __future__ import annotations

import json
import os
import re

#: Longer pieces are encoded, not cached. A cache of CACHE pieces becomes the old one, which is asked before a
#: piece is encoded again.
LONG, CACHE = 48, 500_000
#: Characters about whose class and case all regular expressions agree; the letters among them.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
_OTHER = re.compile("[^\t\n\r -~À-įı-ſ–—‘’“”…€]")
_BYTE_LEVEL = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_WORD_END = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
#: What the second file says of its own cut.
_WORD_END_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


class _Pieces(dict):
    """Ids of pieces, filled on demand."""

    def __init__(self, model):
        super().__init__()
        self.model, self.old, self.letters = model, {}, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            written = (piece if piece.isascii() else piece.encode().decode("latin-1")).translate(self.letters)
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(written)])
        if len(piece) <= LONG:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes: those of the library's encode without its own special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = _Pieces(self.tokenizer.model)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added = [t["content"] for t in file.get("added_tokens") or () if t["content"]]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        cut = file.get("pre_tokenizer") or {}
        self.lower, self.cut = False, None
        if cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not file.get("normalizer"):
            self.cut = _BYTE_LEVEL
        elif [x.get("pattern", {}).get("Regex") for x in cut.get("pretokenizers", [])[:1]] == [_WORD_END_CUT]:
            self.lower, self.cut = True, _WORD_END

    @staticmethod
    def shared(path: str) -> Encoder:
        """The encoder of this process for that file: a Python worker keeps its cache from task to task."""
        import tokenizers

        # Functions reach executors by value, each time with globals of their own; the library's module is one for all.
        kept = vars(tokenizers).setdefault("_folioflow_encoders", {})
        if path not in kept:
            kept[path] = Encoder(path)
        return kept[path]

    def plain(self, text: str) -> bytes:
        """The library's whole way."""
        import numpy as np

        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.cut or _OTHER.search(text) or (self.added and self.added.search(text)):
            return self.plain(text)
        return b"".join(map(self.pieces.__getitem__, self.cut.findall(text.lower() if self.lower else text)))
