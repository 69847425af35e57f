"""Tokenizer pieces: texts split as the tokenizer splits them, with each piece encoded once and kept.

Both tokenizers encode a text piece by piece, so the ids of a text are those of its pieces. The split
is repeated here only for texts of common characters (tab, line feed, carriage return, printable ASCII,
Latin letters up to U+017F) without the special tokens' strings; any other text goes to the library
as a whole. The ids of a piece always come from the library.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
import types
from array import array
from collections.abc import Iterable

import numpy as np

KEPT = 300_000
"""Pieces kept at most while a task runs."""
HOT = 120_000
"""Pieces kept at most from task to task."""
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
# The tokenizers' split patterns with \\p{L}, \\p{N} and \\s written out for the common characters.
L, N, S = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾", r"\t\n\r \xa0"
SPLIT = {
    BYTE_BPE: re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"),
    WORD_BPE: re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"),
}
UNCOMMON = re.compile(r"[^\t\n\r\x20-\x7e\xa0-ſ]")
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
LONG = 200
"""Pieces of more characters are not kept."""
JOINED = 2000


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def version(path: str) -> str:
    """Digest of the tokenizer's file and of the library that reads it."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


class Encoder(dict):
    """Pieces to their ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        self.before = np.empty(0, np.int64)  # hashes of the pieces that the task before met
        self.tokenizer = load(path)
        name = os.path.basename(path)
        self.split = SPLIT.get(name)
        self.lower = name == WORD_BPE
        if self.lower:  # the last token of a word is marked, so many words can be encoded in one call
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        out = self.whole(piece)
        if len(piece) <= LONG:
            self[piece] = out
        return out

    def learn(self, pieces: list[str]) -> None:
        """Encodes new pieces of the word tokenizer, many in a call."""
        for i in range(0, len(pieces), JOINED):
            part = pieces[i : i + JOINED]
            ids = self.whole(" ".join(part))
            cuts = [0, *((np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 1) * 4).tolist()]
            if len(cuts) == len(part) + 1:  # else they are encoded one by one when they are met
                self.update(zip(part, (ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each whole text, 4 bytes each; nulls count as empty."""
        if len(self) > KEPT:
            self.settle()
        texts = [t or "" for t in texts]
        pieces = [None if self.split is None or UNCOMMON.search(t) or "<|" in t and any(x in t for x in SPECIAL) else self.split.findall(t.lower() if self.lower else t) for t in texts]
        found = [x and list(map(self.get, x)) for x in pieces]
        # one look-up a piece: those not known yet are filled in once they are learned
        gaps = [x and [i for i, ids in enumerate(x) if ids is None] for x in found]
        if self.lower:
            self.learn(list({p[i] for p, g in zip(pieces, gaps, strict=True) if g for i in g if len(p[i]) <= LONG}))
        for x, p, g in zip(found, pieces, gaps, strict=True):
            for i in g or ():
                x[i] = self[p[i]]
        return [b"".join(x or ()) if p is not None else self.whole(t) for t, p, x in zip(texts, pieces, found, strict=True)]

    def settle(self) -> None:
        """Keeps the pieces that were met both before the last settling and since: the common ones."""
        met = np.fromiter(map(hash, self), np.int64, len(self))
        common = np.isin(met, self.before)
        self.before = met
        kept = [x for x, hot in zip(self.items(), common.tolist(), strict=True) if hot][:HOT]
        self.clear()
        self.update(kept)


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer: later tasks of a worker find the pieces of earlier ones."""
    kept = sys.modules.setdefault("_pagewright_pieces", types.ModuleType("_pagewright_pieces")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
