"""Token ids of whole texts, by the ``tokenizers`` library, with a distinct piece encoded once.

A byte-level BPE cuts a text into pre-tokens before it merges bytes. A pre-token begins at every lone
space and newline, and of a run of white space the last character stands apart; so a text is cut before
each space and newline, its pieces are encoded and the ids joined, and a piece that was seen before costs
one look-up. Where that would cut inside one pre-token (a run of three, of two at an end, or white space of
another kind) the text is encoded whole.

New pieces are encoded many at a time, as one text in which each follows a newline: a newline before a
space or a word is a token of its own, so its id shows where a piece ends. Punctuation at the end of a piece, after a Latin
letter, is a pre-token too, and its ids follow those of the word. Pieces are kept in two generations: when
the younger one is full it becomes the older, and what is asked for again moves back.
"""

from __future__ import annotations

import gc
import os
import re
import string
from array import array

import numpy as np

#: Distinct pieces a worker keeps, in both generations; the memory of a worker is bounded by it.
MAX_PIECES = 900_000
#: Longer pieces are encoded but not kept.
_KEEP_CHARS = 64
#: Pieces that are encoded as one text.
_TOGETHER = 16
_MARKS = string.punctuation
#: Different endings that a worker keeps.
_MAX_ENDINGS = 10_000
_THREE = re.compile(r"\s\s\s")
_OTHER_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f]")
#: Letters below it are Latin in every version of Unicode that a regular expression may know.
_LATIN = "\u0250"

_encoders: dict[str, PieceEncoder] = {}


class PieceEncoder:
    """Encodes lists of texts to arrays of ids."""

    def __init__(self, path: str, most: int = MAX_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype(f"u{array(self.code).itemsize}")
        self.most = most
        space, self.newline = self._encode([" ", "\n"])
        self.endings: dict[str, bytes] = {}
        # a piece stands for itself after a space, or as it is where it begins with a newline
        self.always = {"": space, "\n": self.newline}
        self.pieces, self.older = dict(self.always), {}

    def _encode(self, raw: list[str]) -> list[bytes]:
        found: list[bytes] = []
        for i in range(0, len(raw), 512):
            got = self.tokenizer.encode_batch_fast(raw[i : i + 512], add_special_tokens=False)
            found += [array(self.code, x.ids).tobytes() for x in got]
        return found

    def _encode_pieces(self, new: list[str]) -> list[bytes]:
        """Ids of pieces (neither empty nor a newline alone, no other white space inside)."""
        if not new:
            return []
        lead = ["\n " + x if x[:1] != "\n" else x for x in new]
        ids = b"".join(self._encode(["".join(lead[i : i + _TOGETHER]) for i in range(0, len(lead), _TOGETHER)]))
        width = self.dtype.itemsize
        at = np.flatnonzero(np.frombuffer(ids, self.dtype) == np.frombuffer(self.newline, self.dtype)[0]) * width
        if len(at) != len(new) or len(self.newline) != width:  # a vocabulary that joins newlines to something else
            return self._encode([x if x[:1] == "\n" else " " + x for x in new])
        ends = [*at[1:].tolist(), len(ids)]
        return [ids[a if x[:1] == "\n" else a + width : b] for x, a, b in zip(new, at.tolist(), ends, strict=True)]

    def _learn(self, missing: set[str]) -> None:
        """Adds the pieces to the younger generation."""
        known, older = self.pieces, self.older
        again = [x for x in missing if x in older]
        known.update(zip(again, map(older.__getitem__, again), strict=True))
        new, ended, needed = [], [], set()
        for x in missing.difference(again):
            y = x.rstrip(_MARKS)
            if len(y) < len(x) and y and y[-1] < _LATIN and y[-1].isalpha():
                ended.append((x, y, x[len(y) :]))
                needed.add(y)
            else:
                new.append(x)
        new += needed.difference(known, new)
        known.update(zip(new, self._encode_pieces(new), strict=True))
        if len(self.endings) > _MAX_ENDINGS:
            self.endings = {}
        ends = list({x for _, _, x in ended}.difference(self.endings))
        self.endings.update(zip(ends, self._encode(ends), strict=True))
        for x, y, end in ended:
            known[x] = known[y] + self.endings[end]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; of null none."""
        # no cycles arise here, and looking for them among the many live objects costs a tenth of the time
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode_all(texts)
        finally:
            if collects:
                gc.enable()

    def _encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        out = [b""] * len(texts)
        cut: list[tuple[int, list[str], list[bytes | None], list[int]]] = []
        missing: set[str] = set()
        whole: list[int] = []
        if len(self.pieces) > self.most // 2:
            self.pieces, self.older = dict(self.always), self.pieces
        known, skip = self.pieces, len(self.newline)
        for i, text in enumerate(texts):
            if not text:
                continue
            if text[:2].isspace() or text[-2:].isspace():
                whole.append(i)
                continue
            # the first word follows a made-up newline, whose id is dropped in the end
            parts = ("\n" + text).replace("\n", " \n").split(" ")
            del parts[0]
            if parts.count("") + parts.count("\n") > 1 and _THREE.search(text):
                whole.append(i)
                continue
            found = list(map(known.get, parts))
            gaps = [k for k, ids in enumerate(found) if ids is None] if None in found else []
            unknown = [parts[k] for k in gaps]
            if unknown and _OTHER_SPACE.search("".join(unknown).replace("\n", "")):
                whole.append(i)
                continue
            missing.update(unknown)
            cut.append((i, parts, found, gaps))
        self._learn(missing)
        for i, got in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = got
        for i, parts, found, gaps in cut:
            for k in gaps:
                found[k] = known[parts[k]]
            out[i] = b"".join(found)[skip:]
        for x in missing:
            if len(x) > _KEEP_CHARS:
                del known[x]
        return [np.frombuffer(x, self.dtype) for x in out]


def encoder(path: str | None = None) -> PieceEncoder:
    """One encoder for each Python worker and vocabulary file (by default the public BPE of 50,257 ids)."""
    path = path or default_vocabulary()
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    """The public byte-level BPE of 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
