"""Token ids of whole texts, with the ids of repeated parts kept in a bounded cache.

Byte-pair encoding never merges across the pre-tokenizer's boundaries, so a
text may be cut at places that always are boundaries, and each distinct part
needs encoding only once.  All cuts below are such places; texts that make one
doubtful are encoded whole.

* Byte-level vocabulary (the white space belongs to the ids): cuts before single
  spaces between two visible characters.
* Word vocabulary (lower case, white space dropped): cuts at white space.  A part
  made of letters and then ASCII symbols is two pre-tokens, so the letters are
  looked up by themselves.

Parts that are not in the cache are encoded together.  For the byte-level
vocabulary that is done by tiktoken over the merges of the same JSON file, which
takes a fifth of the time; its ids are compared with the tokenizers library's
when an encoder is made, and the library does the work if they differ.  Single
words of the word vocabulary go straight to the library's BPE model.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np

CACHE_PARTS = 450_000
CACHE_CHARS = 48
_CUT = re.compile(r"(?<=\S) (?=\S)")
_RUN = re.compile(r"\s\s")
_ODD = re.compile(r"[\x1c-\x1f]")  # white space to Python only
_TAIL = ".,!?;:*$%&#)|\"-"
_PROBE = "It's 3 o'clock,  naïve\n\n\tX_1 — 'll 漢字 éÉ   end. $$$!? \x00 <|endoftext|> aaaa\n"
_MADE: dict[tuple[str, bool], Encoder] = {}


def crc_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids written as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def _byte_alphabet() -> dict[str, int]:
    """How byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ranked(path: str):
    """tiktoken's engine over the vocabulary of a byte-level tokenizers file."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    alphabet = _byte_alphabet()
    ranks = {bytes(alphabet[c] for c in t): k for t, k in vocab.items() if all(c in alphabet for c in t) and t != "<|endoftext|>"}
    return tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Encodes whole texts to the ids of ``Tokenizer.encode(text, add_special_tokens=False)``.

    byte_level: whether white space belongs to the ids or is dropped by the pre-tokenizer.
    """

    @classmethod
    def of(cls, path: str, byte_level: bool) -> Encoder:
        """One encoder for each worker process, so its cache outlives a task."""
        key = (path, byte_level)
        if key not in _MADE:
            _MADE[key] = cls(*key)
        return _MADE[key]

    def __init__(self, path: str, byte_level: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.byte_level = byte_level
        vocab = self.tok.get_vocab()
        size = max(vocab.values(), default=0) + 1
        self.dtype = np.dtype("<u2") if size <= 65_536 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.cache: dict[str, bytes] = {}
        # Unknown parts are encoded as one text with a NUL between them, if NUL has an id that takes part in no merge.
        self.glue = "\0" if byte_level else " \0 "
        nul = self._library("\0")
        own = sum(chr(256) in t for t in vocab) <= (1 if byte_level else 2)
        self.nul = nul[0] if len(nul) == 1 and own else None
        self.written = {b: c for c, b in _byte_alphabet().items()}
        self.engine = self._library
        if byte_level:
            try:
                fast = _ranked(path).encode_ordinary
                if fast(_PROBE) == self._library(_PROBE):
                    self.engine = fast
            except ValueError:  # a vocabulary that lacks single bytes
                pass

    def _library(self, text: str) -> list[int]:
        return self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _raw(self, text: str) -> bytes:
        return np.array(self.engine(text), self.dtype).tobytes()

    def _split(self, ids: np.ndarray, stops: np.ndarray, skip: int) -> list[bytes]:
        ends = (stops * ids.itemsize).tolist()
        raw, skip = ids.tobytes(), skip * ids.itemsize
        return [raw[a:b] for a, b in zip([0] + [e + skip for e in ends[:-1]], ends)]

    def _many(self, parts: list[str]) -> list[bytes]:
        joined = self.glue.join(parts)
        if self.nul is None or joined.count("\0") != len(parts) - 1:
            return [self._raw(c) for c in parts]
        ids = np.array(self.engine(joined), self.dtype)
        return self._split(ids, np.r_[np.flatnonzero(ids == self.nul), len(ids)], 1)

    def _word(self, word: str) -> bytes:
        """A lower-case word of letters only: one pre-token, so the BPE model alone is enough."""
        own = word if word.isascii() else word.encode("utf-8", "replace").decode("latin-1").translate(self.written)
        return array(self.code, [t.id for t in self.tok.model.tokenize(own)]).tobytes()

    def _new_parts(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of lower-case parts without white space."""
        new: dict[str, bytes] = {}
        rest = []
        for part in missing:
            core = part.rstrip(_TAIL)
            if not core.isalpha():
                rest.append(part)
                continue
            ids = self.cache.get(core) or new.get(core)
            if ids is None:
                ids = new[core] = self._word(core)
            tail = part[len(core) :]
            if tail:
                end = self.cache.get(tail) or new.get(tail)
                if end is None:
                    end = new[tail] = self._raw(tail)
                new[part] = ids + end
        if rest:
            new |= zip(rest, self._many(rest))
        return new

    def _cached(self, parts: list[str], lead: str) -> list[bytes]:
        cache = self.cache
        got = list(map(cache.get, parts))
        if None in got:
            missing = list(dict.fromkeys([c for c, g in zip(parts, got) if g is None]))
            if self.byte_level:
                new = dict(zip(missing, self._many([lead + c for c in missing])))
            else:
                new = self._new_parts(missing)
            if len(cache) + len(new) > CACHE_PARTS:
                cache.clear()
            got = [new[c] if g is None else g for c, g in zip(parts, got)]
            cache.update((c, b) for c, b in new.items() if len(c) <= CACHE_CHARS)
        return got

    def encode(self, text: str | None, end_id: int) -> np.ndarray:
        """Ids of the text, then ``end_id``; a null text counts as empty."""
        end = np.array([end_id], self.dtype).tobytes()
        if not text:
            return np.frombuffer(end, self.dtype)
        if self.byte_level:
            doubt = text[0] == " " or text[-1] == " " or _RUN.search(text)
            parts = _CUT.split(text) if doubt else text.split(" ")
            out = [self._raw(parts[0]), *self._cached(parts[1:], " "), end]
        else:
            if _ODD.search(text) or "Σ" in text or not unicodedata.is_normalized("NFC", text):
                return np.frombuffer(self._raw(text) + end, self.dtype)
            out = [*self._cached(text.lower().split(), ""), end]
        return np.frombuffer(b"".join(out), self.dtype)
