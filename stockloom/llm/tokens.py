"""Token ids of whole texts by the tokenizers library, with the pieces of a text that stand alone encoded once.

Neither tokenizer lets a token cross the places where a text is cut here, so that a text's ids are those of its parts in
order. The byte-level one is cut before a single space or line break between two other characters; texts with any other
white space are encoded whole. The word one drops white space; it is cut at ASCII white space.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_PARTS = 1_200_000
# Bytes as letters, as byte-level vocabularies spell them: printable ones as they are, the others from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_HEAD = "\0"  # before a text's first part, which has no space before it


@lru_cache(4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Encodes batches of texts; keeps the ids of about ``MOST_PARTS`` parts."""

    def __init__(self, path: str, words: bool):
        self.path, self.words = path, words
        self.known: dict[bytes, bytes] = {}
        self.model = _tokenizer(path).model
        self.ends = {"": b"", **dict(zip(".,\n", self._whole([".", ",", "\n"]), strict=True))}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in _tokenizer(self.path).encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, parts: list[str]) -> list[bytes]:
        """The ids of many short parts, which are encoded joined and cut at the marks between them.

        The mark is a bar between spaces for words, else a line break: either is one id of its own there. Parts that hold the
        mark, but for a line break at their beginning, are encoded one by one.
        """
        mark, join = ("|", " | ") if self.words else ("\n", "\n")
        own = self._whole([mark])[0]
        if len(own) != 4:
            return self._whole(parts)
        got: dict[str, bytes] = {}
        body = {p: p[1:] if not self.words and p[:1] == "\n" else p for p in parts}
        lone = [p for p, x in body.items() if not x or mark in x]
        got.update(zip(lone, self._whole(lone), strict=True))
        rest = [p for p in body if p not in got]
        for at in range(0, len(rest), 2000):
            some = rest[at : at + 2000]
            raw = self._whole([join.join([body[p] for p in some])])[0]
            cut = np.flatnonzero(np.frombuffer(raw, np.uint32) == np.frombuffer(own, np.uint32)[0])
            if len(cut) != len(some) - 1:
                got.update(zip(some, self._whole(some), strict=True))
                continue
            ends = zip([0, *(4 * cut + 4).tolist()], [*(4 * cut).tolist(), len(raw)], strict=True)
            got.update((p, raw[i:j] if body[p] == p else own + raw[i:j]) for p, (i, j) in zip(some, ends, strict=True))
        return [got[p] for p in parts]

    def _letters(self, text: str) -> bytes | None:
        """The ids of a part of Latin letters, with a space or line break before it or none, and a full stop or comma after it or none.

        Letters are one run for either tokenizer, so that its model can be asked directly; other parts give None.
        """
        body = text[1:] if text[:1] in (" ", "\n") else text
        end = body[-1:] if body[-1:] in (".", ",") else ""
        core = body[:-1] if end else body
        low = core.lower() if self.words else core
        if not low.isalpha() or not core.isalpha() or not core.isascii() and max(core) >= "\u0250":
            return None
        run = (" " + low if text[:1] == " " else low).encode().decode("latin-1").translate(_BYTE_LETTERS)
        got = array("I", [t.id for t in self.model.tokenize(run)]).tobytes() + self.ends[end]
        return self.ends["\n"] + got if text[:1] == "\n" else got

    def _new(self, parts: list[str]) -> list[bytes]:
        got = list(map(self._letters, parts))
        rest = [i for i, x in enumerate(got) if x is None]
        for i, x in zip(rest, self._ids([parts[i] for i in rest]), strict=True):
            got[i] = x
        return got

    def _text(self, part: bytes) -> str:
        p = part.decode("utf-8", "replace")
        return p if self.words or p[:1] == "\n" else p[1:] if p[:1] == _HEAD else " " + p

    def _joined(self, lists: pa.ListArray) -> list[bytes]:
        """The ids of lists of parts: distinct parts are looked up or learned, then their ids are gathered in order."""
        if len(self.known) > MOST_PARTS:
            self.known.clear()
        coded = lists.flatten().view(pa.binary()).dictionary_encode()
        parts = coded.dictionary.to_pylist()
        ids = list(map(self.known.get, parts))
        new = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(new, self._new([self._text(parts[i]) for i in new]), strict=True):
            ids[i] = self.known[parts[i]] = x
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(size) - size
        at = coded.indices.to_numpy()
        many = size[at]
        stop = np.concatenate([[0], np.cumsum(many)])
        flat = np.frombuffer(b"".join(ids), np.uint32)
        raw = flat[np.arange(stop[-1]) + np.repeat(start[at] - stop[:-1], many)].tobytes()
        ends = (4 * stop[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])]).tolist()
        return [raw[i:j] for i, j in zip(ends, ends[1:], strict=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of UTF-8 texts as little-endian unsigned 32-bit integers."""
        if self.words:  # it lowers all letters, so that lowering A-Z first changes nothing but the spelling of special tokens
            low = [t if b"<|" in t else t.lower() for t in texts]
            return self._joined(pc.ascii_split_whitespace(pa.array(low, pa.binary()).view(pa.string())))
        text = [t.decode("utf-8", "replace") for t in texts]
        out: list[bytes] = [b""] * len(text)
        own = [i for i, t in enumerate(text) if t and _plain(t)]
        parts = pc.split_pattern(pa.array([_HEAD + text[i].replace("\n", " \n") for i in own], pa.string()), " ")
        for i, ids in zip(own, self._joined(parts), strict=True):
            out[i] = ids
        taken = set(own)
        odd = [i for i, t in enumerate(text) if t and i not in taken]
        for i, ids in zip(odd, self._whole([text[i] for i in odd]), strict=True):
            out[i] = ids
        return out


def _plain(t: str) -> bool:
    """Whether all white space is single spaces and single line breaks between other characters."""
    if t[0] in " \n" or t[-1] in " \n" or any(x in t for x in ("  ", "\n ", " \n", "\n\n", _HEAD)):
        return False
    return not any(c in t for c in (_ASCII_SPACES if t.isascii() else _SPACES))


_ASCII_SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_SPACES = _ASCII_SPACES + "".join(c for c in map(chr, range(0x80, 0x3001)) if c.isspace())


@lru_cache(4)
def encoder(path: str, words: bool) -> Encoder:
    """One for each worker process, so that parts stay known from task to task."""
    return Encoder(path, words)
