"""Exact, cached tokenization with the tokenizers library.

Text is cut only where the tokenizer's own pre-tokenizer always cuts (before a blank that precedes
a visible character; at white space, for vocabularies that drop it), each distinct piece is encoded
once per worker, and the pieces' ids are joined.  A new piece that is one word of Latin letters, with or without
marks after it, goes straight to the tokenizer's model; others go through the whole tokenizer.  The result equals
``Tokenizer.encode`` of the whole text; a text that holds a special token's string is encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the unit of parallelism

#: Pieces a worker keeps; when full, the cache starts anew.  A memory bound, not a limit on what is encoded.
CACHE_PIECES = 1_200_000
#: Longer pieces are encoded each time.
CACHE_CHARS = 48

#: Text that pieces are looked up for together.
GROUP_CHARS = 1 << 19
#: A blank or line end beside something that may be white space (E1-E3 and EF start some), or a byte that marks cuts.
_ODD = re.compile(rb" (?![!-~\xc3-\xdf])|(?<![!-~])\n|\n(?![!-~\xc3-\xdf])|[\0\x01]")
_BEFORE_BLANK = re.compile(rb"(?= [!-~\xc3-\xdf])")
#: Bytes of visible ASCII, blanks, line ends and of characters U+00C0 to U+07FF: the only white space there is blanks and line ends.
_KNOWN = bytes([10, 32, *range(33, 127), *range(0x80, 0xC0), *range(0xC3, 0xE0)])
#: Letters A-Z, a-z and those of Latin-1 in UTF-8, then marks.
_WORD = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,;:!?]*)")
#: A piece that starts with this follows a line end, not a blank.
_LINE = b"\x01"


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: visible ones for themselves, the rest from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


_LETTERS = _byte_letters()
_TO_LETTERS = dict(enumerate(_LETTERS))

_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _is_odd(data: bytes) -> bool:
    """White space that is not one blank or line end between visible characters, or bytes that mark cuts."""
    if data.translate(None, _KNOWN):
        return _ODD.search(data) is not None
    return b"  " in data or b"\n\n" in data or b" \n" in data or b"\n " in data or data[:1] == b"\n" or data[-1:] in (b" ", b"\n")


class Encoder:
    """``ids(text)`` gives little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        state = json.loads(self.tokenizer.to_str())
        pre = state.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [pre])
        added = state.get("added_tokens") or []
        plain = not any(a.get("normalized") for a in added)  # else their strings cannot be looked for in the text as it is
        self.special = re.compile(b"|".join(re.escape(a["content"].encode()) for a in added)) if added else None
        self.keeps_blank = plain and state.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.drops_blank = plain and any(s.get("type") == "Split" and s.get("invert") and s.get("behavior") == "Removed" for s in steps)
        normalizers = [n.get("type") for n in (state.get("normalizer") or {}).get("normalizers", [])]
        # what a word of letters becomes before the model: the file's steps must be those known here
        self.direct = self.keeps_blank or (self.drops_blank and normalizers == ["NFC", "Replace", "Lowercase"] and [s.get("type") for s in steps] == ["Split", "ByteLevel"])
        # a mark that is a token of its own between pieces: a line end, or a control character as a word
        self.mark, self.mark_byte = ("\n", b"\n") if self.keeps_blank else (" \x01 ", b"\x01")
        self.mark_id = self.tokenizer.encode(self.mark, add_special_tokens=False).ids[-1]
        self.model = self.tokenizer.model
        self.line_end = self.encode("\n")
        self.marks: dict[bytes, bytes] = {}  # short runs of marks after a word
        self.cache: dict[bytes, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _pieces(self, text: str | None) -> list[bytes] | None:
        """Pieces whose ids, joined, are those of the text; None if it must be encoded whole.

        Where blanks are kept, a piece without a mark in front follows a blank; one that starts with _LINE
        follows a line end; the first and those of odd texts start with a zero byte and are literal.
        """
        data = (text or "").encode("utf-8", "replace")
        if self.special and self.special.search(data):
            return None
        if self.drops_blank:
            return data.split()
        if not self.keeps_blank:
            return None
        if _is_odd(data):
            return [b"\0" + p for p in _BEFORE_BLANK.split(data)] if b"\0" not in data and _LINE not in data else None
        if not data:
            return []
        cut = data.replace(b"\n", b" \x01").split(b" ")
        cut[0] = b"\0" + cut[0] if cut[0] else b"\0"
        return cut

    def _literal(self, piece: bytes) -> tuple[bytes, bytes]:
        """(ids in front, text) of a piece: a line end before a visible character is a token of its own."""
        if not self.keeps_blank:
            return b"", piece
        if piece[:1] == _LINE:
            return self.line_end, piece[1:]
        return b"", piece[1:] if piece[:1] == b"\0" else b" " + piece

    def _word(self, word: bytes, blank: bool) -> bytes:
        """Ids of one word of letters, from the model."""
        if not self.keeps_blank:
            word = word.lower() if word.isascii() else word.decode("utf-8").lower().encode("utf-8")
        text = word.decode("latin-1")
        if not word.isascii():
            text = text.translate(_TO_LETTERS)
        if blank and self.keeps_blank:
            text = _LETTERS[32] + text
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _simple(self, piece: bytes) -> bytes | None:
        """Ids of a word of letters with marks after it; None for any other piece."""
        blank = not self.keeps_blank or piece[:1] not in (_LINE, b"\0")
        found = _WORD.fullmatch(piece, 0 if blank else 1)
        if not found:
            return None
        word, marks = found.groups()
        key = word if blank else b"\0" + word
        ids = self.cache.get(key)
        if ids is None:
            ids = self._word(word, blank)
            if len(key) <= CACHE_CHARS:
                self.cache[key] = ids
        if marks:
            tail = self.marks.get(marks)
            if tail is None:
                tail = self.encode(marks.decode())
                if len(marks) < 5:  # at most 1,554 kinds
                    self.marks[marks] = tail
            ids += tail
        return self.line_end + ids if piece[:1] == _LINE and not blank else ids

    def _learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Encode pieces that the cache lacks: words by the model, the rest in one call, a mark of one known id between them."""
        got: dict[bytes, bytes] = {}
        new: list[tuple[bytes, bytes, str]] = []
        odd: list[tuple[bytes, bytes, str]] = []
        if len(self.cache) + len(pieces) > CACHE_PIECES:
            self.cache.clear()
        cache, simple = self.cache, self._simple if self.direct else lambda p: None
        plain, blank, tokenize = self.direct and self.keeps_blank, _LETTERS[32], self.model.tokenize
        for p in dict.fromkeys(pieces):
            if plain and p.isalpha():  # letters A-Z and a-z after a blank: what _simple makes of them, at once
                got[p] = ids = array("I", [t.id for t in tokenize(blank + p.decode("ascii"))]).tobytes()
                if len(p) <= CACHE_CHARS:
                    cache[p] = ids
                continue
            ids = simple(p)
            if ids is not None:
                got[p] = ids
                if len(p) <= CACHE_CHARS:
                    cache[p] = ids
                continue
            front, text = self._literal(p)
            (odd if not text or self.mark_byte in text else new).append((p, front, text.decode("utf-8", "replace")))
        got |= {p: front + self.encode(text) for p, front, text in odd}
        if new:
            text = self.mark.join([text for _, _, text in new])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.mark_id)
            data, at = ids.tobytes(), 0
            for (p, front, _), end in zip(new, [*ends.tolist(), len(ids)], strict=True):
                got[p] = front + data[4 * at : 4 * end]
                at = end + 1
        cache.update((p, got[p]) for p, _, _ in chain(new, odd) if len(p) <= CACHE_CHARS)
        return got

    def _group(self, texts: list[str | None]) -> list[bytes]:
        cut = [self._pieces(t) for t in texts]
        whole = {i: self.encode((texts[i] or "").encode("utf-8", "replace").decode("utf-8")) for i, c in enumerate(cut) if c is None}
        cut = [c or [] for c in cut]
        pieces = cut[0] if len(cut) == 1 else list(chain.from_iterable(cut))
        got = list(map(self.cache.get, pieces))
        if None in got:
            missing = [i for i, x in enumerate(got) if x is None]
            learned = self._learn([pieces[i] for i in missing])
            for i in missing:
                got[i] = learned[pieces[i]]
        ends = list(accumulate(map(len, cut), initial=0))
        return [whole[i] if i in whole else b"".join(got[a:b]) for i, (a, b) in enumerate(zip(ends, ends[1:]))]

    def ids_of(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text, in order; texts are looked up in groups of bounded size."""
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t or "") + 64
            if size >= GROUP_CHARS:
                yield from self._group(held)
                held, size = [], 0
        if held:
            yield from self._group(held)

    def ids(self, text: str | None) -> bytes:
        return self._group([text])[0]
