"""Tokenizer access inside tasks: a bounded memo of words in front of the tokenizers library."""

from __future__ import annotations

import os
import re
from array import array

from gridweft.llm.common import kept

#: Separators that every tokenizer used here drops and never builds a token across.
_SPLIT = re.compile(r"[ \t-\r]+")
_CONTROL = re.compile("[\x1c-\x1f]")
_LOADED: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load(path: str):
    """The tokenizer of a file, once per Python worker, truncation and padding unused."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _LOADED[path] = tokenizer
    return _LOADED[path]


def drops_space(tokenizer) -> bool:
    """Whether white space always separates tokens and leaves none itself, so words can be encoded apart."""
    probe = "ab cd\n ef\t\x0b\x0c\rgh 12  x."
    whole = tokenizer.encode(probe, add_special_tokens=False).ids
    return whole == [i for w in probe.split() for i in tokenizer.encode(w, add_special_tokens=False).ids]


def words(text: str) -> list[str]:
    """Runs between white space; str.split also cuts at \\x1c-\\x1f, which tokenizers keep."""
    return [w for w in _SPLIT.split(text) if w] if _CONTROL.search(text) else text.split()


def has_control(text: str) -> bool:
    return bool(_CONTROL.search(text))


def is_space(char: str) -> bool:
    return char.isspace() and not _CONTROL.match(char)


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: Latin-1 words fall into runs of letters, single digits and runs of marks, as the splitter cuts them.
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(f"[{_LETTERS}]+|[{_DIGITS}]|[^{_LETTERS}{_DIGITS}]+")


class WordMemo:
    """render(ids) of the words of texts, each distinct word encoded once per worker.

    At most `limit` words are kept, none of over 64 characters; others are encoded again
    whenever they come.
    Only for tokenizers of which drops_space holds. The normalizer and the splitter leave no
    doubt about printable Latin-1 words without apostrophes (which may start contractions) and special
    tokens, so their pieces go straight to the library's BPE model; all other words go
    through the whole tokenizer.
    """

    def __init__(self, path: str, render, limit: int = 1_200_000):
        self.tokenizer, self.render, self.limit = load(path), render, limit
        if not drops_space(self.tokenizer):
            raise ValueError(f"{path}: tokens depend on white space, so words can't be encoded apart")
        self.memo: dict[str, object] = {}
        self.pieces: dict[str, list[int]] = {}
        self.alphabet = _byte_alphabet()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        probe = "Straße9\xb5!?x12\xbd_"
        self.direct = self._direct(probe) == self._whole([probe])[0]

    def _direct(self, word: str) -> list[int]:
        out, known, model, alphabet = [], self.pieces, self.tokenizer.model, self.alphabet
        for piece in _PIECES.findall(word.lower()):
            ids = known.get(piece)
            if ids is None:
                ids = [t.id for t in model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(alphabet))]
                if len(known) < self.limit // 8:
                    known[piece] = ids
            out += ids
        return out

    def _whole(self, items: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(items, add_special_tokens=False)]

    def lookup(self, items: list[str]) -> list:
        out = list(map(self.memo.get, items))
        if None in out:
            missing = {w for w, found in zip(items, out, strict=True) if found is None}
            found = self._fill(missing)
            if len(self.memo) < self.limit:
                self.memo.update((w, x) for w, x in found.items() if len(w) <= 64)
            out = [found[w] if x is None else x for w, x in zip(items, out, strict=True)]
        return out

    def _fill(self, missing: set[str]) -> dict:
        found, slow, render = {}, [], self.render
        for w in missing:
            if self.direct and w.isprintable() and (w.isascii() or max(w) <= "\xff") and "'" not in w and not ("<" in w and any(t in w for t in self.special)):
                found[w] = render(self._direct(w))
            else:
                slow.append(w)
        if slow:
            found.update(zip(slow, map(render, self._whole(slow)), strict=True))
        return found


def as_array(code: str):
    """render: ids as the bytes of an array of this type code."""
    return lambda ids: array(code, ids).tobytes()


def memo(path: str, code: str) -> WordMemo:
    """The worker's memo of a tokenizer, across tasks."""
    return kept(("ids", path, code), lambda: WordMemo(path, as_array(code)))
