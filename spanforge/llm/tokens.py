"""Token ids of whole texts with public tokenizer files.

``UnitEncoder`` gives exactly the ids of ``Tokenizer.encode(text)``. The two
supported vocabularies never merge across the borders of the units cut here,
so the ids of a text are the ids of its units in a row, and units that were
met before need no second encoding. A worker process keeps one encoder for all
its tasks. Its memory of units is bounded: it has two halves, the younger takes
what is met, and when it is full it becomes the older, whose units are taken
over when they are met again. Long units are kept for one text.

Texts that hold the string of a special token are encoded whole.

A null text is the empty text; it has no ids but the end id of its document.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Callable

import numpy as np

#: The white space of Unicode, which both tokenizers' patterns call \s (fixed values).
SPACE = "\t-\r \x85\xa0  -     　"
#: Letters (U+0130, whose lower case ends in a mark, is none here), and marks that no contraction
#: begins with; between the two every text is cut.
LETTER = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
MARK = "!-&(-/:-@[-`{-~"
#: A run of letters or marks or else a word, each with the one space before it; a run of white space up to the last of it; a last white space.
BYTE_UNITS = re.compile(f" ?(?:[{LETTER}]++(?![^{MARK}{SPACE}])|[{MARK}]++(?![^{LETTER}{SPACE}])|[^{SPACE}]+)|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
#: White space only divides words and leaves no ids.
WORD_UNITS = re.compile(f"[{LETTER}]++(?![^{MARK}{SPACE}])|[{MARK}]++(?![^{LETTER}{SPACE}])|[^{SPACE}]+")
#: Texts without such characters have no marks that compose with letters, and may be lower-cased before they are cut.
COMPOSING = re.compile("[̀-\U0010ffff]")
UNITS = {"byte_bpe_50k.json": BYTE_UNITS, "word_bpe_49k.json": WORD_UNITS}
#: Units that the tokenizer's own pattern leaves whole, so that its model alone gives their ids.
WHOLE = {"byte_bpe_50k.json": re.compile(f" ?(?:[{LETTER}]+|[0-9]+)"), "word_bpe_49k.json": re.compile(f"[{LETTER}]+")}
#: Both vocabularies spell bytes as characters: printable ones of Latin-1 (fixed values) as they are,
#: the others in a row from U+0100 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELLING = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
SPACE_SPELT = chr(SPELLING[ord(" ")])

MEMO_UNITS = 1_000_000
MEMO_CHARS = 48


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Memo(dict):
    """Ids of units; those it lacks are learnt."""

    def __init__(self, learn: Callable[[str], bytes]):
        self.learn = learn
        self.older: dict[str, bytes] = {}
        self.long: dict[str, bytes] = {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.older.get(unit) or self.long.get(unit) or self.learn(unit)
        if len(unit) > MEMO_CHARS:
            self.long[unit] = ids
        else:
            if len(self) >= MEMO_UNITS // 2:
                self.older = dict(self)
                self.clear()
            self[unit] = ids
        return ids


class UnitEncoder:
    """Encodes texts to little-endian unsigned ids of ``dtype``: 2 bytes where the vocabulary allows, else 4."""

    def __init__(self, path: str):
        self.tok = load_tokenizer(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        name = os.path.basename(path)
        self.units = UNITS.get(name)
        if self.units is not None:
            self.lower = self.units is WORD_UNITS
            self.is_whole = WHOLE[name].fullmatch
            self.spell = self.tok.model.tokenize
            self.raw = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.tok.get_vocab_size())]
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.memo = Memo(self._learn)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _learn(self, unit: str) -> bytes:
        if self.is_whole(unit) is None:
            return self._whole(unit)
        if self.lower:
            unit = unit.lower()
        raw = self.raw
        spelt = unit.replace(" ", SPACE_SPELT) if unit.isascii() else unit.encode().decode("latin-1").translate(SPELLING)
        return b"".join([raw[t.id] for t in self.spell(spelt)])

    def _ids(self, text: str) -> bytes:
        cut = text.lower() if self.lower and not COMPOSING.search(text) else text
        if any(x in cut for x in self.special):
            return self._whole(text)
        ids = b"".join(map(self.memo.__getitem__, self.units.findall(cut)))
        self.memo.long.clear()
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        return list(map(self._whole if self.units is None else self._ids, texts))


_encoders: dict[str, UnitEncoder] = {}


def encoder_of(path: str) -> UnitEncoder:
    """This process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def forget() -> None:
    """Lets this process's encoders and what they remember go."""
    if _encoders:
        _encoders.clear()
        gc.collect()  # an encoder and its memory refer to each other


def encoded(texts: list[str | None], encoder: UnitEncoder):
    """Yields the ids of each text in order."""
    for t in texts:
        yield from encoder.encode([t or ""])
