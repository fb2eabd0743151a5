"""Token ids by the ``tokenizers`` library, each distinct piece encoded once.

No pre-token of the two vocabularies crosses the gap between a non-space
character and the white space after it, so a text's ids are those of its pieces
in order. Pieces repeat, so a bounded per-worker memo saves most of the work;
texts whose white space could be read differently in pieces go through whole:
runs of spaces or line ends, and other white space followed by one of them. So do
texts with the literal of an added token (``<|endoftext|>``), which has an id of its own.
"""
from __future__ import annotations

import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # Spark's tasks are the parallelism

from array import array  # noqa: E402

import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from .textkit import held  # noqa: E402

MEMO_ENTRIES = 700_000        # pieces a worker remembers, about 190 MB
LONGEST_PIECE = 40            # characters; longer ones are not remembered
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_MIXED_RUN = re.compile(f"[{''.join(_OTHER_SPACE)}][ \n]")


def _mixed_space(text: str) -> bool:
    """Whether other white space stands before a space or a line end."""
    return any(c in text for c in _OTHER_SPACE) and _MIXED_RUN.search(text) is not None


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as one printable character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


_LETTERS = _byte_letters()


class Encoder(dict):
    """``ids(text)``: little-endian uint32 token ids of the whole text, as bytes.

    The mapping itself is the memo: piece -> ids, filled by ``__missing__``.
    """

    def __init__(self, name: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.keeps_space = name.startswith("byte_bpe")     # white space has ids of its own
        self.marks = {m: self.whole(m) for m in ".,"}

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > LONGEST_PIECE:
            return self.whole(" " + piece if self.keeps_space and piece[0] != "\n" else piece)
        if piece and max(piece) < "\u0100" and piece.isalpha():   # one pre-token, nothing to normalise but case
            plain = piece if self.keeps_space else piece.lower()
            shown = plain if plain.isascii() else plain.encode().decode("latin-1").translate(_LETTERS)
            got = array("I", [t.id for t in self.model.tokenize("Ġ" + shown if self.keeps_space else shown)]).tobytes()
        elif piece[-1:] in self.marks and piece[:-1].isalpha():   # letters end a pre-token
            got = self[piece[:-1]] + self.marks[piece[-1]]
        else:
            got = self.whole(" " + piece if self.keeps_space and piece[:1] != "\n" else piece)
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        self[piece] = got
        return got

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(t in text for t in self.added):
            return self.whole(text)
        if not self.keeps_space:
            return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))
        if "\n\n" in text or "  " in (marked := text.replace("\n", " \n")) or _mixed_space(text):
            return self.whole(text)
        head, _, rest = marked.partition(" ")
        if not _:
            return self.whole(head)
        return self.whole(head) + b"".join(map(self.__getitem__, rest.split(" ")))


def encoder(name: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    return held(f"encoder {name}", lambda: Encoder(name))
