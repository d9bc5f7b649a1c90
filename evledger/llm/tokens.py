"""Token ids of texts with a public tokenizer file, in bounded memory."""

from __future__ import annotations

import os
import re

import numpy as np

#: Text splits before a space or line feed that follows a character that is not
#: white space.  No pre-token of a byte-level vocabulary crosses such a place, and
#: none looks behind it, so the pieces encode on their own.
_PLACE = re.compile(r"(?<=\S)(?=[ \n])")


#: Characters of the longest piece that is remembered, and what an entry takes beside its characters and ids.
LONGEST, ENTRY = 64, 180


def pieces(text: str) -> list[str]:
    """The text cut where its tokens never join; joined they are the text."""
    return _PLACE.split(text)


def _quick(text: str) -> list[str]:
    """As `pieces` if no part but the last ends with white space."""
    if "\x00" in text:
        return pieces(text)
    return text.replace(" ", "\x00 ").replace("\n", "\x00\n").split("\x00")


def _gaps(row: list[bytes | None]) -> list[int]:
    """Places of None."""
    places, at = [], -1
    try:
        while True:
            at = row.index(None, at + 1)
            places.append(at)
    except ValueError:
        return places


class Encoder:
    """Encodes with a byte-level ``tokenizers`` file and remembers pieces.

    Words repeat, so most pieces come from the memory; new ones are encoded by
    the library, many in one string that is cut again by the tokens' byte
    lengths.  The result is that of encoding the whole text.  The memory holds about
    ``remember`` bytes, no piece of more than `LONGEST` characters; it starts anew when most
    of what comes is not in it.
    """

    def __init__(self, path: str, remember: int = 96 << 20) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if "ByteLevel" not in type(self.tokenizer.pre_tokenizer).__name__ or self.tokenizer.normalizer:
            raise ValueError("pieces join exactly only under byte-level pre-tokens without a normalizer")
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.bytes_in = np.zeros(self.size, np.int64)  # a token of bytes is spelt with one character each
        self.bytes_in[list(vocabulary.values())] = list(map(len, vocabulary))
        self.remember = remember
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _each(self, new: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        return {piece: np.array(x.ids, self.dtype).tobytes() for piece, x in zip(new, found)}

    def _joined(self, new: list[str]) -> dict[str, bytes]:
        """As `_each`, for pieces that start and do not end with white space."""
        found: dict[str, bytes] = {}
        wide = self.dtype.itemsize
        groups = [new[at : at + 256] for at in range(0, len(new), 256)]
        encodings = self.tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)
        for group, encoding in zip(groups, encodings):
            ids = np.array(encoding.ids, self.dtype)
            ends = np.cumsum([len(piece.encode()) for piece in group])
            cuts = np.searchsorted(np.cumsum(self.bytes_in[ids]), ends) + 1
            raw = ids.tobytes()
            start = 0
            for piece, cut in zip(group, (cuts * wide).tolist()):
                found[piece] = raw[start:cut]
                start = cut
        return found

    def _new(self, wanted: set[str]) -> dict[str, bytes]:
        """Encodes pieces that are not in the memory, and remembers them."""
        joins = [p for p in wanted if p[:1] in (" ", "\n") and not p[-1].isspace()]
        found = self._joined(joins)
        kept = {piece: ids for piece, ids in found.items() if len(piece) <= LONGEST}
        size = ENTRY * len(kept) + 4 * sum(map(len, kept)) + sum(map(len, kept.values()))
        if self.held + size <= self.remember:
            self.known.update(kept)
            self.held += size
        return found | self._each(list(wanted.difference(found)))

    def parts(self, texts: list[str], with_cuts: bool = False):
        """Ids of the pieces of each text, as bytes of `dtype`; with the pieces if asked."""
        rows: list[list[bytes]] = []
        cuts: list[list[str]] = []
        open_rows: list[tuple[int, list[str], list[int]]] = []
        wanted: set[str] = set()
        seen = missed = 0
        for n, text in enumerate(texts):
            cut = _quick(text)
            row = list(map(self.known.get, cut))
            if None in row:
                places = _gaps(row)
                new = [cut[i] for i in places]
                if any(p[-1:].isspace() for p in new):  # only such places may be wrong, and they are never known
                    cut = pieces(text)
                    row = list(map(self.known.get, cut))
                    places = _gaps(row)
                    new = [cut[i] for i in places]
                wanted.update(new)
                missed += len(new)
                open_rows.append((n, cut, places))
            seen += len(cut)
            rows.append(row)
            if with_cuts:
                cuts.append(cut)
        found = self._new(wanted)
        for n, cut, places in open_rows:
            row = rows[n]
            for i in places:
                row[i] = found[cut[i]]
        if self.held * 10 > self.remember * 9 and 2 * missed > seen:
            self.known, self.held = {}, 0
        return (rows, cuts) if with_cuts else rows

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes of `dtype`."""
        return [b"".join(row) for row in self.parts(texts)]
