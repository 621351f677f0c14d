"""Token ids of whole texts with a public tokenizer file."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

DEFAULT_TOKENIZER = "word_bpe_49k.json"
END_ID = 1
ID_BYTES = 4
END = END_ID.to_bytes(ID_BYTES, "little")
#: Special token of the default tokenizer that parts pieces.
MARK = "<|endoftext|>"


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """Path of a public tokenizer file (asked for where the task runs)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _marked(chars: bytes) -> np.ndarray:
    """Which of the 256 byte values are among ``chars``."""
    return np.isin(np.arange(256), list(chars))


BLANK = _marked(b" \t\n\x0b\x0c\r")
STOP = _marked(b",.;:!?")
LETTER_OR_DIGIT = np.array([chr(i).isascii() and chr(i).isalnum() for i in range(256)])


def stops_apart(raw: bytes) -> bytes:
    """``raw`` with a blank before every stop that ends a piece after an ASCII letter or digit."""
    a = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(STOP[a[1:]]) + 1
    at = at[LETTER_OR_DIGIT[a[at - 1]]]
    if len(at) and at[-1] == len(a) - 1:
        at = np.append(at[:-1][BLANK[a[at[:-1] + 1]]], at[-1])
    else:
        at = at[BLANK[a[at + 1]]]
    return np.insert(a, at, 32).tobytes() if len(at) else raw


class WordEncoder:
    """Encodes texts piece by piece between ASCII blanks, remembering pieces.

    The default tokenizer collapses white space and never builds a token across it,
    and no composition crosses a blank, so the ids of a text are the ids of
    its blank-separated pieces in order (tests compare with whole-text
    encoding). It also lower-cases and splits a stop from the word before
    it, so pieces are looked up in lower case without a closing stop, unless
    the text holds a combining mark or the opening of a special token. Other
    white space stays inside a piece and is left to the tokenizer. The first
    ``max_pieces`` different pieces are remembered; later ones are encoded
    each time. New pieces are encoded side by side, parted by a special token,
    which the tokenizer cuts out of a text before anything else. Another
    tokenizer file is given whole texts.
    """

    def __init__(self, tokenizer: str = DEFAULT_TOKENIZER, max_pieces: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        path = tokenizer if os.path.isabs(tokenizer) else tokenizer_path(tokenizer)
        self.tok = Tokenizer.from_file(path)
        self.max_pieces = max_pieces
        self.by_piece = os.path.basename(path) == DEFAULT_TOKENIZER
        self.mark = self.tok.token_to_id(MARK) if self.by_piece else None
        self.known: dict[bytes, bytes] = {}

    def _pieces(self, text: str | None) -> list[bytes]:
        if not text:
            return []
        raw = text.encode("utf-8")
        if b"<|" not in raw and b"\xcc" not in raw and b"\xcd" not in raw:
            raw = stops_apart(raw).lower()
        return raw.split()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _side_by_side(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces that hold no opening of a special token."""
        ids = np.array(self.tok.encode_batch_fast([MARK.join(p.decode("utf-8") for p in pieces)], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(ids == self.mark) * ID_BYTES).tolist() + [ids.nbytes]
        raw, at, out = ids.tobytes(), 0, {}
        for piece, end in zip(pieces, ends, strict=True):
            out[piece] = raw[at:end]
            at = end + ID_BYTES
        return out

    def encode(self, texts) -> list[bytes]:
        """Ids of each text (None: empty) as little-endian unsigned 32-bit integers, end id last."""
        if not self.by_piece:
            return [raw + END for raw in self._whole([t or "" for t in texts])]
        split = [self._pieces(t) for t in texts]
        new = list(set().union(*split).difference(self.known)) if split else []
        odd = [p for p in new if b"<|" in p]
        ids = dict(zip(odd, self._whole([p.decode("utf-8") for p in odd])))
        if odd:
            new = [p for p in new if b"<|" not in p]
        for i in range(0, len(new), 512):
            ids.update(self._side_by_side(new[i:i + 512]))
        # pieces beyond the bound are known for these texts only
        spare = list(ids)[max(self.max_pieces - len(self.known), 0):]
        self.known.update(ids)
        out = [b"".join(map(self.known.__getitem__, pieces)) + END for pieces in split]
        for piece in spare:
            del self.known[piece]
        return out


def id_width(tokenizer: str = DEFAULT_TOKENIZER) -> int:
    """Bytes that any id of a tokenizer file needs: 2 or 4."""
    return 2 if max(max(encoder(tokenizer).tok.get_vocab(with_added_tokens=True).values()), END_ID) < 1 << 16 else 4


@lru_cache(maxsize=2)
def encoder(tokenizer: str = DEFAULT_TOKENIZER) -> WordEncoder:
    """The encoder of this Python worker; its memory serves later tasks too."""
    return WordEncoder(tokenizer)
