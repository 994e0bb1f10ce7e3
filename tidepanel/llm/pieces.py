"""The piece table of a SentencePiece model file, read on the driver.

The table is bounded by the model (tens of thousands of pieces), so it may travel
in closures and broadcasts.  Pieces and scores are used as a unigram model:
of all ways to cut a word into pieces the one with the greatest sum of scores is
taken, of equal ones that with the longest last piece, and so on backwards.  A
character that is no piece of its own scores ``UNKNOWN`` below the least score and
becomes one byte piece for each of its UTF-8 bytes.

Texts are treated as the model asks: no normalization, spaces become U+2581, and a
non-empty text gets one in front.  No piece has U+2581 after another character, so
texts fall into words (U+2581s and what follows) that no piece crosses.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = 10.0


@dataclass(frozen=True)
class Pieces:
    text: tuple[str, ...]  # by id
    score: tuple[float, ...]
    normal: tuple[int, ...]  # ids of ordinary pieces
    byte: tuple[int, ...]  # id of each byte's piece

    @property
    def unknown(self) -> float:
        return min(self.score[i] for i in self.normal) - UNKNOWN

    @property
    def longest(self) -> int:
        return max(len(self.text[i]) for i in self.normal)

    def neighbours(self) -> np.ndarray:
        """Every two code points that stand side by side in an ordinary piece, as sorted numbers; no piece crosses others."""
        return np.array(sorted({ord(a) << 32 | ord(b) for i in self.normal for a, b in zip(self.text[i], self.text[i][1:], strict=False)}), np.uint64)


def load(path: str = MODEL) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = range(model.get_piece_size())
    text = tuple(model.id_to_piece(i) for i in n)
    byte = dict((text[i], i) for i in n if model.is_byte(i))
    normal = tuple(i for i in n if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)))
    if any(not re.fullmatch(f"{MARK}*[^{MARK}]*", text[i]) for i in normal):
        raise ValueError("a piece crosses words")
    return Pieces(text, tuple(model.get_score(i) for i in n), normal, tuple(byte[f"<0x{b:02X}>"] for b in range(256)))
