"""Overlapping text pieces, run inside Arrow batches."""

from __future__ import annotations

# --- fixed values: splitter defaults and separators, strongest first ----------
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
SEPARATORS = ("\n\n", "\n", " ", "")
# --- end of fixed values --------------------------------------------------------


def _cut(text: str, separator: str) -> list[str]:
    """Pieces of ``text``; each piece but the first starts with the separator."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [piece for piece in (head, *(separator + r for r in rest)) if piece]


def _pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Join neighbours up to ``size``, each result repeating at most ``overlap`` characters."""
    ends = [0]
    for piece in pieces:
        ends.append(ends[-1] + len(piece))
    packed, first = [], 0
    for i in range(len(pieces)):
        # pieces[first:i] is the current run; ends gives its length in O(1).
        if ends[i + 1] - ends[first] > size and i > first:
            packed.append("".join(pieces[first:i]))
            while first < i and (
                ends[i] - ends[first] > overlap or ends[i + 1] - ends[first] > size
            ):
                first += 1
    if first < len(pieces):
        packed.append("".join(pieces[first:]))
    return [text for text in (p.strip() for p in packed) if text]


def split_text(
    text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators=SEPARATORS
) -> list[str]:
    """Pieces of at most ``size`` characters cut at the strongest separator present."""
    level = next(i for i, s in enumerate(separators) if s in text)
    weaker = separators[level + 1 :]
    result, run = [], []
    for piece in _cut(text, separators[level]):
        if len(piece) < size:
            run.append(piece)
            continue
        result += _pack(run, size, overlap)
        run = []
        result += split_text(piece, size, overlap, weaker) if weaker else [piece]
    return result + _pack(run, size, overlap)
