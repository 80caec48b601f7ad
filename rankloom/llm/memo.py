"""A bounded memo from repeated pieces of text to their packed ids."""

from __future__ import annotations

from collections.abc import Callable, Sequence


class Generation(dict):
    """Known pieces; one that is looked up in vain comes from the generation before or gets a place to be filled later."""

    def __init__(self, old: dict):
        self.old, self.lacking = old, []

    def __missing__(self, piece):
        ids = self.old.get(piece)
        if ids is None:
            ids = bytearray()
            self.lacking.append(piece)
        self[piece] = ids
        return ids


class PieceMemo:
    """Two generations: when the young one is full it becomes the old one; pieces still in use come back.

    ``encode`` gets the distinct pieces that neither generation holds. Pieces
    longer than ``longest`` are encoded each time, so the memo's size is bounded.
    """

    def __init__(self, encode: Callable[[list], list[bytes]], most: int, longest: int = 64):
        self.encode, self.most, self.longest = encode, most, longest
        self.young = Generation({})

    def join(self, lists: Sequence[Sequence]) -> list[bytes]:
        """The concatenated ids of each list of pieces; a piece is looked up once, only unknown ones run Python."""
        if len(self.young) > self.most // 2:
            self.young.old = {}
            self.young = Generation(self.young)
        known = self.young
        found = [list(map(known.__getitem__, pieces)) for pieces in lists]
        lacking, known.lacking = known.lacking, []
        try:
            encoded = self.encode(lacking) if lacking else []
        except BaseException:
            self.young = Generation({})  # it holds places that nothing fills
            raise
        for piece, ids in zip(lacking, encoded):
            known[piece].extend(ids)
            if len(piece) > self.longest:
                del known[piece]
            else:
                known[piece] = ids
        return [b"".join(ids) for ids in found]
