"""Ids of whole texts put together from the remembered ids of their words.

A blank between two marks that are no white space, and a line end between two such marks, always begin a new piece for the
byte-level pattern as well as for pieces that hold a blank at their beginning only. So a text is cut there into units; a unit
that is not yet known is encoded once and remembered. A text with longer white space, or with a unit that the encoder
does not know how to take alone, is encoded as a whole. What is remembered is bounded by bytes; beyond, it begins anew.
"""

from __future__ import annotations

from collections.abc import Callable

CACHE_BYTES = 64 << 20
ENTRY_BYTES = 350  # what a unit takes beside its text and its ids


def odd(unit: str) -> bool:
    """Whether a unit has white space at one of its ends (besides the one line end before it), so that it may not stand alone."""
    return not unit or unit[-1].isspace() or unit[0].isspace() and (unit[0] != "\n" or unit[1:2].isspace())


class Units:
    """``of(texts)``: the encoded form of each text, by ``learn(units)`` for lists of new units (None: take the whole text) and
    ``whole(text)``. Forms are joined by ``join``; a unit stands for itself with a blank before it, or with its own line end.

    With ``lead`` a blank, texts are read with one more blank before them; with a line end, as they are.
    """

    def __init__(self, learn: Callable[[list[str]], list], whole: Callable[[str], object], join: Callable[[list], object], lead: str):
        self.learn, self.whole, self.join, self.lead = learn, whole, join, lead
        self.known: dict[str, object] = {}
        self.held = 0

    def of(self, texts: list[str]) -> list:
        known = self.known
        if self.held > CACHE_BYTES:
            known.clear()
            self.held = 0
        split = [f"{self.lead}{text}".replace("\n", " \n").split(" ")[1:] for text in texts]
        new = {u for units in split for u in {*units}.difference(known)}
        refused = {u for u in new if odd(u)}
        if fresh := list(new - refused):
            for unit, form in zip(fresh, self.learn(fresh), strict=True):
                if form is None:
                    refused.add(unit)
                else:
                    known[unit] = form
                    self.held += ENTRY_BYTES + 2 * len(unit)
        get = known.__getitem__
        return [self.join(list(map(get, units))) if refused.isdisjoint(units) else self.whole(text) for text, units in zip(texts, split, strict=True)]
