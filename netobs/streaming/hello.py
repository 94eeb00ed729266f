"""Bytes of one CRYPTO stream until its hello is whole."""

from __future__ import annotations


class HelloParts:
    """Fragments by offset, later ones over earlier ones; gives the hello once and starts over.

    A session idle for more than ``idle`` seconds is forgotten.
    """

    def __init__(self, idle: int):
        self.idle, self.last = idle, None
        self.parts: list[tuple[int, bytes]] = []

    def _whole(self, size: int) -> bytes | None:
        """The first ``size`` bytes once fragments cover them all."""
        data, end = bytearray(size), 0
        for off, part in sorted(self.parts, key=lambda x: x[0]):
            if off > end:
                break
            end = max(end, off + len(part))
        if end < size:
            return None
        for off, part in self.parts:
            part = part[: max(0, size - off)]
            data[off : off + len(part)] = part
        return bytes(data)

    def add(self, sec: int, fragments) -> bytes | None:
        if self.last is not None and sec - self.last > self.idle:
            self.parts = []
        self.last = sec
        self.parts += [(int(off), bytes(part)) for off, part in (_pair(f) for f in (fragments if fragments is not None else [])) if len(part)]
        head = self._whole(4)
        if head is None or head[0] != 1:
            return None
        hello = self._whole(4 + int.from_bytes(head[1:], "big"))
        if hello is not None:
            self.parts, self.last = [], None
        return hello

    __call__ = add

    def dump(self) -> tuple[int | None, list[tuple[int, bytes]]]:
        return self.last, self.parts

    def load(self, last: int | None, parts) -> None:
        self.last, self.parts = last, [(int(off), bytes(part)) for off, part in parts]


def _pair(fragment) -> tuple[int, bytes]:
    """Offset and bytes of a fragment, a mapping or a pair."""
    return (fragment["off"], fragment["bytes"]) if isinstance(fragment, dict) else tuple(fragment)
