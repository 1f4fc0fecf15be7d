"""The boolean range coder: a writer and a reader with one call, ``code(bit, prob)``."""

from __future__ import annotations


class Writer:
    """Writes bits; the probability is that of a 0 in 256ths."""

    def __init__(self):
        self.out, self.low, self.range, self.room = bytearray(), 0, 255, 24

    def code(self, bit: int, prob: int) -> int:
        split = 1 + ((self.range - 1) * prob >> 8)
        if bit:
            self.low += split
            self.range -= split
        else:
            self.range = split
        shift = 8 - self.range.bit_length()
        if shift:
            self.range <<= shift
            self._shift(shift)
        return bit

    def _shift(self, n: int) -> None:
        self.low <<= n
        self.room -= n
        if self.room > 0:
            return
        # eight bits or more are settled, but for a carry
        over = -self.room
        top = self.low >> (24 + over)
        if top > 255:
            self._carry()
            top &= 255
        self.out.append(top)
        self.low &= (1 << (24 + over)) - 1
        self.room += 8

    def run(self, bits: list[int], probs: list[int]) -> None:
        """Many bits at once, as ``code`` would write them."""
        low, rng, room, out = self.low, self.range, self.room, self.out
        for bit, prob in zip(bits, probs, strict=True):
            split = 1 + ((rng - 1) * prob >> 8)
            if bit:
                low += split
                rng -= split
            else:
                rng = split
            if rng < 128:
                n = 8 - rng.bit_length()
                rng <<= n
                low <<= n
                room -= n
                if room <= 0:
                    top = low >> (24 - room)
                    if top > 255:
                        self._carry()
                        top &= 255
                    out.append(top)
                    low &= (1 << (24 - room)) - 1
                    room += 8
        self.low, self.range, self.room = low, rng, room

    def _carry(self) -> None:
        i = len(self.out) - 1
        while self.out[i] == 255:
            self.out[i] = 0
            i -= 1
        self.out[i] += 1

    def literal(self, value: int, n: int) -> int:
        for i in range(n - 1, -1, -1):
            self.code(value >> i & 1, 128)
        return value

    def finish(self) -> bytes:
        for _ in range(32):
            self.code(0, 128)
        return bytes(self.out)


#: How far a range has to be shifted up to reach 128.
_SHIFT = [0] + [8 - n.bit_length() for n in range(1, 256)]


class Reader:
    """Reads what a Writer wrote; beyond the end it reads zeros. ``code`` is a function of its own state, for speed."""

    def __init__(self, data: bytes):
        value, room, at, rng = int.from_bytes(data[:32].ljust(32, b"\0"), "big"), 248, 32, 255

        def code(_bit: int | None, prob: int) -> int:
            nonlocal value, room, at, rng
            split = 1 + ((rng - 1) * prob >> 8)
            edge = split << room
            if value >= edge:
                value -= edge
                rng -= split
                bit = 1
            else:
                rng = split
                bit = 0
            if rng < 128:
                n = _SHIFT[rng]
                rng <<= n
                room -= n
                if room < 0:
                    value = value << 256 | int.from_bytes(data[at : at + 32].ljust(32, b"\0"), "big")
                    room += 256
                    at += 32
            return bit

        self.code = code

    def literal(self, _value: int | None, n: int) -> int:
        out = 0
        for _ in range(n):
            out = 2 * out + self.code(None, 128)
        return out
