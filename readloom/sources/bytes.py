"""Byte-level reading: lines and bytes up to any delimiter, and the LZW format of .Z files."""

from __future__ import annotations


class ByteReader:
    """A stream (see sources.files.opened) read by line, by count or by look-ahead."""

    def __init__(self, stream, size: int = 1 << 16):
        self.stream, self.size, self.data, self.i = stream, size, b"", 0

    def _fill(self, least: int) -> bool:
        """At least so many bytes ahead, if the stream has them."""
        while len(self.data) - self.i < least:
            more = self.stream.read(self.size)
            if not more:
                return False
            self.data, self.i = self.data[self.i :] + more, 0
        return True

    def line(self, delimiter: bytes = b"\n") -> bytes | None:
        """The bytes before the next delimiter (or the end), which is passed; None at the end of the stream."""
        seen = self.i
        while (at := self.data.find(delimiter, seen)) < 0:
            ahead = len(self.data) - self.i
            if not self._fill(ahead + 1):
                rest, self.i = self.data[self.i :], len(self.data)
                return rest or None
            seen = self.i + max(ahead - len(delimiter) + 1, 0)
        out, self.i = self.data[self.i : at], at + len(delimiter)
        return out

    def skip_line(self, delimiter: bytes = b"\n") -> bool:
        return self.line(delimiter) is not None

    def read(self, n: int) -> bytes:
        self._fill(n)
        out = self.data[self.i : self.i + n]
        self.i += len(out)
        return out

    def skip(self, n: int) -> int:
        """Bytes passed, fewer than n at the end."""
        done = 0
        while done < n:
            got = len(self.read(min(n - done, self.size)))
            if not got:
                break
            done += got
        return done

    def peek(self, n: int = 1) -> bytes:
        self._fill(n)
        return self.data[self.i : self.i + n]


def uncompress(data: bytes) -> bytes:
    """The content of a .Z file: LZW codes of 9 to (at most) 16 bits, least significant bit first.

    Codes come in groups of eight; a change of width, and a cleared table, leave out the rest of a group.
    """
    if data[:2] != b"\x1f\x9d":
        raise ValueError("no .Z data")
    widest, block = data[2] & 31, bool(data[2] & 128)
    table: list[bytes] = [bytes([i]) for i in range(256)] + ([b""] if block else [])
    width, bit, group = 9, 24, 24  # group: the bit at which codes of this width began
    out, last = [], b""
    total = len(data) * 8
    while bit + width <= total:
        at = bit >> 3
        code = (int.from_bytes(data[at : at + 4], "little") >> (bit & 7)) & ((1 << width) - 1)
        bit += width
        if block and code == 256:
            table = table[:257]
            bit += -(bit - group) % (width * 8)
            width, group, last = 9, bit, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("broken .Z data")
        out.append(entry)
        if last and len(table) < 1 << widest:
            table.append(last + entry[:1])
            if len(table) == 1 << width and width < widest:
                bit += -(bit - group) % (width * 8)
                width, group = width + 1, bit
        last = entry
    return b"".join(out)
