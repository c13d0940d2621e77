"""Pure-Python record parsers for FASTQ and FASTA bytes; the Spark readers run them per file or per split."""

from __future__ import annotations

import gzip
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import chain

_STRIP = b" \t\n\r\v\f\x1c\x1d\x1e\x1f"


class FormatError(ValueError):
    """Malformed input, with the place where it was noticed."""


def inflate(data: bytes) -> bytes:
    """Gzip by its magic bytes, all members; anything after them is an error."""
    if data[:2] != b"\x1f\x8b":
        return data
    try:
        return gzip.decompress(data)
    except (OSError, EOFError, zlib.error) as e:
        raise FormatError(f"not a whole gzip file: {e}") from e


#: Bytes of a file that are read at once.
PIECE = 4 << 20


def pieces(f, size: int = PIECE) -> Iterator[bytes]:
    """The bytes of an open file, a piece at a time; gzip by its magic bytes is inflated on the way, with the errors of `inflate`."""
    head = f.read(size)
    if head[:2] != b"\x1f\x8b":
        while head:
            yield head
            head = f.read(size)
        return
    f.seek(0)
    try:
        whole = gzip.GzipFile(fileobj=f)
        while head := whole.read(size):
            yield head
    except (OSError, EOFError, zlib.error) as e:
        raise FormatError(f"not a whole gzip file: {e}") from e


def _joined(data: Iterable[bytes]) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of pieces moved to line ends, so that no line is cut; a \\r at the end of a piece waits for its \\n."""
    at, held = 0, []
    for piece in data:
        if held and held[-1][-1:] == b"\r":
            piece = held.pop() + piece
        cut = max(piece.rfind(b"\n"), piece.rfind(b"\r", 0, max(0, len(piece) - 1))) + 1
        if cut:
            whole = b"".join([*held, piece[:cut]])
            yield at, whole
            at, held = at + len(whole), []
        if cut < len(piece):
            held.append(piece[cut:])
    if held:
        yield at, b"".join(held)


def lines(data: bytes | Iterable[bytes]) -> Iterator[tuple[int, bytes]]:
    """(offset, line) with any of \\n, \\r\\n and \\r as the end; of bytes, or of the pieces of a file one after the other."""
    if not isinstance(data, bytes):
        for base, part in _joined(data):
            for at, line in lines(part):
                yield base + at, line
        return
    at, n = 0, len(data)
    if b"\r" not in data:
        while at < n:
            end = data.find(b"\n", at)
            end = n if end < 0 else end
            yield at, data[at:end]
            at = end + 1
        return
    while at < n:
        a, b = data.find(b"\n", at), data.find(b"\r", at)
        end = min(x for x in (a, b, n) if x >= 0)
        yield at, data[at:end]
        at = end + (2 if data[end : end + 2] == b"\r\n" else 1)


class _Rows:
    """Lines with a look at those that follow; at() is the place of the next one, or the end."""

    def __init__(self, data: bytes | Iterable[bytes]):
        self.rows, self.ahead, self.end = lines(self._measured(data)), deque(), 0

    def _measured(self, data: bytes | Iterable[bytes]) -> Iterator[bytes]:
        for piece in (data,) if isinstance(data, bytes) else data:
            self.end += len(piece)
            yield piece

    def get(self, k: int) -> bytes | None:
        while len(self.ahead) <= k:
            row = next(self.rows, None)
            if row is None:
                return None
            self.ahead.append(row)
        return self.ahead[k][1]

    def at(self) -> int:
        return self.ahead[0][0] if self.get(0) is not None else self.end

    def skip(self, k: int = 1) -> None:
        for _ in range(k):
            self.ahead.popleft()


def parse_fastq(data: bytes | Iterable[bytes], first: int = 0, base: int = 0) -> Iterator[tuple[str, str, str]]:
    """(title, sequence, quality); wrapped records are joined, a quality ends by its length, so @ may begin its lines.

    data is all bytes, or pieces of them of which no more than a record and a piece are held. `first` and `base` number the records
    and bytes of a split inside its file.
    """
    rows, record = _Rows(data), first

    def fail(message: str, at: int) -> FormatError:
        return FormatError(f"{message} (record {record}, byte offset {base + at})")

    while (line := rows.get(0)) is not None:
        at = rows.at()
        if not line.strip(_STRIP):
            rows.skip()
            continue
        if line[:1] != b"@":
            raise fail("Records in Fastq files should start with '@' character", at)
        title = line[1:].rstrip(_STRIP)
        after = rows.get(4)
        if rows.get(3) is not None and rows.get(2)[:1] == b"+" and (after is None or after[:1] == b"@"):  # four plain lines
            seq, plus, qual = rows.get(1).rstrip(_STRIP), rows.get(2)[1:].rstrip(_STRIP), rows.get(3).rstrip(_STRIP)
            if len(seq) == len(qual) and (not plus or plus == title) and not (b" " in seq or b"\t" in seq) and rows.get(1)[:1] != b"+":
                yield title.decode("latin-1"), seq.decode("latin-1"), qual.decode("latin-1")
                record += 1
                rows.skip(4)
                continue
        rows.skip()
        seq_parts = []
        while (line := rows.get(0)) is not None and line[:1] != b"+":
            seq_parts.append(line.rstrip(_STRIP))
            rows.skip()
        seq = b"".join(seq_parts)
        if line is None:
            raise fail("End of file without quality information." if seq else "Unexpected end of file", rows.end)
        plus = line[1:].rstrip(_STRIP)
        if plus and plus != title:
            raise fail("Sequence and quality captions differ.", rows.at())
        rows.skip()
        if b" " in seq or b"\t" in seq:
            raise fail("Whitespace is not allowed in the sequence.", at)
        if rows.get(0) is None:
            raise fail("Unexpected end of file", rows.end)
        parts, size = [], 0
        while (line := rows.get(0)) is not None and not (line[:1] == b"@" and size >= len(seq)):
            parts.append(line.rstrip(_STRIP))
            size += len(parts[-1])
            rows.skip()
        if size != len(seq):
            raise fail(f"Lengths of sequence and quality values differs for {title.decode('latin-1')} ({len(seq)} and {size}).", at)
        yield title.decode("latin-1"), seq.decode("latin-1"), b"".join(parts).decode("latin-1")
        record += 1


def fastq_tables(data: Iterable[bytes], rows: int, base: int = 0) -> Iterator[tuple[list[str], list[str], list[str]]]:
    """(titles, sequences, qualities) of at most `rows` records each, from the pieces of a file or split that begins at a record.

    A piece is taken up to its last start of a plain record and read by offsets if it holds nothing but such records; from the first
    one that does not, all is parsed line by line. What was read before a bad record is given out before the error.
    """
    data, buf, seen = iter(data), b"", 0
    last = False
    while not last:
        piece = next(data, None)
        last = piece is None
        buf += piece or b""
        cut = len(buf) if last else fastq_start(buf, max(0, len(buf) - PIECE // 4), False)
        if not cut and not last and len(buf) < 4 * PIECE:
            continue
        plain = plain_fastq(buf[:cut]) if cut else None
        if plain is None:
            break
        for i in range(0, len(plain[0]), rows):
            yield tuple(x[i : i + rows] for x in plain)
        seen, base, buf = seen + len(plain[0]), base + cut, buf[cut:]
    if not buf:
        return
    held: list[tuple[str, str, str]] = []
    try:
        size = 0
        for r in parse_fastq(chain([buf], data), seen, base):
            held.append(r)
            size += 2 * len(r[1])
            if len(held) == rows or size > PIECE:
                yield tuple(map(list, zip(*held)))
                held, size = [], 0
    except FormatError:
        if held:
            yield tuple(map(list, zip(*held)))
        raise
    if held:
        yield tuple(map(list, zip(*held)))


def fastq_start(data: bytes, at: int, whole: bool = True) -> int | None:
    """The first line at or after `at` where a plain record of four lines starts, or the end; a line starts after a newline only.

    @ is a legal quality and may stand inside a title, so a start needs @, any, +, and equal lengths on the lines that follow.
    With whole false, more bytes follow data: None says that they are needed to tell.
    """
    if at:
        at = data.find(b"\n", at - 1) + 1
        if at == 0:
            return len(data) if whole else None
    while at < len(data):
        ends, p = [], at
        for _ in range(4):
            e = data.find(b"\n", p)
            if e < 0 and not whole:
                return None
            e = len(data) if e < 0 else e
            ends.append((p, e))
            p = min(e + 1, len(data))
        seq, plus, qual = (data[a:b].rstrip(_STRIP) for a, b in ends[1:])
        if data[at : at + 1] == b"@" and plus[:1] == b"+" and len(seq) == len(qual):
            return at
        at = ends[0][1] + 1
    return len(data) if whole else None


def plain_fastq(data: bytes) -> tuple[list[str], list[str], list[str]] | None:
    """(titles, sequences, qualities) if data is nothing but records of four plain lines, found by newline offsets; else None."""
    import numpy as np

    buf = np.frombuffer(data, np.uint8)
    if len(buf) == 0 or b"\r" in data or b"\t" in data or b"\v" in data or b"\f" in data:
        return None
    end = np.flatnonzero(buf == 10)
    if buf[-1] != 10:
        end = np.append(end, len(buf))
    if len(end) % 4:
        return None
    start = np.concatenate([[0], end[:-1] + 1]).reshape(-1, 4)
    end = end.reshape(-1, 4)
    size = end - start
    if (size[:, [0, 2]] < 1).any() or (size[:, 1] != size[:, 3]).any() or (size[:, 2] != 1).any() or (size[:, 1] < 1).any():
        return None
    if (buf[start[:, 0]] != 64).any() or (buf[start[:, 2]] != 43).any() or (buf[start[:, 1]] == 43).any():
        return None
    spaces = np.concatenate([[0], np.cumsum(buf <= 32)])
    if (spaces[end[:, [1, 3]]] != spaces[start[:, [1, 3]]]).any() or (buf[end[:, 0] - 1] <= 32).any():
        return None
    text = data.decode("latin-1")
    a, b = start.tolist(), end.tolist()
    return [text[x[0] + 1 : y[0]] for x, y in zip(a, b)], [text[x[1] : y[1]] for x, y in zip(a, b)], [text[x[3] : y[3]] for x, y in zip(a, b)]


def parse_fasta(data: bytes | Iterable[bytes]) -> Iterator[tuple[str, str]]:
    """(title, sequence) of bytes or of pieces of them, a record held at a time; lines before the first > are skipped, spaces removed, tabs and ; kept."""
    title, parts = None, []
    for _, line in lines(data):
        if line[:1] == b">":
            if title is not None:
                yield title, b"".join(parts).replace(b" ", b"").decode("latin-1")
            title, parts = line[1:].rstrip(_STRIP).decode("latin-1"), []
        elif title is not None:
            parts.append(line.rstrip(_STRIP))
    if title is not None:
        yield title, b"".join(parts).replace(b" ", b"").decode("latin-1")


def key_of(title: str) -> tuple[str, str]:
    """(name, description): the first word of a title and the rest of it, trimmed."""
    words = title.split(None, 1)
    return (words[0] if words else "", words[1].strip() if len(words) > 1 else "")


def fasta_index(data: bytes) -> list[tuple[str, int, int, int, int, bool]]:
    """(name, length, offset, line_bases, line_width, strided) of each record."""
    out = []
    name, offset, sizes, widths = None, 0, [], []

    def close() -> None:
        if name is not None:
            even = len(set(sizes[:-1])) <= 1 and (not sizes[:-1] or sizes[-1] <= sizes[0]) and len(set(widths[:-1])) <= 1
            out.append((name, sum(sizes), offset, sizes[0] if sizes else 0, widths[0] if widths else 0, even))

    rows = list(lines(data))
    for i, (at, line) in enumerate(rows):
        after = rows[i + 1][0] if i + 1 < len(rows) else len(data)
        if line[:1] == b">":
            close()
            name, offset, sizes, widths = key_of(line[1:].decode("latin-1"))[0], after, [], []
        elif name is not None:
            sizes.append(len(line.rstrip(_STRIP).replace(b" ", b"")))
            widths.append(after - at)
    close()
    return out
