"""LZW as TIFF has it: codes of 9 to 12 bits, most significant bit first, widened one code early."""

from __future__ import annotations

#: Fixed values of the format: the code that empties the table, the code that ends, the widest code.
CLEAR, END, WIDEST = 256, 257, 12


def decode(data: bytes) -> bytes:
    out, table, width, held, bits, before = [], [], 9, 0, 0, None
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == END:
            break
        if code == CLEAR:
            table, width, before = start.copy(), 9, None
            continue
        if before is None:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("not LZW data")
            entry = table[code] if code < len(table) else before + before[:1]
            table.append(before + entry[:1])
        out.append(entry)
        before = entry
        if len(table) >= (1 << width) - 1 and width < WIDEST:
            width += 1
    return b"".join(out)


def encode(data: bytes) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    put(CLEAR)
    table, after, word = {bytes([i]): i for i in range(256)}, END + 1, b""
    for byte in data:
        longer = word + bytes([byte])
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = after
        after += 1
        word = longer[-1:]
        if after == 1 << width:
            width += 1
        if after >= (1 << WIDEST) - 2:
            put(table[word])
            word = b""
            put(CLEAR)
            table, after, width = {bytes([i]): i for i in range(256)}, END + 1, 9
    if word:
        put(table[word])
        after += 1
        if after == 1 << width and width < WIDEST:
            width += 1
    put(END)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)
