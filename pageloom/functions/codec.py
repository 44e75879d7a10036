"""Byte codecs: sparse bit sets, URL templates, big-endian numbers, patch-map entries. Plain Python for vectorised UDFs."""

from __future__ import annotations

import base64
import struct

# Branch factor by its two-bit code, and the greatest depth of each.
BRANCHES = (2, 4, 8, 32)
DEPTHS = {2: 31, 4: 16, 8: 11, 32: 7}


class Bits:
    """Numbers of a fixed number of bits, the least significant first, in bytes."""

    def __init__(self, data: bytes = b""):
        self.value, self.size, self.at = int.from_bytes(data, "little"), 8 * len(data), 0

    def put(self, value: int, width: int) -> None:
        self.value |= value << self.size
        self.size += width

    def take(self, width: int) -> int:
        if self.at + width > self.size:
            raise ValueError("the bit set ends early")
        out = (self.value >> self.at) & ((1 << width) - 1)
        self.at += width
        return out

    def data(self) -> bytes:
        return self.value.to_bytes((self.size + 7) // 8, "little")


def _encode_tree(values: list[int], branch: int) -> bytes:
    """Header (code of the branch factor, depth), then the nodes of the tree by level; a node of zeros stands for a full subtree."""
    depth = 1
    while branch**depth <= values[-1]:
        depth += 1
    if depth > DEPTHS[branch]:
        raise ValueError("the tree is too deep")
    out = Bits()
    out.put(BRANCHES.index(branch) | depth << 2, 8)
    level = [(0, values)]
    for d in range(depth, 0, -1):
        width, below = branch ** (d - 1), []
        for start, held in level:
            if len(held) == width * branch:
                out.put(0, branch)
                continue
            mask, parts = 0, {}
            for v in held:
                parts.setdefault((v - start) // width, []).append(v)
            for k in sorted(parts):
                mask |= 1 << k
                below.append((start + k * width, parts[k]))
            out.put(mask, branch)
        level = below
    return out.data()


def encode_set(values, branch: int | None = None) -> bytes:
    """The sparse bit set of non-negative integers; without a branch factor the shortest one's."""
    values = sorted(set(values))
    if not values:
        return bytes([0])
    if branch:
        return _encode_tree(values, branch)
    tries = [_encode_tree(values, b) for b in BRANCHES if b ** DEPTHS[b] > values[-1]]
    return min(tries, key=len)


def decode_set(data: bytes) -> tuple[list[int], int]:
    """(values, number of bytes read)."""
    if not data:
        raise ValueError("the bit set ends early")
    head = data[0]
    branch, depth = BRANCHES[head & 3], head >> 2 & 31
    if depth == 0:
        return [], 1
    if depth > DEPTHS[branch]:
        raise ValueError("the tree is too deep")
    bits, out = Bits(data[1:]), []
    level = [0]
    for d in range(depth, 0, -1):
        width, below = branch ** (d - 1), []
        for start in level:
            mask = bits.take(branch)
            if mask == 0:
                out.extend(range(start, start + width * branch))
            elif d == 1:
                out.extend(start + k for k in range(branch) if mask >> k & 1)
            else:
                below.extend(start + k * width for k in range(branch) if mask >> k & 1)
        level = below
    return sorted(out), 1 + (bits.at + 7) // 8


# Opcodes of URL templates.
OP_ID32, OP_D1, OP_D4, OP_ID64 = 128, 129, 132, 133


def patch_url(template: bytes, number: int) -> str:
    """Expand a template: runs of literals, the patch number in base32hex or base64url, its digits from the end."""
    raw = number.to_bytes(4, "big").lstrip(b"\0") or b"\0"
    short = base64.b32hexencode(raw).decode().rstrip("=")
    out, at = [], 0
    while at < len(template):
        op = template[at]
        at += 1
        if 0 < op < 128:
            if at + op > len(template):
                raise ValueError("the template ends early")
            out.append(template[at : at + op].decode("latin-1"))
            at += op
        elif op == OP_ID32:
            out.append(short)
        elif OP_D1 <= op <= OP_D4:
            k = op - OP_D1 + 1
            out.append(short[-k] if k <= len(short) else "_")
        elif op == OP_ID64:
            out.append(base64.urlsafe_b64encode(raw).decode().replace("=", "%3D"))
        else:
            raise ValueError(f"invalid opcode: {op}")
    return "".join(out)


def unsigned(value: int, width: int) -> bytes:
    """Big-endian, of `width` bytes; too large a value is an error."""
    return value.to_bytes(width, "big")


def fixed(value: float) -> bytes:
    """16.16 fixed point."""
    return struct.pack(">i", round(value * 65536))


def read_fixed(data: bytes) -> float:
    return struct.unpack(">i", data)[0] / 65536


def axis_segment(tag: str, start: float, end: float) -> bytes:
    return tag.encode("ascii") + fixed(start) + fixed(end)


def read_axis_segment(data: bytes) -> tuple[str, float, float]:
    start, end = read_fixed(data[4:8]), read_fixed(data[8:12])
    if end < start:
        raise ValueError("a range ends before it starts")
    return data[:4].decode("ascii"), start, end


def entry_deltas(last: int, numbers: list[int]) -> bytes:
    """Patch numbers as signed 24-bit differences to one past the number before, doubled; odd ones say that another follows."""
    out = b""
    for i, n in enumerate(numbers):
        delta = 2 * (n - (last + 1))
        if i + 1 < len(numbers):
            delta += 1 if delta >= 0 else -1
        out += delta.to_bytes(3, "big", signed=True)
        last = n
    return out


def biased_set(codepoints: list[int]) -> tuple[int, bytes]:
    """(bytes of bias, encoding): codepoints less the smallest one that 0, 2 or 3 bytes hold, whichever is shortest."""
    tries = []
    for width in (0, 2, 3):
        bias = min(min(codepoints), (1 << 8 * width) - 1)
        tries.append((width, (unsigned(bias, width) if width else b"") + encode_set([c - bias for c in codepoints])))
    return min(tries, key=lambda t: len(t[1]))


# Bits of an entry's format byte.
FEATURES_BIT, CHILDREN_BIT, DELTA_BIT, ENCODING_BIT, IGNORED_BIT = 1, 2, 4, 8, 64
BIAS_BITS = {0: 0x10, 2: 0x20, 3: 0x30}


def entry(last: int, codepoints=(), features=(), axes=(), children=(), conjunctive=False, numbers=(), encoding=None, ignored=False) -> bytes:
    """One entry of a patch map: its format byte and the fields that it names."""
    numbers = list(numbers)
    delta = len(numbers) > 1 or (numbers and numbers[0] != last + 1)
    width, cps = biased_set(list(codepoints)) if codepoints else (0, b"")
    out = bytes(
        [
            (FEATURES_BIT if features or axes else 0) | (CHILDREN_BIT if children else 0) | (DELTA_BIT if delta else 0) | (ENCODING_BIT if encoding is not None else 0)
            | (BIAS_BITS[width] if codepoints else 0) | (IGNORED_BIT if ignored else 0)
        ]
    )
    if features or axes:
        out += unsigned(len(features), 1) + b"".join(f.encode("ascii") for f in features)
        out += unsigned(len(axes), 2) + b"".join(axis_segment(*a) for a in axes)
    if children:
        if len(children) > 127:
            raise ValueError("more than 127 children")
        out += bytes([len(children) | (128 if conjunctive else 0)]) + b"".join(unsigned(c, 3) for c in children)
    if delta:
        out += entry_deltas(last, numbers)
    if encoding is not None:
        out += unsigned(encoding, 1)
    return out + cps
