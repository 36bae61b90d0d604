"""Column functions: distances, bounds, codec sizes, and driver-side codecs."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIVERSE = 1_000_000


def l2(a: Column | str, b: Column | str) -> Column:
    """Squared distance as a left fold of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def l2_int(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("bigint"), lambda s, v: s + v)


def quantised(v: Column | str, scale: int) -> Column:
    return F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def interval_gap(a: Column | str, b: Column | str, drop: int) -> Column:
    """Least squared distance of b to any integer vector that agrees with a but for its `drop` low bits."""

    def one(x: Column, y: Column) -> Column:
        low = F.shiftleft(F.shiftright(x, drop), drop)
        gap = F.greatest(low - y, y - (low + (1 << drop) - 1), F.lit(0).cast("bigint"))
        return gap * gap

    return F.aggregate(F.zip_with(a, b, one), F.lit(0).cast("bigint"), lambda s, v: s + v)


def within(v: Column, lo: Column, hi: Column, bounds: str = "[)") -> Column:
    """NULL and NaN are in no interval; endpoints may be infinite."""
    upper = v <= hi if bounds == "[]" else v < hi
    return v.isNotNull() & ~F.isnan(v) & (v >= lo) & upper


def bins_of(v: Column, edges: list[float]) -> Column:
    """The bin of v between rising edges, the first and last of which are infinite: how many inner edges are at most v. -1 for
    null and NaN."""
    return F.when(v.isNull() | F.isnan(v), F.lit(-1)).otherwise(sum((F.when(v >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))).cast("int")


def cross_label(token: Column, offset: Column, bin_: Column, bins: int, tokens: int) -> Column:
    """A number for each pair of a token and one of all attributes' bins, after the plain tokens."""
    return (F.lit(tokens) + token * bins + offset + bin_).cast("long")


#: Fixed values of the 64-bit mixer.
MIX_ADD, MIX_ONE, MIX_TWO = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix64_mod(value: str, modulus: int) -> Column:
    """The mixed 64 bits of a whole number, as an unsigned number modulo `modulus`. In Arrow batches, as Spark's own
    products of longs don't wrap around."""
    import pandas as pd

    mixed = F.pandas_udf(lambda v: pd.Series((mix64(v.to_numpy()) % modulus).astype("int64")), "long")
    return mixed(F.col(value).cast("long"))


def mix64(v):
    """Of an array of whole numbers, as unsigned 64-bit numbers."""
    import numpy as np

    x = np.asarray(v, dtype=object if isinstance(v, list) else None).astype(np.uint64) + np.uint64(MIX_ADD)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_ONE)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_TWO)
    return x ^ (x >> np.uint64(31))


def mixed_draws(value: str, seed: int) -> Column:
    """The draws that a workload takes from the mixed number of value / 4 + seed."""
    import numpy as np
    import pandas as pd

    def draw(v):
        r = mix64(v.to_numpy() // 4 + seed)
        at = lambda shift, m: ((r >> np.uint64(shift)) % np.uint64(m)).astype("int64")
        with np.errstate(over="ignore"):
            by12 = ((r + (r >> np.uint64(11))) % np.uint64(12)).astype("int64")
        return pd.DataFrame({"by12": by12, "by64": at(0, 64), "by24": at(0, 24), "high24": at(13, 24), "by3": at(8, 3), "low16": at(16, 16), "low15": at(16, 15), "low13": at(16, 13)})

    names = ("by12", "by64", "by24", "high24", "by3", "low16", "low15", "low13")
    return F.pandas_udf(draw, ", ".join(f"{n} long" for n in names))(F.col(value).cast("long"))


def pair_key(a: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))


def pair_unkey(key: Column) -> tuple[Column, Column]:
    return F.shiftright(key, 32), key.bitwiseAND(F.lit(0xFFFFFFFF))


def arena_key(token: Column, attribute: Column, block: Column, tokens: int, attributes: int, blocks: int) -> Column:
    """The place of a token, attribute and block after all pairs of tokens."""
    return (F.lit(tokens * (tokens - 1) // 2) + (token * attributes + attribute) * blocks + block).cast("long")


def permuted(v: Column, order: Column) -> Column:
    return F.transform(order, lambda i: F.get(v, i))


def endpoint(text: Column) -> Column:
    """'-inf' and '+inf' or a finite number; NaN is an error."""
    value = F.when(text == "-inf", F.lit(float("-inf"))).when(text == "+inf", F.lit(float("inf"))).otherwise(text.cast("double"))
    return F.when(F.isnan(value), F.raise_error(F.lit("an endpoint is NaN"))).otherwise(value)


def elias_fano_bytes(n: Column, universe: int = UNIVERSE) -> tuple[Column, Column, Column]:
    """(low bits, bytes of the low part, bytes of the high part) of n sorted ids."""
    ratio = F.floor(F.lit(universe) / n)
    low = F.when(ratio <= 1, F.lit(0)).otherwise(F.length(F.bin(ratio)) - 1).cast("bigint")
    words = lambda bits: (F.ceil(bits / 64) * 8).cast("bigint")
    return low, words(n * low), words(F.floor(F.lit(universe) / F.pow(F.lit(2.0), low)) + n)


def pair_position(a: Column, b: Column, n: int) -> Column:
    """Place of the pair a < b in the row-major upper triangle over n tokens."""
    return (a * (2 * n - a - 1) / 2).cast("bigint") + b - a - 1


def u24_encode(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(3, "little") for i in ids)


def u24_decode(data: bytes) -> list[int]:
    if len(data) % 3:
        raise ValueError("length isn't a multiple of 3")
    return [int.from_bytes(data[k : k + 3], "little") for k in range(0, len(data), 3)]


def delta16_encode(ids: list[int]) -> bytes:
    deltas = [b - a for a, b in zip(ids, ids[1:])]
    if any(not 0 < d < 1 << 16 for d in deltas):
        raise ValueError("a difference is not 1 to 65535")
    return struct.pack(f"<I{len(deltas)}H", ids[0], *deltas)


def delta16_decode(data: bytes, universe: int = UNIVERSE) -> list[int]:
    out = [*struct.unpack_from("<I", data)]
    for (d,) in struct.iter_unpack("<H", data[4:]):
        out.append(out[-1] + d)
        if not d:
            raise ValueError("a difference of 0")
    if out[-1] >= universe:
        raise ValueError("an id outside the universe")
    return out


def elias_fano_encode(ids: list[int], universe: int = UNIVERSE) -> tuple[int, int, int]:
    """(low width, low bits as one integer, high bits as one integer) of strictly ascending ids."""
    if not ids or any(b <= a for a, b in zip(ids, ids[1:])) or ids[0] < 0 or ids[-1] >= universe:
        raise ValueError("ids must ascend strictly inside the universe")
    width = max(0, (universe // len(ids)).bit_length() - 1)
    low = sum((i & ((1 << width) - 1)) << (k * width) for k, i in enumerate(ids))
    high = sum(1 << ((i >> width) + k) for k, i in enumerate(ids))
    return width, low, high


def elias_fano_decode(width: int, low: int, high: int) -> list[int]:
    out, k, at = [], 0, 0
    while high >> at:
        if high >> at & 1:
            out.append((at - k) << width | (low >> (k * width)) & ((1 << width) - 1))
            k += 1
        at += 1
    return out


def fnv1a(ids: list[int]) -> int:
    """Of whole ids, with the offset and prime of the 64-bit hash as fixed values."""
    h = 14695981039346656037
    for i in ids:
        h = ((h ^ i) * 1099511628211) & (2**64 - 1)
    return h


def _elias_fano_sizes(n: int, universe: int) -> tuple[int, int, int]:
    """(low width, words of the low part, words of the high part)."""
    width = max(0, (universe // n).bit_length() - 1)
    return width, -(-n * width // 64), -(-((universe >> width) + n) // 64)


def elias_fano_bytes_of(ids: list[int], universe: int = UNIVERSE) -> bytes:
    width, low, high = elias_fano_encode(ids, universe)
    _, low_words, high_words = _elias_fano_sizes(len(ids), universe)
    return struct.pack("<Q", len(ids)) + low.to_bytes(8 * low_words, "little") + high.to_bytes(8 * high_words, "little")


def elias_fano_ids_of(data: bytes, universe: int = UNIVERSE) -> list[int]:
    if len(data) < 8:
        raise ValueError("too short")
    (n,) = struct.unpack_from("<Q", data)
    if not 0 < n <= universe:
        raise ValueError("no such number of ids")
    width, low_words, high_words = _elias_fano_sizes(n, universe)
    if len(data) != 8 * (1 + low_words + high_words):
        raise ValueError("the length isn't that of so many ids")
    low = int.from_bytes(data[8 : 8 + 8 * low_words], "little")
    high = int.from_bytes(data[8 + 8 * low_words :], "little")
    if low >> (n * width) or high >> ((universe >> width) + n) or high.bit_count() != n:
        raise ValueError("bits in the padding, or another number of ids")
    ids = elias_fano_decode(width, low, high)
    if ids[-1] >= universe or any(b <= a for a, b in zip(ids, ids[1:])):
        raise ValueError("ids that don't ascend inside the universe")
    return ids


def draw(state: int, bound: int) -> tuple[int, int]:
    """(state, unbiased draw under bound) of the mixer as a stream."""
    if bound <= 0:
        raise ValueError("a bound of 0")
    low = (1 << 64) % bound
    while True:
        value = int(mix64([state])[0])
        state = (state + MIX_ADD) % 2**64
        if value >= low:
            return state, value % bound


def permutation(n: int, seed: int) -> list[int]:
    """0 to n - 1 shuffled from the end by the stream's draws."""
    out, state = list(range(n)), seed
    for left in range(n, 1, -1):
        state, k = draw(state, left)
        out[left - 1], out[k] = out[k], out[left - 1]
    return out


def fingerprint(order: list[int]) -> int:
    """The checksum of a permutation by bytes, four a number, from its own fixed offset."""
    h = 1469598103934665603
    for v in order:
        for b in struct.pack("<I", v):
            h = ((h ^ b) * 1099511628211) & (2**64 - 1)
    return h
