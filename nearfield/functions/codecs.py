"""Codecs of id lists as column functions. Lists are chunks of postings, so they are bounded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfield import functions as plain


def _byte(v: Column, shift: int) -> Column:
    return F.lpad(F.hex(F.shiftright(v, shift).bitwiseAND(F.lit(255).cast("long"))), 2, "0")


def _at(data: Column, place: Column) -> Column:
    return F.conv(F.hex(F.substr(data, place.cast("int"), F.lit(1))), 16, 10).cast("long")


def _checked(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def u24(ids: Column | str) -> Column:
    """Three bytes an id, the lowest first."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    ok = ~F.exists(ids, lambda i: (i < 0) | (i >= 1 << 24))
    return _checked(ok, F.unhex(F.array_join(F.transform(ids, lambda i: F.concat(_byte(i, 0), _byte(i, 8), _byte(i, 16))), "")), "an id doesn't fit 24 bits")


def un_u24(data: Column | str) -> Column:
    data = F.col(data) if isinstance(data, str) else data
    n = F.octet_length(data)
    each = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor(n / 3) - 1), lambda k: _at(data, k * 3 + 1) + _at(data, k * 3 + 2) * 256 + _at(data, k * 3 + 3) * 65536)).otherwise(F.array().cast("array<long>"))
    return _checked(n % 3 == 0, each, "length isn't a multiple of 3")


def delta16(ids: Column | str) -> Column:
    """The first id in four bytes, then the steps in two, each 1 to 65,535."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    steps = F.zip_with(F.slice(ids, 2, F.size(ids)), F.slice(ids, 1, F.size(ids) - 1), lambda b, a: b - a)
    ok = (F.size(ids) > 0) & ~F.exists(steps, lambda s: (s < 1) | (s > 65535))
    first = F.element_at(ids, 1)
    head = F.concat(*[_byte(first, k) for k in (0, 8, 16, 24)])
    return _checked(ok, F.unhex(F.concat(head, F.array_join(F.transform(steps, lambda s: F.concat(_byte(s, 0), _byte(s, 8))), ""))), "a step isn't 1 to 65535")


def un_delta16(data: Column | str, universe: int = plain.UNIVERSE) -> Column:
    data = F.col(data) if isinstance(data, str) else data
    n = F.octet_length(data)
    first = sum((_at(data, F.lit(k + 1)) * (1 << (8 * k)) for k in range(4)), F.lit(0).cast("long"))
    count = F.floor((n - 4) / 2)
    steps = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: _at(data, k * 2 + 5) + _at(data, k * 2 + 6) * 256)).otherwise(F.array().cast("array<long>"))
    ids = F.aggregate(steps, F.array(first), lambda s, d: F.array_append(s, F.element_at(s, -1) + d))
    return _checked((n >= 4) & (n % 2 == 0) & ~F.exists(steps, lambda s: s < 1) & (F.element_at(ids, -1) < universe), ids, "not a list of steps inside the universe")


def _arrow(f, kind: str, *columns: Column | str) -> Column:
    import pandas as pd

    return F.pandas_udf(lambda *s: pd.Series([f(*row) for row in zip(*s)]), kind)(*[F.col(c) if isinstance(c, str) else c for c in columns])


def fnv(ids: Column | str) -> Column:
    """The 64-bit checksum of whole ids, as decimal digits."""
    return _arrow(lambda v: str(plain.fnv1a([int(i) for i in v])), "string", ids)


def elias_fano(ids: Column | str, universe: int = plain.UNIVERSE) -> Column:
    """Strictly ascending ids inside the universe, as bytes: their number in eight, then low and high parts in words of eight."""
    return _arrow(lambda v: plain.elias_fano_bytes_of([int(i) for i in v], universe), "binary", ids)


def un_elias_fano(data: Column | str, universe: int = plain.UNIVERSE) -> Column:
    """The ids; bytes that no list gives (another length, bits in the padding, another number of ids) are an error."""
    return _arrow(lambda v: plain.elias_fano_ids_of(bytes(v), universe), "array<long>", data)


def elias_fano_union(a: Column | str, b: Column | str, universe: int = plain.UNIVERSE) -> Column:
    return _arrow(lambda x, y: plain.elias_fano_bytes_of(sorted({*plain.elias_fano_ids_of(bytes(x), universe), *plain.elias_fano_ids_of(bytes(y), universe)}), universe), "binary", a, b)
