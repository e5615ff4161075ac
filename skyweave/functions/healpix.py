"""HEALPix cell ids in the nested scheme (B19) and cones to cells (B20), from the published definition of the grid.

`nested_id` is a Column expression; `cone_cells` covers a cone with every cell that overlaps it, so that a scan of a
table partitioned by cell reads all it needs and little more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _spread(v: Column, bits: int) -> Column:
    """Bits of v at the even places."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(v, k).bitwiseAND(F.lit(1).cast("long")), 2 * k))
    return out


def nested_id(ra: Column, dec: Column, nside: int) -> Column:
    """Cell of a position: base face from the equatorial or polar geometry, then the face's interleaved coordinates."""
    bits = nside.bit_length() - 1
    z = F.sin(F.radians(dec))
    quarter = F.pmod(ra, F.lit(360.0)) / 90.0
    up, down = 0.5 + quarter, z * 0.75
    jp, jm = F.floor(nside * (up - down)).cast("long"), F.floor(nside * (up + down)).cast("long")
    fp, fm = F.floor(jp / nside).cast("long"), F.floor(jm / nside).cast("long")
    face = F.when(fp == fm, F.pmod(fp, F.lit(4)) + 4).when(fp < fm, F.pmod(fp, F.lit(4))).otherwise(F.pmod(fm, F.lit(4)) + 8)
    x, y = F.pmod(jm, F.lit(nside)), nside - 1 - F.pmod(jp, F.lit(nside))
    sector = F.least(F.floor(quarter), F.lit(3)).cast("long")
    part = quarter - sector
    root = nside * F.sqrt(3.0 * (1.0 - F.abs(z)))
    kp = F.least(F.floor(part * root), F.lit(nside - 1)).cast("long")
    km = F.least(F.floor((1.0 - part) * root), F.lit(nside - 1)).cast("long")
    north = z >= 0
    polar = F.abs(z) > 2.0 / 3.0
    face = F.when(polar, F.when(north, sector).otherwise(sector + 8)).otherwise(face)
    x = F.when(polar, F.when(north, nside - 1 - km).otherwise(kp)).otherwise(x)
    y = F.when(polar, F.when(north, nside - 1 - kp).otherwise(km)).otherwise(y)
    return (face * (nside * nside) + _spread(x.cast("long"), bits) + F.shiftleft(_spread(y.cast("long"), bits), 1)).cast("int")


def nested_id_of(ra: float, dec: float, nside: int) -> int:
    """The same for one position, on the driver."""
    z, quarter = math.sin(math.radians(dec)), (ra % 360.0) / 90.0
    if abs(z) <= 2 / 3:
        jp, jm = math.floor(nside * (0.5 + quarter - z * 0.75)), math.floor(nside * (0.5 + quarter + z * 0.75))
        fp, fm = jp // nside, jm // nside
        face = fp % 4 + 4 if fp == fm else fp % 4 if fp < fm else fm % 4 + 8
        x, y = jm % nside, nside - 1 - jp % nside
    else:
        sector = min(int(quarter), 3)
        root = nside * math.sqrt(3 * (1 - abs(z)))
        kp, km = min(int((quarter - sector) * root), nside - 1), min(int((1 - quarter + sector) * root), nside - 1)
        face, x, y = (sector, nside - 1 - km, nside - 1 - kp) if z >= 0 else (sector + 8, kp, km)
    spread = lambda v: sum(((v >> k) & 1) << (2 * k) for k in range(nside.bit_length()))
    return face * nside * nside + spread(x) + 2 * spread(y)


def cone_cells(ra: float, dec: float, radius: float, nside: int) -> list[int]:
    """Every cell that overlaps a cone (degrees): cells of points of rings so close that no cell slips between."""
    step = 0.2 * math.degrees(math.sqrt(math.pi / 3) / nside)
    rings = max(1, math.ceil((radius + step) / step))
    found = {nested_id_of(ra, dec, nside)}
    for k in range(1, rings + 1):
        r = math.radians(k * (radius + step) / rings)
        points = max(8, math.ceil(2 * math.pi * math.sin(min(r, math.pi / 2)) / math.radians(step)))
        for j in range(points):
            a, d = 2 * math.pi * j / points, math.radians(dec)
            s = math.sin(d) * math.cos(r) + math.cos(d) * math.sin(r) * math.cos(a)
            s = max(-1.0, min(1.0, s))
            east = math.atan2(math.sin(a) * math.sin(r) * math.cos(d), math.cos(r) - math.sin(d) * s)
            found.add(nested_id_of(ra + math.degrees(east), math.degrees(math.asin(s)), nside))
    return sorted(found)
