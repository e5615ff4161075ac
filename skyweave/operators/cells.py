"""A grid of declination zones parted in right ascension, and the cells that a box on the sky touches.

Zones are `width` degrees high; each is parted into as many cells as keep them at least as wide on the sky (one at a
pole). A box join becomes an equi-join on cells: points have one cell, boxes all they touch. Boxes may go over 0 or 360
degrees: their right ascension is then below 0 or above 360. All is SQL text, as in functions.sky.
"""

from __future__ import annotations

SLOP = 1e-9  # degrees by which boxes are widened, so that rounding loses no cell


def _zone(dec: str, width: float) -> str:
    return f"CAST(floor((({dec})+90e0)/{width!r}) AS BIGINT)"


def parts(zone: str, width: float) -> str:
    """Cells of a zone: by the cosine at its end nearer to a pole."""
    end = f"least(90e0,greatest(abs({zone}*{width!r}-90),abs(({zone}+1)*{width!r}-90)))"
    return f"greatest(1,CAST(floor(360*cos(radians({end}))/{width!r}) AS BIGINT))"


def own(ra: str, dec: str, width: float) -> str:
    """The cell of a position."""
    zone = _zone(dec, width)
    n = parts(zone, width)
    return f"({zone}*1048576+pmod(CAST(floor(pmod({ra},360e0)*{n}/360e0) AS BIGINT),{n}))"


def touched(ra_lo: str, ra_hi: str, dec_lo: str, dec_hi: str, width: float) -> str:
    """An array of the cells of a box, each once."""
    n = parts("z", width)
    first, last = f"CAST(floor((({ra_lo})-{SLOP})*{n}/360e0) AS BIGINT)", f"CAST(floor((({ra_hi})+{SLOP})*{n}/360e0) AS BIGINT)"
    cells = f"transform(sequence({first},least({last},{first}+{n}-1)),r -> z*1048576+pmod(r,{n}))"
    return f"flatten(transform(sequence({_zone(f'greatest(-90e0,({dec_lo})-{SLOP})', width)},{_zone(f'least(90e0,({dec_hi})+{SLOP})', width)}),z -> {cells}))"


def around(ra: str, dec: str, radius: float, width: float) -> str:
    """The cells that a cone of `radius` degrees touches; all of a zone where the cone reaches a pole."""
    reach = f"if(abs({dec})+{radius!r}>=89.9e0,180e0,least(180e0,degrees(asin(least(1e0,sin(radians({radius!r}))/cos(radians({dec})))))))"
    return touched(f"({ra})-{reach}", f"({ra})+{reach}", f"({dec})-{radius!r}", f"({dec})+{radius!r}", width)
