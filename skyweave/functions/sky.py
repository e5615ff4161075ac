"""Scalar functions of the catalogue domain as SQL text.

Every function takes SQL expressions and returns one, so that it can be used with F.expr, selectExpr and spark.sql
alike; all stay inside whole-stage code generation. Angles are degrees unless a name says otherwise.
"""

from __future__ import annotations

from math import radians, sin


def _nulls(*parts) -> str:
    """Added to an expression with least or greatest, which skip nulls: null if a part is."""
    return "+0e0*(" + "+".join(f"({p})" for p in parts) + ")"


def haversine(ra1, dec1, ra2, dec2) -> str:
    """Separation in arcsec."""
    a = f"pow(sin(radians({dec2}-{dec1})/2),2)+cos(radians({dec1}))*cos(radians({dec2}))*pow(sin(radians({ra2}-{ra1})/2),2)"
    return f"(2*degrees(asin(sqrt(least(1e0,greatest(0e0,{a})))))*3600{_nulls(ra1, dec1, ra2, dec2)})"


def cosine_separation(ra1, dec1, ra2, dec2) -> str:
    """Separation in degrees by the law of cosines (poor below 0.1 arcsec)."""
    c = f"sin(radians({dec1}))*sin(radians({dec2}))+cos(radians({dec1}))*cos(radians({dec2}))*cos(radians({ra1}-({ra2})))"
    return f"(degrees(acos(least(1e0,greatest(-1e0,{c})))){_nulls(ra1, dec1, ra2, dec2)})"


def unit_xyz(ra, dec) -> tuple[str, str, str]:
    """B03."""
    return f"(cos(radians({dec}))*cos(radians({ra})))", f"(cos(radians({dec}))*sin(radians({ra})))", f"sin(radians({dec}))"


def chord(radius_arcsec: float) -> float:
    """Length of the chord of an angle."""
    return 2 * sin(radians(radius_arcsec / 3600) / 2)


def chord_to_arcsec(d) -> str:
    return f"(2*degrees(asin(least(1e0,({d})/2)))*3600)"


def wrap360(x) -> str:
    """B05."""
    return f"((({x}) % 360e0 + 360e0) % 360e0)"


def wrap180(x) -> str:
    return f"({wrap360(f'({x})+180e0')}-180e0)"


def tangent_offsets(ra, dec, ra0, dec0) -> tuple[str, str]:
    """Local offsets in arcsec."""
    return f"({wrap180(f'({ra})-({ra0})')}*cos(radians({dec0}))*3600)", f"((({dec})-({dec0}))*3600)"


def gnomonic(ra, dec, ra0, dec0) -> tuple[str, str]:
    """Tangent-plane coordinates in radians."""
    d = f"(sin(radians({dec0}))*sin(radians({dec}))+cos(radians({dec0}))*cos(radians({dec}))*cos(radians({ra}-({ra0}))))"
    return f"(cos(radians({dec}))*sin(radians({ra}-({ra0})))/{d})", f"((cos(radians({dec0}))*sin(radians({dec}))-sin(radians({dec0}))*cos(radians({dec}))*cos(radians({ra}-({ra0}))))/{d})"


def flat_separation(ra1, dec1, ra2, dec2, median_dec) -> str:
    """Small-angle separation in arcsec; the scale uses the mean of own and median declination."""
    return f"(sqrt(pow(({ra1}-({ra2}))*cos(radians((({dec1})+({median_dec}))/2)),2)+pow({dec1}-({dec2}),2))*3600)"


def destination(ra, dec, distance, azimuth) -> tuple[str, str]:
    """Point at a distance and azimuth (degrees east of north)."""
    s = f"(sin(radians({dec}))*cos(radians({distance}))+cos(radians({dec}))*sin(radians({distance}))*cos(radians({azimuth})))"
    x = f"atan2(sin(radians({azimuth}))*sin(radians({distance}))*cos(radians({dec})),cos(radians({distance}))-sin(radians({dec}))*{s})"
    return wrap360(f"({ra})+degrees({x})"), f"degrees(asin(least(1e0,greatest(-1e0,{s}))))"


def propagate(ra, dec, pmra, pmdec, years) -> tuple[str, str]:
    """Linear proper motion (mas a year, pmra times cos dec); without both motions the position stays."""
    has = f"({pmra}) IS NOT NULL AND ({pmdec}) IS NOT NULL"
    return (
        f"(CASE WHEN {has} THEN {ra}+({pmra})*({years})/3.6e6/cos(radians({dec})) ELSE {ra} END)",
        f"(CASE WHEN {has} THEN {dec}+({pmdec})*({years})/3.6e6 ELSE {dec} END)",
    )


def propagate_stage(ra, dec, pmra, pmdec, years) -> tuple[str, str]:
    """A missing motion is zero, and the scale is that of the moved, clipped declination."""
    moved = f"least(90e0,greatest(-90e0,{dec}+coalesce({pmdec},0)*({years})/3.6e6))"
    return f"({ra}+coalesce({pmra},0)*({years})/3.6e6/greatest(cos(radians({moved})),1e-6))", f"({moved})"


def total_motion(pmra, pmdec) -> str:
    """B12."""
    return f"sqrt(pow({pmra},2)+pow({pmdec},2))"


def valid_magnitude(m) -> str:
    """B18."""
    return f"(({m}) IS NOT NULL AND ({m}) > -900 AND ({m}) >= 0 AND ({m}) <= 50)"


def polynomial(x, y, degree: int) -> list[str]:
    """Features 1, x, y (and squares and the product)."""
    return ["1e0", x, y] + ([f"({x})*({x})", f"({x})*({y})", f"({y})*({y})"] if degree == 2 else [])


def ratio(n, d) -> str:
    """Null unless the denominator is positive."""
    return f"(CASE WHEN ({d}) > 0 THEN ({n})/({d}) END)"


def chebyshev(ra, dec, ra0, dec0) -> str:
    """Larger of the two offsets in degrees."""
    return f"greatest(abs({wrap180(f'({ra})-({ra0})')}*cos(radians({dec0}))),abs(({dec})-({dec0})))"


def edge_distance(x, y, nx, ny) -> str:
    """Signed distance to the nearest edge."""
    return f"least({x},{y},({nx})-({x}),({ny})-({y}))"


def edge_class(distance, touch, near) -> str:
    return f"(CASE WHEN {distance} < 0 THEN 'off_plate' WHEN {distance} <= {touch} THEN 'edge_touch' WHEN {distance} <= {near} THEN 'near_edge' ELSE 'core' END)"


def wilson(k, n, z: float = 1.96) -> tuple[str, str]:
    """Interval of a share in percent."""
    p, m = f"(({k})*1e0/({n}))", f"(({z * z}e0)/({n}))"
    mid, half = f"({p}+{m}/2)", f"({z}e0*sqrt({p}*(1-{p})/({n})+{m}/(4*({n}))))"
    return f"(100*({mid}-{half})/(1+{m}))", f"(100*({mid}+{half})/(1+{m}))"


def margin(sep1, sep2) -> str:
    """B29."""
    return f"round(1-({sep1})/greatest({sep2},1e-9),4)"


def percent_change(new, old) -> str:
    """Null without an old value; a loss of all but nothing is guarded."""
    return f"(CASE WHEN ({old}) > 0 THEN greatest(100e0*(({new})-({old}))/({old}),-99.9e0) END)"


def sexagesimal(text) -> str:
    """B15: 'd m s' or 'd:m:s' to degrees; the sign is taken from the text, so -00 stays negative."""
    part = lambda k: f"abs(cast(split_part(translate(trim({text}), ' ', ':'), ':', {k}) AS double))"
    return f"((CASE WHEN trim({text}) LIKE '-%' THEN -1 ELSE 1 END)*({part(1)}+{part(2)}/60+{part(3)}/3600))"


def space_motion(ra, dec, pmra, pmdec, years) -> tuple[str, str]:
    """Motion along the great circle: the unit vector moves along its tangent plane and is scaled back, so that
    pmra turns with the meridian and the pole is no special case. Missing motions are zero."""
    a, d = f"radians({ra})", f"radians({dec})"
    u = f"(coalesce({pmra},0)*({years})*{radians(1 / 3.6e6)!r})"
    v = f"(coalesce({pmdec},0)*({years})*{radians(1 / 3.6e6)!r})"
    x = f"(cos({d})*cos({a})-{u}*sin({a})-{v}*sin({d})*cos({a}))"
    y = f"(cos({d})*sin({a})+{u}*cos({a})-{v}*sin({d})*sin({a}))"
    z = f"(sin({d})+{v}*cos({d}))"
    return wrap360(f"degrees(atan2({y},{x}))"), f"degrees(atan2({z},sqrt({x}*{x}+{y}*{y})))"


#: Fixed value: the pattern of tile names.
TILE = "^tile_RA([0-9]+[.]?[0-9]*)_DEC([pm])([0-9]+[.]?[0-9]*)$"


def tile_centre(name) -> tuple[str, str]:
    """Centre of a tile name, RA within 0 to 360 and dec clipped at the poles; null for other names."""
    part = lambda k: f"regexp_extract(trim({name}), '{TILE}', {k})"
    number = lambda k: f"CAST(nullif({part(k)}, '') AS double)"
    return wrap360(number(1)), f"(greatest(-90e0,least(90e0,CASE WHEN {part(2)}='m' THEN -1 ELSE 1 END*{number(3)})){_nulls(number(3))})"


def tile_name(ra, dec, text: str = "format_string") -> str:
    """Name of a tile; text is the engine's printf."""
    return f"({text}('tile_RA%.3f_DEC', CAST({wrap360(ra)} AS double)) || CASE WHEN ({dec}) >= 0 THEN 'p' ELSE 'm' END || {text}('%.3f', CAST(abs({dec}) AS double)))"


#: Fixed value: the pattern of observation times.
TIME = "^([0-9]{4}-[0-9]{2}-[0-9]{2})[T ]([0-9]{2}):([0-9]{2}):([0-9]{2})([.][0-9]+)?Z?$"


def overflow_time(text) -> str:
    """Seconds of the day of an observation time: too many seconds and minutes are carried, hours wrap around and
    the date stays; null for other texts."""
    part = lambda k: f"CAST(nullif(regexp_extract(trim({text}), '{TIME}', {k}), '') AS double)"
    return f"((({part(2)}*3600+{part(3)}*60+{part(4)}) % 86400e0)+coalesce({part(5)},0))"


def overflow_mjd(text, days: str) -> str:
    """Modified Julian date of such a time; days(date) is the engine's day number since 1970 as SQL text."""
    date = f"regexp_extract(trim({text}), '{TIME}', 1)"
    return f"({days.format(f'CAST(nullif({date}, {chr(39)}{chr(39)}) AS date)')}+40587+{overflow_time(text)}/86400)"


def number_text(x, digits: int = 6, text: str = "format_string") -> str:
    """A number as text, empty for null and NaN."""
    return f"(CASE WHEN ({x}) IS NULL OR isnan({x}) THEN '' ELSE {text}('%.{digits}f', CAST({x} AS double)) END)"


def decimal_year(t) -> str:
    """Year and the share of it that has passed, of a timestamp."""
    start, end = f"make_timestamp(year({t}),1,1,0,0,0)", f"make_timestamp(year({t})+1,1,1,0,0,0)"
    return f"(year({t})+(unix_micros({t})-unix_micros({start}))/(unix_micros({end})-unix_micros({start})))"
