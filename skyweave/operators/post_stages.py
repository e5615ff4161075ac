"""The stages that follow detection (2.M), as members of a chain: rules, statuses and what each shows.

Rows need the chain's key, ra and dec; what else a stage reads is said there. Statuses that pass a row for want of
evidence are named as such, so that a row that was not judged differs from one that was found good.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.functions import sky

from . import boxes as plate_boxes
from .chain import Case, Match, Stage
from .ephemeris import moving_flags
from .skyjoin import matched_keys
from .validate import nearest_plates


def spread(key: str, scores: DataFrame, tile: str = "tile_id", least: float = -0.002, after: str | None = None) -> Stage:
    """Scores (key, tile, matched, spread_model) of a later measurement; only a measured one at or below `least` drops.

    postscore_missing: the tile has no scores at all; postscore_row_not_found: not this row; postscore_unmatched: found
    without a counterpart or value.
    """

    def measure(rows: DataFrame) -> DataFrame:
        tiles = scores.select(tile).distinct().withColumn("_scored", F.lit(True))
        one = scores.groupBy(key).agg(F.first(F.struct("matched", "spread_model")).alias("_score"))
        return rows.select(key, tile).join(tiles, tile, "left").join(one, key, "left").select(key, "_scored", "_score")

    cases = [
        Case("postscore_missing", "_scored IS NULL"),
        Case("postscore_row_not_found", "_score IS NULL"),
        Case("postscore_unmatched", "NOT coalesce(_score.matched, false) OR _score.spread_model IS NULL OR isnan(_score.spread_model)"),
        Case("spread_model_below_gate", f"_score.spread_model <= {least!r}", True),
    ]
    return Stage("spread", cases, Case("ok", ""), after, measures=[measure])


def tile_psf(detections: DataFrame, stars: DataFrame, key: str, tile: str, brightest: float = 12, faintest: float = 18, radius: float = 3, elongation: float = 1.3, least: int = 20) -> DataFrame:
    """Of each tile the median fwhm and spread of its reference stars: clean, round, and matched by a star of the
    magnitudes between; psf_status is ok or psf_insufficient (medians are null then)."""
    good = detections.where((F.col("flags") == 0) & (F.col("elong") < elongation) & F.col("fwhm").isNotNull() & F.col("spread").isNotNull())
    known = stars.where((F.col("mag") > brightest) & (F.col("mag") < faintest))
    matched = good.join(matched_keys(good, known, radius, [key]), key, "left_semi")
    psf = matched.groupBy(tile).agg(F.median("fwhm").alias("psf_fwhm"), F.median("spread").alias("psf_spread"), F.count("*").alias("psf_stars"))
    out = detections.select(tile).distinct().join(psf, tile, "left").withColumn("psf_stars", F.coalesce("psf_stars", F.lit(0)))
    enough = F.col("psf_stars") >= least
    return out.select(tile, F.when(enough, F.col("psf_fwhm")).alias("psf_fwhm"), F.when(enough, F.col("psf_spread")).alias("psf_spread"), "psf_stars", F.when(enough, "ok").otherwise("psf_insufficient").alias("psf_status"))


def morph(key: str, psf: DataFrame, tile: str = "tile_id", ratio: float = 1.5, snr: float = 5, after: str | None = None) -> Stage:
    """Rows need fwhm, spread and spreaderr. A ratio or a signal that cannot be had (psf or error not above 0) never
    rejects. catalog_missing: the tile has no psf row; psf_insufficient; candidate_not_found: not measured."""

    def measure(rows: DataFrame) -> DataFrame:
        r = F.when(F.col("psf_fwhm") > 0, F.col("fwhm") / F.col("psf_fwhm")).alias("fwhm_ratio")
        s = F.when(F.col("spreaderr") > 0, (F.col("spread") - F.col("psf_spread")) / F.col("spreaderr")).alias("spread_snr")
        return rows.select(key, tile, "fwhm", "spread", "spreaderr").join(psf, tile, "left").select(key, "psf_status", "psf_stars", r, s)

    wide, extended = f"coalesce(fwhm_ratio > {ratio}, false)", f"coalesce(spread_snr > {snr}, false)"
    cases = [
        Case("catalog_missing", "psf_status IS NULL"),
        Case("psf_insufficient", "psf_status <> 'ok'"),
        Case("candidate_not_found", "fwhm IS NULL OR spread IS NULL OR spreaderr IS NULL"),
        Case("fwhm_ratio;spread_snr", f"{wide} AND {extended}", True),
        Case("fwhm_ratio", wide, True),
        Case("spread_snr", extended, True),
    ]
    return Stage("morph", cases, Case("ok", ""), after, measures=[measure], shows=["fwhm_ratio", "spread_snr", "psf_stars"])


def shape(difference: float = 0.05, elongation: float = 1.10, circularity: float = 0.80, after: str | None = None) -> Stage:
    """C14: rows need profile_diff, elongation and circularity as measured; null and NaN never reject."""
    tests = {"profile_diff": f"profile_diff > {difference}", "elongation": f"elongation > {elongation}", "circularity": f"circularity < {circularity}"}
    sure = {n: f"coalesce({t} AND NOT isnan({n}), false)" for n, t in tests.items()}
    cases = []
    for mask in range(7, 0, -1):  # a status for each set of reasons
        names = [n for k, n in enumerate(sure) if mask >> (2 - k) & 1]
        cases.append(Case(";".join(names), " AND ".join(sure[n] for n in names), True))
    cases.sort(key=lambda c: -c.status.count(";"))
    return Stage("shape", cases, Case("ok", ""), after)


def skybot(key: str, table: DataFrame, strict: float = 5, wide: float = 60, after: str | None = None) -> Stage:
    """Rows need mjd. Bodies within `strict` arcsec at the row's epoch drop it, those within `wide` are flagged."""
    measure = lambda rows: moving_flags(rows, key, table, strict, wide).drop("mjd")
    cases = [Case("no_epoch", "epoch_status = 'no_epoch'"), Case("not_tabulated", "epoch_status = 'not_tabulated'"), Case("strict", "strict_match", True), Case("wide", "wide_match")]
    return Stage("skybot", cases, Case("clear", ""), after, measures=[measure], shows=["matched_count", "best_sep"])


def matched(name: str, catalogue: DataFrame, radius: float = 5, keeps: bool = False, after: str | None = None) -> Stage:
    """VSX, USNO, PS1: a match drops the row; SCOS keeps those with one. Rows without a position stay unjudged."""
    cases = [Case("no_position", "ra IS NULL OR dec IS NULL"), Case("matched", f"{name}_match_id IS NOT NULL", not keeps)]
    return Stage(name, cases, Case("unmatched", "", keeps), after, Match(catalogue, radius), shows=[f"{name}_sep"])


def ptf(catalogue: DataFrame, radius: float = 5, after: str | None = None) -> Stage:
    """Only sources with good observations (ngoodobs above 0) count."""
    return matched("ptf", catalogue.where("coalesce(ngoodobs, 0) > 0"), radius, after=after)


def scope_dec(least: float, after: str | None = None) -> Stage:
    """Rows below the declination that was surveyed go; an unreadable one stays."""
    return Stage("scope", [Case("dec_parse_error", "dec IS NULL OR isnan(dec)"), Case("dec_below_scope", f"dec < {least!r}", True)], Case("ok", ""), after)


def southern(catalogue: DataFrame, below: float = 0.0, radius: float = 5, after: str | None = None) -> list[Stage]:
    """PS1+SH: rows below a declination go (an unreadable one stays), then those with a match."""
    cut = Stage("south", [Case("dec_parse_error", "dec IS NULL OR isnan(dec)"), Case("removed_by_cut", f"dec < {below!r}", True)], Case("ok", ""), after)
    return [cut, matched("ps1", catalogue, radius, after="south")]


def wrapped(catalogue: DataFrame) -> DataFrame:
    """GSC: right ascensions as 0 to 360 degrees."""
    return catalogue.withColumn("ra", F.expr(sky.wrap360("ra")))


def second_epoch(catalogue: DataFrame, years: float, near_infrared: bool = False) -> DataFrame:
    """Rows seen in a second survey (b2mag or r2mag, imag if asked), moved by `years` of proper motion; a
    motion that is not known counts as 0."""
    seen = ["b2mag", "r2mag"] + (["imag"] if near_infrared else [])
    some = catalogue.where(" OR ".join(f"(({m}) IS NOT NULL AND NOT isnan({m}))" for m in seen))
    ra, dec = sky.propagate_stage("ra", "dec", "pmra", "pmdec", repr(float(years)))
    return some.select("id", F.expr(ra).alias("_ra"), F.expr(dec).alias("_dec")).toDF("id", "ra", "dec")


def usnob(catalogue: DataFrame, years: float = -50.0, radius: float = 5, near_infrared: bool = False, after: str | None = None) -> Stage:
    """USNO-B: only second-epoch rows veto, at their place at the plate's epoch."""
    return matched("usnob", second_epoch(catalogue, years, near_infrared), radius, after=after)


def maps(key: str, objects: DataFrame, boxes: DataFrame, radius: float = 5, after: str | None = None) -> Stage:
    """MAPS: a clean object within radius drops a row; no_coverage: no plate overlaps its cone, so nothing could be found."""
    cover = lambda rows: plate_boxes.coverage_count(rows, key, boxes, radius)
    cases = [Case("no_position", "ra IS NULL OR dec IS NULL"), Case("matched", "maps_match_id IS NOT NULL", True), Case("no_coverage", "covered = 0")]
    return Stage("maps", cases, Case("unmatched", ""), after, Match(objects.where("flag % 100 = 0"), radius), [cover], ["maps_sep", "covered"])


def edge(key: str, plates: DataFrame, core: float, own: str | None = None, cut: bool = False, after: str | None = None) -> Stage:
    """Is a row within `core` degrees of its own plate's centre (`own` names the column), or of the nearest one? It only flags
    unless cut; rows of no known plate are never cut. Shows sep_own and sep_best, in degrees."""

    def measure(rows: DataFrame) -> DataFrame:
        best = nearest_plates(rows.select(key, "ra", "dec"), plates, 1).select(key, F.col("near")[0]["sep"].alias("sep_best"))
        if own is None:
            return best.withColumn("sep_own", F.lit(None).cast("double"))
        p = plates.select(F.col("id").alias(own), F.col("ra").alias("_ra"), F.col("dec").alias("_dec"))
        mine = rows.select(key, own, "ra", "dec").join(p, own).select(key, (F.expr(sky.haversine("ra", "dec", "_ra", "_dec")) / 3600).alias("sep_own"))
        return best.join(mine, key, "left")

    sep = "sep_best" if own is None else "sep_own"
    return Stage("edge", [Case("unresolved", f"{sep} IS NULL"), Case("outside_core", f"{sep} > {core!r}", cut)], Case("core", ""), after, measures=[measure], shows=["sep_own", "sep_best"])
