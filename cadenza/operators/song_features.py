"""128-entry vectors of a song from its frames, however many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import music, vectors, vocab
from . import series as s


def frame_summary(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Means, stds and shapes of the frame features: mfcc[13], chroma[12], centroid, rms, zcr."""
    w = s._w(keys)
    smooth = F.col("smooth")
    d = s.haloed(frames, 1, 1).withColumns({
        "_prev": F.lag("mfcc").over(w), "_peak": (smooth > F.lag(smooth).over(w)) & (smooth > F.lead(smooth).over(w))})
    d = s.with_whole(s.own(d), keys, _n=F.count(F.lit(1)), _mid=F.avg("smooth"))
    size = F.floor(F.col("_n") / 4)
    part = F.least(F.lit(3), F.when(size > 0, F.floor(F.col("f") / size)).otherwise(3))
    n = F.count(F.lit(1))
    delta = lambda i: F.get("mfcc", i) - F.get("_prev", i)

    def both(make, count, name):
        return [
            F.array(*[s.safe(F.avg(make(i))) for i in range(count)]).alias(f"{name}_mean"),
            F.array(*[s.safe(F.stddev_pop(make(i))) for i in range(count)]).alias(f"{name}_std")]

    aggs = [n.alias("n"), *both(lambda i: F.get("mfcc", i), 13, "mfcc"), *both(delta, 7, "delta"), *both(lambda i: F.get("chroma", i), 12, "chroma")]
    for c in ("centroid", "zcr", "rms", "smooth"):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), (F.max(c) - F.min(c)).alias(f"{c}_range")]
    for c in ("centroid", "smooth"):
        skew = F.when((n < 3) | (F.stddev_pop(c) == 0), 0.0).otherwise(s.safe(F.skewness(c)))
        aggs.append(skew.alias(f"{c}_skew"))
    aggs += [
        s.safe(F.regr_slope("smooth", "f")).alias("smooth_slope"),
        *[F.percentile("smooth", q / 100).alias(f"smooth_p{q}") for q in (10, 25, 50, 75, 90)],
        F.avg((smooth > F.col("_mid")).cast("double")).alias("smooth_high"), F.when(n >= 3, F.count_if("_peak") / n).otherwise(0.0).alias("smooth_peaks"),
        *[s.safe(F.avg(F.when(part == i, smooth))).alias(f"smooth_part_{i}") for i in range(4)],
        F.avg(F.abs("harmonic")).alias("harmonic"), F.avg(F.abs("percussive")).alias("percussive")]
    return d.groupBy(*keys).agg(*aggs)


def _flag(c: Column) -> Column:
    return music.flag(c)


def song_vector() -> Column:
    """26 timbre + 24 harmony + 8 spectral + 20 rhythm + 15 energy + 15 tempo + 18 structure, cleaned and unit length."""
    c = F.col
    mean, std = c("centroid_mean"), c("centroid_std")
    spectral = F.array(
        mean / 11025.0, std / 11025.0, c("centroid_range") / 11025.0, c("centroid_skew"), mean / 11025.0, std / (mean + 1e-6),
        F.least(F.lit(1.0), mean / 2000.0), _flag(mean > 1500))
    n, high = c("n"), c("smooth_high")
    energy = F.array(
        c("smooth_mean"), c("smooth_std"), c("smooth_range"), c("smooth_std") * c("smooth_std"), high, c("smooth_skew"),
        F.when(n < 3, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c("smooth_slope") * n))),
        *[c(f"smooth_p{q}") for q in (10, 25, 50, 75, 90)], _flag(c("smooth_mean") > 0.3), _flag(c("smooth_std") > 0.1), c("smooth_mean") * c("rhythm"))
    parts = [c(f"smooth_part_{i}") for i in range(4)]
    f = s.structure_features(parts)
    middle = (parts[1] + parts[2]) / 2.0
    shape = F.array(
        *parts, *[f[k] for k in ("intro_outro", "middle_edge", "dynamic", "variability", "builds", "fades", "buildup", "breakdown")],
        c("tempo") * middle, c("rhythm") * f["variability"], n / 1000.0, c("smooth_mean") * c("tempo") / 120.0, f["has_high"], f["has_low"])
    structure = F.when(n > 10, shape).otherwise(vectors.zeros(18))
    whole = F.concat(
        c("mfcc_mean"), c("mfcc_std"), c("chroma_mean"), c("chroma_std"), spectral, music.rhythm_features(c("tempo"), c("rhythm"), c("sync")),
        energy, music.tempo_features(c("tempo"), c("rhythm"), c("sync")), structure)
    return vectors.l2_normalize(vectors.clean(F.transform(vectors.pad_to(whole, 128), lambda x: s.safe(x))))


def harmonic_pairs(chroma: Column) -> Column:
    """Twelve features of opposite fifths, triads and tritones."""
    at = lambda i: F.get(chroma, i)
    fifths = [at(vocab.FIFTHS[i]) - at(vocab.FIFTHS[i + 6]) for i in range(6)]
    triads = [(at(0) + at(m) + at(7)) / 3.0 for m in (4, 3)]
    return F.array(*fifths, *triads, *[at(i) * at((i + 6) % 12) for i in range(4)])


def fusion_vector() -> Column:
    """40 timbre + 24 harmony + 12 harmonic pairs + 16 spectral + 36 structure."""
    c = F.col
    spectral = F.array(
        c("centroid_mean"), c("centroid_std"), c("centroid_range"), c("centroid_skew"), c("zcr_mean"), c("zcr_std"), c("rms_mean"), c("rms_std"), c("rms_range"),
        c("harmonic") / (c("harmonic") + c("percussive") + 1e-6), c("smooth_std") * c("smooth_std"), c("smooth_slope"), c("rhythm"), c("sync"), F.lit(0.8),
        c("tempo") / 150.0)
    density = c("smooth_peaks")
    known = c("n_sections").isNotNull() & (c("n_sections") > 0)
    sections = F.when(known, F.array(
        c("n_sections") / 10.0, *[c(f"section_seconds_{k}") / 60.0 for k in ("mean", "std", "min", "max")], c("section_energy_mean"), c("section_energy_std"),
        c("section_energy_range"), *[c(f"section_{t}") / c("n_sections") for t in ("intro", "verse", "chorus", "bridge", "outro")],
        c("stability_mean"), c("stability_std"))).otherwise(vectors.zeros(20))
    rest = F.array(
        c("smooth_mean"), c("smooth_std"), c("smooth_range"), c("smooth_slope"), density, c("gap_mean"), c("gap_std"), c("gap_std") / (c("gap_mean") + 1e-6),
        c("rhythm"), c("sync"), c("seconds") / 300.0, c("tempo") / 150.0)
    whole = F.concat(
        c("mfcc_mean"), c("mfcc_std"), c("delta_mean"), c("delta_std"), c("chroma_mean"), c("chroma_std"), harmonic_pairs(c("chroma_mean")), spectral,
        vectors.pad_to(F.concat(sections, rest), 36))
    return vectors.l2_normalize(vectors.clean(F.transform(vectors.pad_to(whole, 128), lambda x: s.safe(x))))
