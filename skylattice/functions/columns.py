"""Scalar functions as Columns; all of them stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The normal quantile of 97.5 %, a fixed value.
Z95 = 1.959963984540054


def wilson(successes: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    """Score interval of a proportion; NaN without trials."""
    p, n = successes / total, total.cast("double")
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    nan = F.lit(float("nan"))
    return F.when(total > 0, centre - half).otherwise(nan), F.when(total > 0, centre + half).otherwise(nan)


def ratio_or_nan(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(float("nan")))


def binary_metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    precision, recall = ratio_or_nan(tp, tp + fp), ratio_or_nan(tp, tp + fn)
    return {"precision": precision, "recall": recall, "accuracy": ratio_or_nan(tp + tn, tp + fp + fn + tn), "f1": ratio_or_nan(2 * tp, 2 * tp + fp + fn)}


def network_rank(scores: Column) -> Column:
    """Second highest of an array of detector scores; the only one if there is one; null if there is none."""
    ordered = F.sort_array(F.array_compact(scores), asc=False)
    return F.coalesce(F.try_element_at(ordered, F.lit(2)), F.try_element_at(ordered, F.lit(1)))


def network_margin(chirp: Column, other: Column) -> tuple[Column, Column]:
    """The highest of the other class's detector scores, and how far the network rank is above it."""
    most = F.array_max(F.array_compact(other))
    return most, network_rank(chirp) - most


def valid_scores(scores: Column, ifos: Column) -> Column:
    """Scores of a map for the listed detectors, in their order."""
    return F.transform(ifos, lambda i: F.try_element_at(scores, i))


def interval_distance(t: Column, start: Column, end: Column) -> Column:
    return F.greatest(start - t, F.lit(0.0), t - end)


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Half-open: touching intervals don't overlap."""
    return (start < other_end) & (end > other_start)


def contains_half_open(t: Column, centre: Column, width: float) -> Column:
    return (t >= centre - width / 2) & (t < centre + width / 2)


def all_bits(mask: Column, bits: int) -> Column:
    """Whether every element of an array of masks has all bits."""
    return F.forall(mask, lambda x: x.bitwiseAND(F.lit(bits)) == bits)


def arrival_gate(difference: Column, limit: Column, uncertainty: Column) -> Column:
    return F.abs(difference) <= limit + 2 * uncertainty + F.lit(1e-12)


def hash_uniform(hex_digest: Column) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits."""
    return F.conv(F.substring(hex_digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def seeded_hash(seed: object, *parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *parts), 256)


def nul_separated_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *parts), 256)


def canonical_hash(length: int, **fields: Column) -> Column:
    """sha256 prefix of the JSON object with sorted keys; strings and integers only."""
    return F.substring(F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256), 1, length)


def quoted_hash(text: Column) -> Column:
    """sha256 of a string with its JSON quotes."""
    return F.sha2(F.concat(F.lit('"'), text, F.lit('"')), 256)


def time_key(t: Column) -> Column:
    """Whole nanoseconds, halves to even."""
    return F.bround(t * 1e9, 0).cast("bigint")


def block_of(t: Column, size: int) -> Column:
    return F.floor(t / size) * size


def block_label(start: Column, size: int) -> Column:
    return F.concat(F.lit("gps:"), start.cast("bigint").cast("string"), F.lit(f":{size}"))


def parse_block(label: Column) -> tuple[Column, Column]:
    parts = F.split(label, ":")
    return F.try_element_at(parts, F.lit(2)).cast("bigint"), F.try_element_at(parts, F.lit(3)).cast("bigint")


def stratum(x: Column, edges: Sequence[float], prefix: str = "") -> Column:
    """Half-open label [lo, hi); below the first and from the last edge on are open; null stays null."""
    out = F.when(x < edges[0], F.lit(f"{prefix}<{edges[0]:g}"))
    for lo, hi in zip(edges, edges[1:], strict=False):
        out = out.when((x >= lo) & (x < hi), F.lit(f"{prefix}[{lo:g},{hi:g})"))
    return out.when(x >= edges[-1], F.lit(f"{prefix}>={edges[-1]:g}"))


def composition(class_0: Column, class_1: Column) -> Column:
    return F.when((class_0 > 0) & (class_1 > 0), "chirp+noise").when(class_0 > 0, "chirp_only").when(class_1 > 0, "noise_only").otherwise("empty")


def timing_gate(p90: Column, bin_width: Column, misses: Column, target: float = 0.010) -> Column:
    return (p90 <= target) & (bin_width <= target) & (misses == 0)


def is_sha256(x: Column) -> Column:
    return F.coalesce(x.rlike("^[0-9a-f]{64}$"), F.lit(False))


def outside_prior(truth: Column, prior: dict[str, tuple[float, float]]) -> Column:
    """Names of the parameters that lie outside their inclusive range or are missing."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.try_element_at(truth, F.lit(k)).between(lo, hi), F.lit(False)), F.lit(None)).otherwise(F.lit(k)) for k, (lo, hi) in prior.items()]))


def last_token(name: Column, pattern: str = "[0-9a-fA-F]{32}") -> Column:
    """The last match of a pattern, lower-cased; the whole name if there is none."""
    found = F.regexp_extract_all(name, F.lit(f"({pattern})"), 1)
    return F.lower(F.coalesce(F.try_element_at(found, F.lit(-1)), name))


def first_contained(name: Column, labels: Sequence[str], default: str = "unknown") -> Column:
    out = F.when(F.contains(F.lower(name), F.lit(labels[0].lower())), labels[0])
    for x in labels[1:]:
        out = out.when(F.contains(F.lower(name), F.lit(x.lower())), x)
    return out.otherwise(default)


def chirp_mass(m1: Column, m2: Column) -> Column:
    return F.pow(m1 * m2, F.lit(0.6)) / F.pow(m1 + m2, F.lit(0.2))


def mass_ratio(m1: Column, m2: Column) -> Column:
    return F.least(m1, m2) / F.greatest(m1, m2)


def log_uniform(u: Column, lo: float, hi: float) -> Column:
    return lo * F.pow(F.lit(hi / lo), u)


def rescale_below(x: Column, u: Column, lo: float, hi: float) -> Column:
    """Only values below lo are drawn anew."""
    return F.when(x < lo, log_uniform(u, lo, hi)).otherwise(x)


def zero_count_limit(live_time: Column, confidence: float = 0.9) -> Column:
    """Upper limit of a rate when nothing was seen."""
    return -F.ln(F.lit(1 - confidence)) / live_time


def parabolic_offset(before: Column, at: Column, after: Column) -> Column:
    """Vertex of the parabola through three bins, at most half a bin away; 0 at an edge or where it isn't concave."""
    bend = before - 2 * at + after
    return F.when(before.isNull() | after.isNull() | (bend >= 0), 0.0).otherwise(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (before - after) / bend)))


def ordered_values(by_name: Column, order: Sequence[str], missing: float = 0.0) -> tuple[Column, Column]:
    """A map as an array in fixed order, and which entries were there."""
    names = F.array(*[F.lit(n) for n in order])
    return F.transform(names, lambda n: F.coalesce(F.try_element_at(by_name, n), F.lit(missing))), F.transform(names, lambda n: F.try_element_at(by_name, n).isNotNull())


def dilated_bins(bins: Column, radius: int, size: int) -> Column:
    """0/1 for each of `size` bins: whether one of the listed bins is within the radius."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.exists(bins, lambda b: F.abs(b - i) <= radius).cast("int"))


def relative_mask(power: Column, fraction: float = 0.08, least: float = 1e-12) -> Column:
    """1 where a plane reaches a share of its peak, and `least`: an empty plane has no mask."""
    return F.transform(power, lambda x: (x >= F.greatest(fraction * F.array_max(power), F.lit(least))).cast("int"))


def weak_mask(duration: Column, frequency: Column, quality: Column, frequency_bins: int, time_bins: int, fmin: float, fmax: float, span: float) -> Column:
    """0/1 plane (an array of frequencies of arrays of times) of the rectangle about a trigger: half its duration, one
    time bin at least, to both sides of the middle; frequency / quality, one bin at least, to both sides of its peak."""
    half_time = F.least(F.greatest(duration / 2, F.lit(span / time_bins)), F.lit(span / 2))
    half_frequency = F.greatest(F.lit((fmax - fmin) / max(frequency_bins - 1, 1)), frequency / quality)
    time = lambda i: (i * F.lit(span / time_bins) - span / 2)
    at = lambda i: i * F.lit((fmax - fmin) / max(frequency_bins - 1, 1)) + fmin
    columns = F.transform(F.sequence(F.lit(0), F.lit(time_bins - 1)), lambda i: (F.abs(time(i)) <= half_time).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(frequency_bins - 1)), lambda i: F.when(F.abs(at(i) - frequency) <= half_frequency, columns).otherwise(F.array_repeat(F.lit(0), time_bins)))


def weak_masks(duration: Column, frequency: Column, quality: Column, event: Column, order: Sequence[str], qualities: Sequence[float], frequency_bins: int, time_bins: int, fmin: float, fmax: float, span: float) -> Column:
    """`weak_mask` for each detector in order and each resolution: array of detectors of arrays of planes. Only the
    trigger's own detector is marked, in all resolutions alike, since a trigger says nothing about one of them; a null
    detector marks none, and a null duration, frequency or quality gives null."""
    plane = weak_mask(duration, frequency, quality, frequency_bins, time_bins, fmin, fmax, span)
    none = F.array_repeat(F.array_repeat(F.lit(0), time_bins), frequency_bins)
    masks = F.transform(F.array(*[F.lit(x) for x in order]), lambda x: F.array_repeat(F.when(F.coalesce(x == event, F.lit(False)), plane).otherwise(none), len(qualities)))
    return F.when(duration.isNotNull() & frequency.isNotNull() & quality.isNotNull(), masks)


def detector_availability(usable: Column, order: Sequence[str], event: Column) -> tuple[Column, Column]:
    """0/1 for each detector in order from a map of flags, and why a set of them can't be used (null if it can)."""
    flags = F.transform(F.array(*[F.lit(x) for x in order]), lambda x: F.coalesce(F.try_element_at(usable, x), F.lit(False)).cast("int"))
    own = F.coalesce(F.try_element_at(usable, event), F.lit(False)) & event.isin(*order)
    total = F.aggregate(flags, F.lit(0), lambda a, x: a + x)
    return flags, F.when(~own, "event_ifo_unusable").when(total < 2, "fewer_than_two_usable_detectors")


def peak_time(profiles: Column, start: Column, duration: Column) -> tuple[Column, Column, Column]:
    """Of an array of time profiles (one for each resolution and frequency): the largest value, the first time bin that
    has it, and the time of that bin's middle."""
    score = F.array_max(F.transform(profiles, lambda p: F.array_max(p)))
    at = F.array_min(F.transform(F.filter(profiles, lambda p: F.array_max(p) == score), lambda p: F.array_position(p, score))) - 1
    return score, at.cast("int"), start + (at + 0.5) / F.size(F.element_at(profiles, 1)) * duration


def known_label(label: Column, confidence: Column, excluded: Sequence[str], least: float) -> Column:
    """Labels that aren't excluded, with enough confidence; nulls fail."""
    return F.coalesce(~label.isin(*excluded) & (confidence >= least), F.lit(False))


def all_gates(**gates: Column) -> tuple[Column, Column]:
    """Gates by name, nulls as failed, and whether all pass."""
    closed = {k: F.coalesce(c, F.lit(False)) for k, c in gates.items()}
    every = F.lit(True)
    for c in closed.values():
        every &= c
    return F.create_map(*[x for k, c in closed.items() for x in (F.lit(k), c)]), every


def mask_iou(a: Column, b: Column) -> Column:
    """Jaccard index of two 0/1 arrays of one length; two empty ones are equal."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: ((x != 0) & (y != 0)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    either = F.aggregate(F.zip_with(a, b, lambda x, y: ((x != 0) | (y != 0)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(either == 0, 1.0).otherwise(both / either)


def set_jaccard(a: Column, b: Column) -> Column:
    return F.when(F.size(F.array_union(a, b)) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def retention(signal: Column, cleaned: Column, noise: Column) -> Column:
    """Share of the signal left after cleaning: projection of (cleaned - noise) on it."""
    return dot(F.zip_with(cleaned, noise, lambda x, y: x - y), signal) / dot(signal, signal)


def mean_squared_error(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def interval_pair(s1: Column, e1: Column, s2: Column, e2: Column, score1: Column, score2: Column, limit: float, width_scale: float) -> dict[str, Column]:
    """Features of two intervals of different detectors that need no truth: the gap between them and whether it is
    within the limit, by how much their middles are further apart than it, their widths and their log-odds."""
    clip = lambda x: F.least(F.lit(1 - 1e-7), F.greatest(F.lit(1e-7), x))
    log_odds = lambda x: F.ln(clip(x) / (1 - clip(x)))
    width = (e1 - s1) + (e2 - s2)
    gap = F.greatest(F.lit(0.0), s1 - e2, s2 - e1)
    excess = F.greatest(F.lit(0.0), F.abs((s1 + e1) / 2 - (s2 + e2) / 2) - limit)
    return {
        "compatible": gap <= limit,
        "interval_gap_seconds": gap,
        "center_excess_normalized": excess / F.greatest(width / 2, F.lit(float(width_scale))),
        "width_sum_normalized": width / width_scale,
        "proposal_logit_sum": log_odds(score1) + log_odds(score2),
    }


def interval_pair_vector(s1: Column, e1: Column, p1: Column, s2: Column, e2: Column, p2: Column, score1: Column, score2: Column, limit: float, width_scale: float) -> Column:
    """The sixteen numbers that a pair is ranked by: scores (5), widths (5), gap, excess of the middles, distance of the
    peaks (32 widths at most), overlap, and where in its interval each peak lies. p1, p2 are the peaks."""
    base = interval_pair(s1, e1, s2, e2, score1, score2, limit, width_scale)
    w1, w2 = e1 - s1, e2 - s2
    five = lambda a, b: [a, b, F.least(a, b), F.greatest(a, b), F.abs(a - b)]
    shared = F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))
    rest = [base["interval_gap_seconds"] / limit, base["center_excess_normalized"], F.least(F.abs(p1 - p2) / width_scale, F.lit(32.0)), shared / width_scale, (p1 - s1) / w1, (p2 - s2) / w2]
    return F.array(*[x.cast("float") for x in five(score1, score2) + [x / width_scale for x in five(w1, w2)] + rest])
