"""Row scores: column functions of a prediction and an answer."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

from scorewright.functions.alignment import damerau_distances, edit_distance_of, matched_characters
from scorewright.functions.text import let, literal_map, normalise_answer, strip_space, words

FLOAT = T.DoubleType()


def as_number(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)).cast("double")


def exact(pred: Column, gold: Column, ignore_case: bool = True) -> Column:
    if ignore_case:
        pred, gold = F.lower(strip_space(pred)), F.lower(strip_space(gold))
    return as_number(pred == gold)


def contains_answer(pred: Column, golds: Column, formula: bool = False) -> Column:
    """1 when any gold occurs in the prediction; formulas are compared without blanks, other text without case."""
    def flat(x: Column) -> Column:
        x = F.replace(strip_space(x), F.lit("\n"), F.lit(" "))
        return F.replace(x, F.lit(" "), F.lit("")) if formula else F.lower(x)

    return as_number(F.exists(golds, lambda g: flat(pred).contains(flat(g))))


def consensus(pred: Column, golds: Column) -> Column:
    """For each gold: matches of the prediction among the other golds, a third each, at most 1."""
    same = F.size(F.filter(golds, lambda g: g == pred))
    return F.transform(golds, lambda g: F.least(F.lit(1.0), (same - F.when(g == pred, 1).otherwise(0)) / 3))


def vqa_consensus(pred: Column, golds: Column) -> Column:
    both = F.struct(normalise_answer(pred).alias("p"), F.transform(golds, normalise_answer).alias("g"))
    return let(both, lambda s: consensus(s["p"], s["g"]))


def default_vqa(pred: Column, golds: Column) -> Column:
    return let(normalise_answer(pred), lambda p: F.transform(golds, lambda g: (normalise_answer(g) == p).cast("double")))


def array_mean(values: Column) -> Column:
    # bound: the sum and both sizes read the values
    return let(values, lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)))


@F.pandas_udf(T.IntegerType())
def edit_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    """Insert, delete and replace distance of two texts; long texts take a step a character, where ``levenshtein`` fills a table."""
    return pd.Series([None if a is None or b is None else edit_distance_of(a, b) for a, b in zip(left, right)], dtype="Int32")


def edit_ratio(gold: Column, pred: Column, distance=edit_distance) -> Column:
    """Edit distance of the folded texts over the longer raw length; 0 = equal. ``distance`` is ``F.levenshtein`` for short texts or within a lambda."""
    fold = lambda x: F.array_join(words(F.lower(x)), " ")
    longest = F.greatest(F.length(gold), F.length(pred))
    return F.when(longest == 0, 0.0).otherwise(distance(fold(gold), fold(pred)) / longest)


def anls(gold: Column, pred: Column, threshold: float = 0.5, strict: bool = False, distance=edit_distance) -> Column:
    """1 - edit share; zero at or below the threshold (``strict``: only below it). ``distance`` as in ``edit_ratio``."""
    longest = F.greatest(F.length(gold), F.length(pred))
    value = F.when(longest == 0, 1.0).otherwise(1 - distance(gold, pred) / longest)
    low = value < threshold if strict else value <= threshold
    return F.when(low, 0.0).otherwise(value)


def percent_number(text: Column) -> Column:
    """Number of the text; a trailing percent sign divides by 100."""
    bare = strip_space(text)
    plain = F.regexp_replace(bare, "%+$", "").try_cast("double")
    return F.when(text.endswith("%"), plain / 100).otherwise(bare.try_cast("double"))


def relaxed_number(pred: Column, gold: Column, tolerance: float = 0.05, denominator: str = "prediction") -> Column:
    """Numbers within a relative change; other values by equality without case. A zero base falls back to text."""
    p, g = percent_number(pred), percent_number(gold)
    base, other = (p, g) if denominator == "prediction" else (g, p)
    near = F.abs(other - base) / F.abs(F.nullif(base, F.lit(0.0))) <= tolerance
    numeric = other.isNotNull() & base.isNotNull() & (base != 0)
    return F.when(numeric, as_number(near)).otherwise(as_number(F.lower(pred) == F.lower(gold)))


def _decimals(number: Column) -> Column:
    text = number.cast("string")
    return F.when(text.contains("."), F.length(F.split_part(text, F.lit("."), F.lit(-1)))).otherwise(3)


def close_number(gold: Column, pred: Column, percentage: bool = True, close: bool = True) -> Column:
    """Equal at the stated precision or within 1 %, also after a factor of 100 either way."""
    clean = lambda x: strip_space(F.regexp_replace(strip_space(x.cast("string")), "%+$", "")).try_cast("double")
    g, p = clean(gold), clean(pred)
    scales = F.array(*([g / 100, g, g * 100] if percentage else [g]))

    def same(x: Column) -> Column:
        places = F.greatest(F.least(_decimals(p), _decimals(x)), F.lit(2))
        factor = F.pow(F.lit(10.0), places)
        rounded = F.rint(p * factor) == F.rint(x * factor)
        within = F.abs(x - p) <= 0.01 * F.greatest(F.abs(x), F.abs(p))
        return (within | rounded) if close else rounded

    return as_number(p.isNotNull() & F.exists(scales, same))


def clean_string(text: Column) -> Column:
    """Lower case without bracketed parts, outer quotes, a leading $ and a trailing %."""
    x = F.regexp_replace(strip_space(F.lower(text)), r"\s*\([^)]*\)", "")
    x = F.regexp_replace(strip_space(x), r"^['\"]|['\"]$", "")
    x = F.regexp_replace(strip_space(x), r"^\$+", "")
    return strip_space(F.regexp_replace(strip_space(x), "%+$", ""))


def needs_exact(text: Column) -> Column:
    """Links, code files, page names, phone numbers, times, dates and mail addresses are compared exactly."""
    return (text.contains("https://") | text.endswith(".py") | text.endswith("ipynb") | text.startswith("page")
            | text.rlike(r"^\d+(-\d+|\s\d+)?$") | text.contains("a.m.") | text.contains("p.m.")
            | text.rlike(r"^\d{4}[-\s]\d{2}[-\s]\d{2}$") | text.rlike(r"^\d{4}[-\s]\d{2}$")
            | text.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"))


def typed_score(gold: Column, pred: Column, kind: Column, gold_list: Column, pred_list: Column) -> Column:
    """Score by answer type: Int, Float, Str, else sorted lists compared pair by pair."""
    as_int = as_number(gold.try_cast("int") == F.floor(pred.try_cast("double")))
    as_float = close_number(clean_string(gold), clean_string(pred))
    g, p = clean_string(gold), clean_string(pred)
    as_text = F.when(needs_exact(g), as_number(g == p)).otherwise(anls(g, p, distance=F.levenshtein))
    gs, ps = F.array_sort(F.transform(gold_list, clean_string)), F.array_sort(F.transform(pred_list, clean_string))
    first = F.try_element_at(gs, F.lit(1))
    joined = as_number(F.array_join(gs, "-") == F.array_join(ps, "-"))
    worst = F.array_min(F.zip_with(gs, ps, lambda a, b: anls(a, b, distance=F.levenshtein)))
    as_list = F.when(F.size(gs) != F.size(ps), 0.0).when(first.try_cast("double").isNotNull() | needs_exact(first), joined).otherwise(worst)
    return F.when(kind == "Int", as_int).when(kind == "Float", as_float).when(kind == "Str", as_text).otherwise(as_list)


def numeric_equal(pred: Column, gold: Column, tolerance: float = 1e-6) -> Column:
    p, g = F.lower(strip_space(pred)), F.lower(strip_space(gold))
    return as_number((p == g) | F.coalesce(F.abs(p.try_cast("double") - g.try_cast("double")) < tolerance, F.lit(False)))


def quoted_pattern(text: Column) -> Column:
    """The text as a regular expression that matches only itself."""
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def has_word(sentence: Column, word: Column) -> Column:
    return F.regexp_count(sentence, F.concat(F.lit(r"(?U)\b"), quoted_pattern(word), F.lit(r"\b"))) > 0


def word_match(answer: Column, golds: Column) -> Column:
    return let(normalise_answer(answer), lambda a: as_number(F.exists(golds, lambda g: has_word(a, normalise_answer(g)))))


def reciprocal_rank(answer: Column, golds: Column) -> Column:
    """1 / position of the first gold that occurs as a whole word; 0 if none does."""
    hits = let(normalise_answer(answer), lambda a: F.transform(golds, lambda g: has_word(a, normalise_answer(g))))
    at = F.array_position(hits, F.lit(True))
    return F.when(at > 0, 1.0 / at).otherwise(0.0)


def aligned_list_accuracy(pred: Column, gold: Column) -> Column:
    same = F.zip_with(F.slice(pred, 1, F.size(gold)), gold, lambda p, g: F.coalesce(p == g, F.lit(False)))
    return F.size(F.filter(same, lambda x: x)) / F.size(gold)


def _members(tokens: pa.Array, among: pa.Array) -> pa.Array:
    """Of each pair of lists: elements of the first that the second holds, with both sizes; a pair with a null has none.

    The texts of a batch are numbered once, so elements are looked up as (row, number) and not compared as texts.
    """
    sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (tokens, among)]
    parts = [tokens.flatten(), among.flatten()]
    numbers = pa.concat_arrays(parts).dictionary_encode()
    place = numbers.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.concatenate([np.repeat(np.arange(len(n)), n) for n in sizes])
    keys = row * max(1, len(numbers.dictionary)) + place
    held = pc.is_in(pa.array(keys[: len(parts[0])]), value_set=pa.array(keys[len(parts[0]) :])).to_numpy(zero_copy_only=False)
    found = np.bincount(row[: len(parts[0])][held], minlength=len(tokens))
    columns = [pa.array(x, pa.int32()) for x in (found, *sizes)]
    return pa.StructArray.from_arrays(columns, names=["found", "tokens", "among"], mask=pc.or_(pc.is_null(tokens), pc.is_null(among)))


members = F.arrow_udf(_members, T.StructType([T.StructField(n, T.IntegerType()) for n in ("found", "tokens", "among")]))


def token_f1(gold: Column, pred: Column) -> Column:
    """F1 from membership: predicted tokens found among the gold tokens over either token count."""
    n = members(words(pred), words(gold))
    recall, precision = n["found"] / F.nullif(n["among"], F.lit(0)), n["found"] / F.nullif(n["tokens"], F.lit(0))
    f1 = 2 * recall * precision / F.nullif(recall + precision, F.lit(0.0))
    return F.when(recall + precision > 1e-4, f1).otherwise(0.0)


def jaccard(pred: Column, gold: Column, ignore_case: bool = False) -> Column:
    if ignore_case:
        pred, gold = F.transform(pred, F.lower), F.transform(gold, F.lower)
    union = F.size(F.array_union(pred, gold))
    return F.when(pred.isNull(), 0.0).when(union == 0, 1.0).otherwise(F.size(F.array_intersect(pred, gold)) / union)


def set_equality(pred: Column, gold: Column, ignore_case: bool = False) -> Column:
    if ignore_case:
        pred, gold = F.transform(pred, F.upper), F.transform(gold, F.upper)
    return as_number(F.array_sort(F.array_distinct(pred)) == F.array_sort(F.array_distinct(gold)))


def set_precision(pred: Column, gold: Column) -> Column:
    n = F.size(F.array_distinct(pred))
    return F.when(pred.isNull(), 0.0).when(n == 0, 1.0).otherwise(F.size(F.array_intersect(pred, gold)) / n)


def sequence_equality(pred: Column, gold: Column, ignore_case: bool = False) -> Column:
    if ignore_case:
        pred, gold = F.transform(pred, F.lower), F.transform(gold, F.lower)
    return as_number(pred == gold)


def prefix_ratio(pred: Column, gold: Column) -> Column:
    """Length of the common prefix over the gold length."""
    n = F.least(F.size(pred), F.size(gold))
    equal = F.zip_with(F.slice(pred, F.lit(1), n), F.slice(gold, F.lit(1), n), lambda a, b: a == b)
    first_miss = F.array_position(equal, F.lit(False))
    return F.when(first_miss > 0, first_miss - 1).otherwise(n) / F.size(gold)


def sequence_accuracy(pred: Column, gold: Column) -> Column:
    same = F.filter(F.zip_with(pred, gold, lambda a, b: F.lower(a) == F.lower(b)), lambda x: x)
    return F.when(F.size(pred) != F.size(gold), 0.0).otherwise(F.size(same) / F.size(gold))


def dict_equality(pred: Column, gold: Column) -> Column:
    entries = lambda m: F.array_sort(F.map_entries(m))
    return as_number(entries(pred) == entries(gold))


def dict_key_recall(pred: Column, gold: Column) -> Column:
    hits = F.filter(F.map_entries(gold), lambda e: exact_string(F.coalesce(F.try_element_at(pred, e["key"]), F.lit("None")), e["value"]) == 1.0)
    return F.size(hits) / F.size(F.map_keys(gold))


def dict_precision(pred: Column, gold: Column) -> Column:
    hits = F.filter(F.map_entries(pred), lambda e: F.coalesce(exact_string(e["value"], F.try_element_at(gold, e["key"])), F.lit(0.0)) == 1.0)
    n = F.size(F.map_keys(pred))
    return F.when(n == 0, 0.0).otherwise(F.size(hits) / n)


def dict_mean(pred: Column, gold: Column, value_score) -> Column:
    """Mean of a value score over the union of the keys; a key missing on one side counts as an empty list."""
    def scores(s: Column) -> Column:
        side = lambda m, k: F.coalesce(F.try_element_at(m, k), F.array())
        return F.transform(F.array_union(F.map_keys(s["p"]), F.map_keys(s["g"])), lambda k: value_score(side(s["p"], k), side(s["g"], k)))

    return array_mean(let(F.struct(pred.alias("p"), gold.alias("g")), scores))


def exact_string(pred: Column, gold: Column) -> Column:
    """Equality; a one-letter gold is compared with the leading letter of a longer prediction."""
    single = F.regexp_extract(pred, r"^\(?([A-Za-z])\)?(?:\s*\.\s*|\.)?", 1)
    letter = (F.length(gold) == 1) & gold.rlike(r"^\p{L}$") & (F.length(pred) > 1)
    return as_number(F.when(letter & (single != ""), single).otherwise(pred) == gold)


def _squeeze(text: Column) -> Column:
    return F.lower(F.translate(text, " -\n\t.", ""))


def simple_string(pred: Column, gold: Column) -> Column:
    return exact_string(_squeeze(pred), _squeeze(gold))


def near_string(pred: Column, gold: Column, threshold: float = 0.9) -> Column:
    """Similarity of the texts without articles, zero below the threshold (insert, delete, replace distance)."""
    bare = lambda x: F.lower(strip_space(F.regexp_replace(F.regexp_replace(x, r"(?i)\b(the|an|a)\b", ""), r"\s+", " ")))
    p, g = bare(pred), bare(gold)
    longest = F.greatest(F.length(p), F.length(g))
    value = F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(p, g) / longest)
    return F.when(value >= threshold, value).otherwise(0.0)


@F.pandas_udf(FLOAT)
def _damerau(left: pd.Series, right: pd.Series) -> pd.Series:
    """Distances of the pairs, null where a side is null."""
    held = left.notna() & right.notna()
    out = pd.Series(float("nan"), left.index, dtype="float64")
    out[held] = damerau_distances(list(zip(left[held], right[held]))).astype("float64")
    return out


def damerau_similarity(left: Column, right: Column) -> Column:
    """1 - unrestricted Damerau distance over the longer length.

    A transposition replaces two other edits at the most, so texts at most one edit apart need no table.
    """
    def similar(x: Column) -> Column:
        longest = F.greatest(F.length(x["a"]), F.length(x["b"]))
        return F.when(longest == 0, 1.0).otherwise(1 - x["d"] / longest)

    both = left.isNotNull() & right.isNotNull()
    plain = F.levenshtein(left, right)
    asked = both & (plain > 1)
    distance = F.coalesce(_damerau(F.when(asked, left), F.when(asked, right)), plain.cast("double"))
    return F.when(both, let(F.struct(left.alias("a"), right.alias("b"), distance.alias("d")), similar))


def multi_reference(pred: Column, references: Column) -> Column:
    return as_number(F.exists(references, lambda r: simple_string(pred, r) == 1.0))


def positive_int(pred: Column, gold: Column) -> Column:
    """Equality of integers; -1 when neither is positive, 0 when the prediction is no integer."""
    p, g = strip_space(pred).try_cast("bigint"), strip_space(gold).try_cast("bigint")
    return F.when(p.isNull() | g.isNull(), 0.0).when((g <= 0) & (p <= 0), -1.0).otherwise(as_number(p == g))


def relative_difference(pred: Column, gold: Column) -> Column:
    return F.when(pred.isNull() | gold.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs((pred - gold) / F.nullif(gold, F.lit(0.0)))))


def mean_square(pred: Column, gold: Column) -> Column:
    return array_mean(F.zip_with(pred, gold, lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2.0))))


def normalised_rmse(pred: Column, gold: Column, top: float = 0.1) -> Column:
    return 1 - F.least(F.sqrt(mean_square(pred, gold)), F.lit(top)) / top


def general_number(pred: Column, gold: Column) -> Column:
    """Numbers after an equals sign and without units, within 1 % of the gold; else simple text equality."""
    def right_side(x: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(x, r"\\\((.*?)\\\)", "$1"), r"\\\[(.*?)\\\]", "$1")
        tail = strip_space(F.regexp_extract(x, r"(?:=|≈|\\approx)\s*(.+)", 1))
        return F.when(tail != "", tail).otherwise(x)

    def value(x: Column) -> Column:
        x = F.regexp_replace(x, r"[$¥]|°C| C|°", "")
        bare = strip_space(F.regexp_replace(x, "%$", "")).try_cast("double")
        return F.when(x.endswith("%"), bare / 100).otherwise(bare)

    p, g = value(right_side(pred)), value(right_side(gold))
    close = F.abs(p - g) <= F.abs(g) * 0.01
    return F.when(p.isNotNull() & g.isNotNull(), as_number(close)).otherwise(simple_string(right_side(pred), right_side(gold)))


def boxed(text: Column) -> Column:
    inner = F.regexp_extract(text, r"\\boxed\{((?:[^\{\}]+|\{[^\{\}]*\})*)\}", 1)
    return F.when(inner != "", inner).otherwise(text)


def geo_proximity(lat1: Column, lon1: Column, lat2: Column, lon2: Column, scale_km: float = 100.0) -> Column:
    """exp(-distance / scale) with the great-circle distance on the mean earth radius."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.exp(-(2 * 6371.0088 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))) / scale_km)


def coordinate_sequence(pred: Column, gold: Column, k: float = 10.0) -> Column:
    """Mean exp(-k d / sqrt 2) over paired points; 0 when the lengths differ."""
    one = lambda p, g: F.exp(-k * F.sqrt(F.pow(p[0] - g[0], F.lit(2.0)) + F.pow(p[1] - g[1], F.lit(2.0))) / math.sqrt(2))
    return F.when(F.size(pred) != F.size(gold), 0.0).otherwise(array_mean(F.zip_with(pred, gold, one)))


def box_iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union of (x1, y1, x2, y2) boxes; 0 when they do not meet or have no area."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def array_box_iou(a: Column, b: Column) -> Column:
    """``box_iou`` of boxes held as arrays, for lambdas, which work out a repeated part again: sides, shared part and union are bound."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    area = lambda box: (box[2] - box[0]) * (box[3] - box[1])
    parts = lambda shared: F.struct(shared.alias("shared"), (area(a) + area(b) - shared).alias("union"))
    return let(let(side(0, 2) * side(1, 3), parts), lambda p: F.when(p["union"] > 0, p["shared"] / p["union"]).otherwise(0.0))


def boxes_mean_iou(pred: Column, gold: Column) -> Column:
    """Mean over predicted boxes of the best overlap with any gold box; 0 without predictions."""
    best = F.transform(pred, lambda p: F.coalesce(F.array_max(F.transform(gold, lambda g: array_box_iou(p, g))), F.lit(0.0)))
    return F.coalesce(array_mean(best), F.lit(0.0))


def centre_in_box(pred: Sequence[Column], gold: Sequence[Column]) -> Column:
    x, y = (pred[0] + pred[2]) / 2, (pred[1] + pred[3]) / 2
    return as_number(x.between(gold[0], gold[2]) & y.between(gold[1], gold[3]))


def relative_box(x: Column, y: Column, w: Column, h: Column, img_w: Column, img_h: Column) -> list[Column]:
    """(x, y, w, h) pixels to relative corners; the far corner is inclusive and -1 counts as 0."""
    safe = lambda v: F.when(v == -1, 0).otherwise(v)
    return [safe(x) / img_w, safe(y) / img_h, safe(x + w - 1) / img_w, safe(y + h - 1) / img_h]


def click_in_box(px: Column, py: Column, box: Sequence[Column], img_w: Column, img_h: Column) -> Column:
    """Click inside the relative box; clicks beyond 1 are pixels."""
    pixels = (px > 1) | (py > 1)
    x, y = F.when(pixels, px / img_w).otherwise(px), F.when(pixels, py / img_h).otherwise(py)
    return as_number(x.between(box[0], box[2]) & y.between(box[1], box[3]))


def point_distance_to_box(px: Column, py: Column, box: Sequence[Column]) -> Column:
    out = lambda p, lo, hi: F.greatest(F.lit(0.0), F.abs(p - (lo + hi) / 2) - (hi - lo) / 2)
    return F.sqrt(F.pow(out(px, box[0], box[2]), F.lit(2.0)) + F.pow(out(py, box[1], box[3]), F.lit(2.0)))


def merged_intervals(intervals: Column) -> Column:
    """Union of the intervals of one row as disjoint sorted intervals."""
    ordered = F.array_sort(intervals)

    def step(acc: Column, cur: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.array(last[0], F.greatest(last[1], cur[1]))))
        return F.when((F.size(acc) > 0) & (cur[0] <= last[1]), joined).otherwise(F.concat(acc, F.array(cur)))

    return F.aggregate(ordered, F.array().cast("array<array<double>>"), step)


def interval_array_iou(a: Column, b: Column) -> Column:
    """Overlap over union of two interval lists held in one row."""
    length = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + (x[1] - x[0]))
    ma, mb = merged_intervals(a), merged_intervals(b)
    both = F.aggregate(ma, F.lit(0.0), lambda s, x: s + F.aggregate(
        mb, F.lit(0.0), lambda t, y: t + F.greatest(F.lit(0.0), F.least(x[1], y[1]) - F.greatest(x[0], y[0]))))
    union = length(ma) + length(mb) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def single_interval_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over the hull of two intervals."""
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(hull == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2)) / hull)


def graded_count_score(pred: Column, gold: Column, images: Column) -> Column:
    """100 for the right count, falling with the tenth root of the relative error."""
    worst = F.greatest(gold - 1, images - gold)
    worst = F.when(worst <= 0, 1).otherwise(worst)
    penalty = (4 / images) * F.pow(F.abs(pred - gold) / worst, F.lit(0.1))
    return (F.when(pred.isNull(), 0.0).when(pred == gold, 100.0)
            .otherwise(F.when(penalty < 1, 100 * (1 - penalty)).otherwise(0.0)))


def single_option_match(pred: Column, gold: Column) -> Column:
    head = lambda x: strip_space(F.split_part(x, F.lit(")"), F.lit(1)))
    return as_number((F.regexp_count(pred, F.lit(r"\([A-Z]\)")) <= 1) & (head(pred) == head(gold)))


def first_char_or_phrase(gold: Column, pred: Column) -> Column:
    """Letter answers by first character, other answers by containing the gold text from its fifth character."""
    letter = (F.length(pred) == 1) | pred.rlike("^[A-D]")
    same = F.substring(pred, 1, 1) == F.substring(gold, 1, 1)
    return as_number(F.when(letter, same).otherwise(F.lower(pred).contains(F.lower(F.substring(gold, F.lit(5), F.length(gold))))))


def option_pair_match(pred: Column, gold: Column, digits: bool = False) -> Column:
    """First tokens contained in each other; with ``digits`` also the gold text (one digit as a word) inside the prediction."""
    low = lambda x: F.lower(strip_space(x))
    p, g = F.split_part(low(pred), F.lit(" "), F.lit(1)), F.split_part(low(gold), F.lit(" "), F.lit(1))
    hit = g.contains(F.replace(p, F.lit("."), F.lit(""))) | p.contains(g)
    if digits:
        strip = lambda x: F.regexp_replace(x, r"^[. \n]+|[. \n]+$", "")
        body = F.regexp_replace(F.substring(low(gold), F.length(g) + 2, F.length(gold)), r"\.$", "")
        names = literal_map({str(i): w for i, w in enumerate("zero one two three four five six seven eight nine".split())})
        body = F.coalesce(F.try_element_at(names, strip(body)), body)
        hit = hit | strip(low(pred)).contains(strip(body))
    return as_number(hit)


def choice_or_line_match(pred: Column, letter: Column, text: Column) -> Column:
    return as_number((pred == letter) | pred.contains(F.concat(letter, F.lit("."))) | (pred == text) | F.array_contains(F.split(pred, "\n"), letter))


def category_equal(pred: Column, gold: Column, synonyms: Mapping[str, str]) -> Column:
    """Equality without case; none = no, 0 = No, number words, counts for yes, and a synonym table on the first word."""
    numbers = literal_map({w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine ten".split())})
    p = F.when(F.lower(pred) == "none", "no").otherwise(pred)
    family = lambda x: F.try_element_at(literal_map(synonyms), F.split_part(F.lower(x), F.lit(" "), F.lit(1)))
    return as_number((F.lower(p) == F.lower(gold)) | ((p == "0") & (gold == "No"))
                     | F.coalesce(F.try_element_at(numbers, F.lower(p)) == gold, F.lit(False))
                     | ((F.lower(gold) == "yes") & p.rlike("^[1-9]$"))
                     | F.coalesce(family(p) == family(gold), F.lit(False)))


def closeness(gold: Column, pred: Column, scale: float = 0.5) -> Column:
    return F.greatest(F.lit(0.0), (scale - F.abs(gold - pred)) / scale)


def fact_penalty(facts: Column, gamma: float = 10.0) -> Column:
    """1 above ``gamma`` facts, exp(1 - gamma / n) otherwise."""
    return F.when(facts > gamma, 1.0).otherwise(F.exp(1 - gamma / facts))


@F.pandas_udf(FLOAT)
def matcher_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-block similarity 2M/T of two texts; 1 for two empty ones."""
    size = left.str.len() + right.str.len()
    return (2 * pd.Series(matched_characters(list(zip(left, right))), left.index) / size.where(size > 0)).fillna(1.0).astype("float64")


def cell_text(text: Column) -> Column:
    """Table cell without citations, bracketed details, outer quotes and final full stop, in lower case."""
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[‘’´`]", "'"), "[“”]", '"'), "[‐‑‒–—−]", "-")
    for _ in range(2):
        x = F.regexp_replace(strip_space(x), r"((?<!^)\[[^\]]*\]|\[\d+\]|[•♦†‡*#+])*$", "")
        x = F.regexp_replace(strip_space(x), r"(?<!^)( \([^)]*\))*$", "")
        x = F.regexp_replace(strip_space(x), r'^"([^"]*)"$', "$1")
    return strip_space(F.lower(F.regexp_replace(F.regexp_replace(x, r"\.$", ""), r"\s+", " ")))


def table_value(text: Column) -> Column:
    """Comparable form of a table cell: number, date or normalised text."""
    def value(x: Column) -> Column:
        number = F.replace(x, F.lit(","), F.lit("")).try_cast("double")
        date = F.to_date(F.when(x.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.regexp_replace(F.regexp_replace(x, r"-(\d)(?!\d)", "-0$1"), r"-(\d)-", "-0$1-")))
        return F.coalesce(F.concat(F.lit("n:"), number.cast("string")), F.concat(F.lit("d:"), date.cast("string")), F.concat(F.lit("s:"), x))

    return let(cell_text(text), value)


# Words a financial cell loses, and the powers of ten its scale words and percent sign stand for.
FINANCE_WORDS = "dollar|gallons|square feet|shares|mbtu|mbpd|mbbls|mmbtu|unit|gwh|year|mmcf|mile|mboe"
FINANCE_SCALES = {"thousand": 3, "million": 6, "billion": 9, "%": -2}


def finance_values(text: Column) -> Column:
    """(with_scale, without_scale) of a financial cell: numbers when both forms are numbers, else texts."""
    plain = F.regexp_replace(F.translate(cell_text(text), "$(),", ""), rf"(?i)\b(?:{FINANCE_WORDS})s?\b", "")
    scaled = free = plain
    for word, power in FINANCE_SCALES.items():
        form = rf" ?\b{word}\b" if word.isalpha() else f" ?{word}"
        scaled, free = F.regexp_replace(scaled, form, f"e{power}"), F.regexp_replace(free, form, "")
    number = lambda s: F.trim(s).try_cast("double").cast("string")
    both = number(scaled).isNotNull() & number(free).isNotNull()
    shown = lambda s: F.when(both, F.concat(F.lit("n:"), number(s))).otherwise(F.concat(F.lit("s:"), s))
    return F.struct(shown(scaled).alias("with_scale"), shown(free).alias("without_scale"))


def finance_scores(pred: Column, gold: Column) -> Column:
    """exact: the cells are equal with their scales; relaxed: some form of one equals some form of the other."""
    def compare(pair: Column) -> Column:
        p, g = pair["p"], pair["g"]
        exact = p["with_scale"] == g["with_scale"]
        relaxed = exact | (p["with_scale"] == g["without_scale"]) | (p["without_scale"] == g["with_scale"]) | (p["without_scale"] == g["without_scale"])
        return F.struct(exact.cast("double").alias("exact"), relaxed.cast("double").alias("relaxed"))

    return let(F.struct(finance_values(pred).alias("p"), finance_values(gold).alias("g")), compare)


def table_lists_equal(pred: Column, gold: Column) -> Column:
    """Order-free equality of cell lists as sets of values."""
    values = lambda a: F.array_sort(F.array_distinct(F.transform(a, table_value)))
    return as_number(values(pred) == values(gold))


def typed_equal(pred: Column, gold: Column, kind: Column) -> Column:
    same = lambda t: strip_space(pred).try_cast(t) == strip_space(gold).try_cast(t)
    return as_number(F.when(kind == "integer", same("bigint")).when(kind == "float", same("double")).otherwise(pred == gold))


def line_edit_similarity(gold: Column, pred: Column, distance=edit_distance) -> Column:
    """Edit distance over the longer length (0 = equal); null for two empty lines. ``distance`` as in ``edit_ratio``."""
    longest = F.greatest(F.length(gold), F.length(pred))
    return distance(gold, pred) / F.nullif(longest, F.lit(0))


def list_edit_distance(left: Column, right: Column) -> Column:
    """Insert / delete / replace distance between two lists: each distinct element becomes one character, null being an element too."""
    def distance(x: Column) -> Column:
        def text(values: Column) -> Column:
            # 2, 3, ... without the range that stands for halves of characters; the leading 1 is in both texts
            number = lambda v: F.array_position(x["all"], v).cast("bigint") + 1
            code = F.transform(values, lambda v: let(number(v), lambda n: F.lpad(F.hex(F.when(n >= 0xD800, n + 0x800).otherwise(n)), 8, "0")))
            return F.decode(F.unhex(F.concat(F.lit("00000001"), F.array_join(code, ""))), "UTF-32")

        return F.levenshtein(text(x["a"]), text(x["b"]))

    named = lambda values: F.transform(values, lambda v: F.coalesce(F.concat(F.lit("v"), v.cast("string")), F.lit("")))
    both = F.struct(named(left).alias("a"), named(right).alias("b"), F.array_union(named(left), named(right)).alias("all"))
    return F.when(left.isNotNull() & right.isNotNull(), let(both, distance))


@F.pandas_udf(T.IntegerType())
def shared_tokens(left: pd.Series, right: pd.Series) -> pd.Series:
    """Size of the overlap of two token lists taken as bags."""
    return pd.Series([None if a is None or b is None else (Counter(a) & Counter(b)).total() for a, b in zip(left, right)], dtype="Int32")


@F.pandas_udf(T.IntegerType())
def lcs_length(left: pd.Series, right: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two token lists."""

    def longest(a, b):
        # one bit per token of a; a cleared bit of ``open_`` ends one more matched token, and a step takes all of a at once
        places: dict = {}
        for i, x in enumerate(a):
            places[x] = places.get(x, 0) | 1 << i
        full = (1 << len(a)) - 1
        open_ = full
        for y in b:
            hit = open_ & places.get(y, 0)
            open_ = ((open_ + hit) | (open_ - hit)) & full
        return len(a) - open_.bit_count()

    return pd.Series([None if a is None or b is None else longest(list(a), list(b)) for a, b in zip(left, right)], dtype="Int32")


def reading_order_error(gold: Column, pred: Column) -> Column:
    return list_edit_distance(gold, pred) / F.nullif(F.greatest(F.size(gold), F.size(pred)), F.lit(0))


def pixel_error(a: Column, b: Column, peak: float = 255.0) -> Column:
    """Struct of mse, psnr and mae; the psnr of equal arrays is infinite."""
    mse = mean_square(a, b)
    mae = array_mean(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    psnr = F.when(mse == 0, F.lit(float("inf"))).otherwise(20 * F.log10(peak / F.sqrt(mse)))
    return F.struct(mse.alias("mse"), psnr.alias("psnr"), mae.alias("mae"))


def document_similarity(gold: Column, pred: Column) -> Column:
    """1 - edit share after code fences, blanks and line ends are removed; a missing prediction scores 0."""
    inside = F.when(pred.contains("```"), F.split_part(pred, F.lit("```"), F.lit(2))).otherwise(pred)
    flat = lambda x: F.translate(x, " \n", "")
    g, p = flat(gold), flat(inside)
    longest = F.greatest(F.length(g), F.length(p))
    return F.coalesce(F.when(longest == 0, 1.0).otherwise(1 - edit_distance(g, p) / longest), F.lit(0.0))


def true_false_fact(pred: Column, gold: Column) -> Column:
    """Null when both words occur (to be read by hand), 1 for the matching word, else 0."""
    low = F.lower(F.coalesce(pred, F.lit("none")))
    t, f = low.contains("true"), low.contains("false")
    return F.when(t & f, F.lit(None).cast("double")).when((t & (gold == "1")) | (f & (gold == "0")), 1.0).otherwise(0.0)


# --- text constraints -------------------------------------------------------------------------------------------

def lines_trimmed(text: Column) -> Column:
    # both forms begin with a blank, which is quickly looked for
    return strip_space(F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"(?m)(?=[ \t\x0B\f\r])(?:^[^\S\n]+|[^\S\n]+$)", ""))


def paragraphs(text: Column, trimmed: Column | None = None) -> Column:
    """Paragraphs end with an empty line. ``trimmed`` is what ``lines_trimmed`` gives for the text, if it is known."""
    return F.filter(F.split(lines_trimmed(text) if trimmed is None else trimmed, r"\n\s*\n"), lambda p: strip_space(p) != "")


def sentences(text: Column, trimmed: Column | None = None) -> Column:
    """Sentences end with . ! or ? (and closing quotes) before white space. ``trimmed`` is what ``lines_trimmed`` gives for the text, if it is known."""
    return F.filter(F.split(lines_trimmed(text) if trimmed is None else trimmed, r"(?=\s)(?:(?<=[.!?])|(?<=[.!?][\"')\]]))\s+"), lambda s: s != "")


def word_count(text: Column) -> Column:
    return F.size(words(F.regexp_replace(text, r"[^\p{L}\p{N}_\s.-]", "")))


def keyword_count(text: Column, keyword: str) -> Column:
    return F.regexp_count(F.lower(text), F.lit(r"(?U)\b" + re.escape(keyword.lower()) + r"\b"))


# number written with optional sign, groups, decimals, exponent and percent sign, standing alone
NUMBER = r"(?U)(?<!\w)[+-]?(?:\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?%?(?!\w)"
ARABIC = r"(?U)(?<![.\w])(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?%?|\d+\.\d+%?|\d+%?|\d+(?:\.\d+)?(?:[eE][+-]?\d+))(?![.\w])"


def _precision_ok(token: Column, places: int) -> Column:
    mantissa = F.split_part(F.lower(F.translate(token, ",%", "")), F.lit("e"), F.lit(1))
    return F.when(mantissa.contains("."), F.length(F.split_part(mantissa, F.lit("."), F.lit(-1))) == places).otherwise(F.lit(places == 0))


def text_constraint(rule: str, text: Column, *params, parts: tuple[Column, Column] | None = None) -> Column:
    """Boolean of a named text rule. ``parts`` are the paragraphs and sentences of the text, if they are known."""
    each = lambda parts, test: F.forall(parts, test)
    whole, ended = parts or (paragraphs(text), sentences(text))
    rules = {
        "paragraph_count": lambda lo, hi: F.size(whole).between(lo, hi),
        "sentence_count": lambda lo, hi: F.size(ended).between(lo, hi),
        "sentences_per_paragraph": lambda lo, hi: each(whole, lambda p: F.size(sentences(p)).between(lo, hi)),
        "sentences_per_listed_paragraph": lambda ranges: (F.size(whole) == len(ranges)) & F.forall(
            F.zip_with(whole, F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ranges]),
                       lambda p, r: F.coalesce(F.size(sentences(p)).between(r[0], r[1]), F.lit(False))), lambda x: x),
        "word_count": lambda lo, hi: word_count(text).between(lo, hi),
        "words_per_paragraph": lambda lo, hi: each(whole, lambda p: word_count(p).between(lo, hi)),
        "without_substrings": lambda *subs: ~F.exists(F.array(*[F.lit(s) for s in subs]), lambda s: text.contains(s)),
        "sentences_begin_with": lambda s: each(ended, lambda x: x.startswith(s)),
        "sentences_end_with": lambda s: each(ended, lambda x: x.endswith(s)),
        "paragraphs_begin_with": lambda s: each(whole, lambda x: x.startswith(s)),
        "paragraphs_end_with": lambda s: each(whole, lambda x: x.endswith(s)),
        "begins_with": lambda s: strip_space(text).startswith(s),
        "ends_with": lambda s: strip_space(text).endswith(s),
        "each_keyword_count": lambda keys, lo, hi: F.forall(F.array(*[keyword_count(text, k) for k in keys]), lambda n: n.between(lo, hi)),
        "total_keyword_count": lambda keys, lo, hi: sum((keyword_count(text, k) for k in keys), F.lit(0)).between(lo, hi),
        "percent_precision": lambda n: each(F.regexp_extract_all(text, F.lit(r"(\d+\.\d+|\d+)\s*%"), F.lit(1)),
                                            lambda x: x.contains(".") & (F.length(F.split_part(x, F.lit("."), F.lit(2))) == n)),
        "number_precision": lambda n: each(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: _precision_ok(x, n)),
        "no_arabic_number": lambda: F.regexp_count(text, F.lit(ARABIC)) == 0,
    }
    return rules[rule](*params)
