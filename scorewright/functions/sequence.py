"""Token sequences: column functions over arrays of ids, masks and labels."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.functions.text import let

IGNORE = -100


def ids_of(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def repeat(value: int, n: Column) -> Column:
    return F.array_repeat(F.lit(value), F.greatest(n, F.lit(0)).cast("int"))


def register_tokens(vocabulary: DataFrame, tokens: DataFrame) -> DataFrame:
    """Vocabulary (token, id) extended by the unseen tokens, numbered in token order after the highest id.

    Numbers come from the exact positions in range buckets, so no task holds all new tokens.
    """
    from scorewright.operators.skew import ranked
    new = tokens.select("token").distinct().join(vocabulary.select("token"), "token", "left_anti")
    top = vocabulary.agg(F.max("id")).scalar()
    numbered = ranked(new, ["token"], name="_place").select("token", (top + F.col("_place") + 1).cast("bigint").alias("id"))
    return vocabulary.select("token", F.col("id").cast("bigint")).unionByName(numbered)


def encode(df: DataFrame, key: str, tokens: str, vocabulary: DataFrame, unknown: int = 0, output: str = "ids") -> DataFrame:
    """Token arrays to id arrays; tokens outside the vocabulary get ``unknown``. ``key`` names a row."""
    from scorewright.operators.coding import coded
    return coded(df, key, tokens, vocabulary.select("token", F.col("id").cast("bigint").alias("id")), "token", "id", F.lit(unknown).cast("bigint"), output)


def decode(df: DataFrame, key: str, ids: str, vocabulary: DataFrame, output: str = "tokens", keep: bool = False) -> DataFrame:
    """Id arrays to token arrays; an id outside the vocabulary gives a null token. ``key`` names a row, ``keep`` returns the ids too."""
    from scorewright.operators.coding import coded
    return coded(df, key, ids, vocabulary.select(F.col("id").cast("bigint").alias("id"), "token"), "id", "token", F.lit(None).cast("string"), output, keep)


def with_bos(ids: Column, bos: int) -> Column:
    """The ids with a leading start token, added only when it is missing."""
    head = F.try_element_at(ids, F.lit(1))
    return F.when(F.size(ids) == 0, ids_of([bos])).when(head == bos, ids).otherwise(F.concat(ids_of([bos]), ids))


def _closed_text(ids: Column, bos: int, eos: int, length: int) -> Column:
    """Text of fixed length: start, ids, end, padded right with end tokens; over-long text keeps a final end token."""
    text = F.concat(with_bos(ids, bos), ids_of([eos]))
    padded = F.concat(text, repeat(eos, length - F.size(text)))
    return F.when(F.size(text) <= length, padded).otherwise(F.concat(F.slice(text, 1, length - 1), ids_of([eos])))


def _mask_upto(n: Column, length: Column) -> Column:
    """n ones followed by zeros."""
    return F.concat(repeat(1, n), repeat(0, length - n))


def header_end(ids: Column, marker: int) -> Column:
    """0-based position of the last marker, -1 when absent."""
    from_end = F.array_position(F.reverse(ids), F.lit(marker))
    return F.when(from_end > 0, F.size(ids) - from_end).otherwise(-1)


def sequence_struct(ids: Column, mask: Column, labels: Column | None = None) -> Column:
    parts = [ids.alias("ids"), mask.alias("mask")]
    return F.struct(*parts, *([labels.alias("labels")] if labels is not None else []))


def text_to_image(text: Column, image: Column, image_labels: Column | None, sp: Mapping[str, int], max_text: int, dropped: Column | None = None) -> Column:
    """[pad.. task bos text eos soi image eoi]; pads get mask 0 and label -100; a dropped condition keeps only bos and eos."""
    length = max_text + 1
    task = sp["t2i"]
    body = F.concat(ids_of([task]), with_bos(text, sp["bos"]), ids_of([sp["eos"]]))
    if dropped is not None:
        body = F.when(dropped, ids_of([task, sp["bos"], sp["eos"]])).otherwise(body)
    gap = F.greatest(length - F.size(body), F.lit(0))
    fixed = F.when(F.size(body) <= length, F.concat(repeat(sp["pad"], gap), body)).otherwise(F.concat(F.slice(body, 1, length - 1), ids_of([sp["eos"]])))
    join = lambda middle: F.concat(fixed, ids_of([sp["soi"]]), middle, ids_of([sp["eoi"]]))
    mask = F.concat(repeat(0, gap), repeat(1, length - gap + F.size(image) + 2))
    if image_labels is None:
        return sequence_struct(join(image), mask)
    labels = F.transform(join(image_labels), lambda x: F.when(x == sp["pad"], IGNORE).otherwise(x))
    return sequence_struct(join(image), mask, labels)


def lm(text: Column, sp: Mapping[str, int], max_len: int) -> Column:
    """Start, text, end, padded with end tokens or cut; labels are the ids and the mask is all ones."""
    ids = _right_padded(text, sp, max_len)
    return sequence_struct(ids, repeat(1, F.size(ids)), ids)


def _right_padded(text: Column, sp: Mapping[str, int], max_len: int) -> Column:
    body = F.concat(with_bos(text, sp["bos"]), ids_of([sp["eos"]]))
    return F.when(F.size(body) <= max_len, F.concat(body, repeat(sp["eos"], max_len - F.size(body)))).otherwise(F.slice(body, 1, max_len))


def chat(text: Column, sp: Mapping[str, int], max_len: int) -> Column:
    """As ``lm`` with a prompt mask up to and including the last header end."""
    ids = _right_padded(text, sp, max_len)
    return sequence_struct(ids, _mask_upto(header_end(ids, sp["header_end"]) + 1, F.size(ids)), ids)


def image_question(image: Column, text: Column, sp: Mapping[str, int], max_text: int, labels: bool = True) -> Column:
    """[task soi image eoi text]; labels -100 on the prefix; the prompt mask reaches the last header end."""
    fixed = _closed_text(text, sp["bos"], sp["eos"], max_text)
    prefix = F.concat(ids_of([sp["mmu"], sp["soi"]]), image, ids_of([sp["eoi"]]))
    ids = F.concat(prefix, fixed)
    mask = _mask_upto(F.size(prefix) + header_end(fixed, sp["header_end"]) + 1, F.size(ids))
    if not labels:
        return sequence_struct(ids, mask)
    label = F.concat(repeat(IGNORE, F.size(prefix)), F.transform(fixed, lambda x: F.when(x == sp["pad"], IGNORE).otherwise(x)))
    return sequence_struct(ids, mask, label)


def reasoning_to_image(image: Column, text: Column, sp: Mapping[str, int], max_text: int) -> Column:
    """[task text soi image eoi]; the mask covers the task, the prompt (all text without a header), soi and eoi."""
    fixed = _closed_text(text, sp["bos"], sp["eos"], max_text)
    ids = F.concat(ids_of([sp["r2i"]]), fixed, ids_of([sp["soi"]]), image, ids_of([sp["eoi"]]))
    end = header_end(fixed, sp["header_end"])
    prompt = F.when(end >= 0, end + 1).otherwise(F.size(fixed))
    mask = F.concat(repeat(1, prompt + 1), repeat(0, F.size(fixed) - prompt), ids_of([1]), repeat(0, F.size(image)), ids_of([1]))
    return sequence_struct(ids, mask, ids)


def driving(history: Column, text: Column, actions: Column, sp: Mapping[str, int], max_text: int, future: Column | None = None) -> Column:
    """[task soi history eoi text sep actions (sep soi future eoi)]; everything up to the first separator is prompt."""
    fixed = _closed_text(text, sp["bos"], sp["eos"], max_text)
    prefix = F.concat(ids_of([sp["drive"], sp["soi"]]), history, ids_of([sp["eoi"]]), fixed, ids_of([sp["action_sep"]]))
    tail = actions
    if future is not None:
        tail = F.concat(actions, ids_of([sp["future_sep"], sp["soi"]]), future, ids_of([sp["eoi"]]))
    ids = F.concat(prefix, tail)
    return sequence_struct(ids, _mask_upto(F.size(prefix), F.size(ids)), F.concat(repeat(IGNORE, F.size(prefix)), tail))


def join_history(frames: Column, separator: int) -> Column:
    """Frame id lists joined by the separator."""
    joined = F.flatten(F.transform(frames, lambda f: F.concat(f, ids_of([separator]))))
    return F.slice(joined, F.lit(1), F.greatest(F.size(joined) - 1, F.lit(0)))


def left_pad(ids: Column, length: Column, pad: int) -> Column:
    return F.concat(repeat(pad, length - F.size(ids)), ids)


def mask_schedule(t: Column, method: str = "cosine", start: float = -3, end: float = 3, tau: float = 1.0) -> Column:
    """Share of masked tokens at time t."""
    bound = lambda x: F.least(F.greatest(x, F.lit(1e-6)), F.lit(1.0))
    if method == "cosine":
        return F.cos(t * math.pi * 0.5)
    if method == "linear":
        return bound(1 - t)
    if method.startswith("pow"):
        return bound(1 - F.pow(t, F.lit(float(method[3:]))))
    if method == "sigmoid":
        sig = lambda x: 1 / (1 + F.exp(-x))
        lo, hi = 1 / (1 + math.exp(-start / tau)), 1 / (1 + math.exp(-end / tau))
        return bound((hi - sig((t * (end - start) + start) / tau)) / (hi - lo))
    raise ValueError(f"unknown schedule {method}")


def position_hash(key: Column, i: Column, seed: str) -> Column:
    """Distinct hash number per position of a row."""
    text = F.concat_ws(":", F.lit(seed), key.cast("string"), i.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") * 65536 + i


def positions(ids: Column) -> Column:
    return F.sequence(F.lit(0), F.size(ids) - 1)


def random_mask(ids: Column, share: Column, key: Column, seed: str = "0") -> Column:
    """Exactly max(1, round(n * share)) true positions, chosen by hash order (half rounds to even)."""
    k = F.greatest(F.rint(F.size(ids) * share), F.lit(1)).cast("int")
    hashes = F.transform(positions(ids), lambda i: position_hash(key, i, seed))
    cut = let(hashes, lambda hs: F.struct(hs.alias("all"), F.element_at(F.array_sort(hs), k).alias("limit")))
    return let(cut, lambda s: F.transform(s["all"], lambda h: h <= s["limit"]))


def rectangle_mask(ids: Column, share: Column, side: int, u: Sequence[Column]) -> Column:
    """About n * share positions as one rectangle on a side x side grid; ``u`` holds three numbers in [0, 1)."""
    k = F.greatest(F.rint(F.size(ids) * share), F.lit(1)).cast("int")
    low, high = F.ceil(k / side), F.least(F.lit(side), k)
    height = F.least(low + F.floor(u[0] * (high - low + 1)), F.lit(side))
    width = F.least(F.ceil(k / height), F.lit(side))
    top, left = F.floor(u[1] * (side - height + 1)), F.floor(u[2] * (side - width + 1))
    inside = lambda i: F.floor(i / side).between(top, top + height - 1) & (i % side).between(left, left + width - 1)
    return F.transform(positions(ids), inside)


def mask_tokens(ids: Column, mask: Column, mask_id: int, predict_all: bool = False) -> Column:
    """Struct of noised ids and labels (-100 outside the mask unless all tokens are predicted)."""
    noisy = F.zip_with(ids, mask, lambda x, m: F.when(m, mask_id).otherwise(x))
    labels = ids if predict_all else F.zip_with(ids, mask, lambda x, m: F.when(m, x).otherwise(IGNORE))
    return F.struct(noisy.alias("ids"), labels.alias("labels"))


def noise_by_rate(ids: Column, prompt_mask: Column, t: Column, key: Column, mask_id: int, eps: float = 1e-3, seed: str = "0") -> Column:
    """Each token is masked with probability (1 - eps) t + eps, prompt tokens are kept; also the rate and answer length (>= 1)."""
    p = (1 - eps) * t + eps
    draw = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    noisy = F.transform(ids, lambda x, i: F.when((F.get(prompt_mask, i) == 0) & (draw(i) < p), mask_id).otherwise(x))
    answer = F.greatest(F.size(F.filter(prompt_mask, lambda m: m == 0)), F.lit(1))
    return F.struct(noisy.alias("ids"), p.alias("rate"), answer.alias("answer_length"))


def answer_regions(ids: Column, action_sep: int, future_sep: int, future_len: Column) -> Column:
    """Boolean arrays of the action span and of the future span, from the first separators."""
    a = F.array_position(ids, F.lit(action_sep)) - 1
    f = F.array_position(ids, F.lit(future_sep)) - 1
    has_future = (f >= 0) & (future_len > 0)
    stop = F.when(has_future, f).otherwise(F.size(ids))
    action = F.transform(positions(ids), lambda i: (a >= 0) & (i > a) & (i < stop))
    future = F.transform(positions(ids), lambda i: (a >= 0) & has_future & (i >= f) & (i < f + future_len + 3))
    return F.struct(action.alias("action"), future.alias("future"))


def loss_weight(t: Column, mask: Column, minimum: float = 0.3) -> Column:
    return 1 - (1 - mask) * ((1 - t) * (1 - minimum))


def mask_bucket(share: Column, buckets: int = 10) -> Column:
    """Right-closed bucket of a share; 0 falls in the first one."""
    return F.greatest(F.ceil(share * buckets) - 1, F.lit(0)).cast("int")


def average_by_mask_bucket(df: DataFrame, share: str, value: str, buckets: int = 10) -> DataFrame:
    """Mean value of every bucket, 0 for empty ones."""
    found = df.groupBy(mask_bucket(F.col(share), buckets).alias("bucket")).agg(F.avg(value).alias("mean_value"))
    bins = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return bins.join(F.broadcast(found), "bucket", "left").select("bucket", F.coalesce("mean_value", F.lit(0.0)).alias("mean_value"))


def entropy(probabilities: Column) -> Column:
    return -F.aggregate(probabilities, F.lit(0.0), lambda s, p: s + F.when(p > 0, p * F.ln(p)).otherwise(0.0))


def softmax(logits: Column) -> Column:
    powers = let(F.array_max(logits).cast("double"), lambda top: F.transform(logits, lambda x: F.exp(x.cast("double") - top)))
    summed = let(powers, lambda ps: F.struct(ps.alias("all"), F.aggregate(ps, F.lit(0.0), lambda s, x: s + x).alias("total")))
    return let(summed, lambda s: F.transform(s["all"], lambda x: x / s["total"]))


def encode_pair(context: Column, continuation: Column) -> Column:
    """Trailing white space of the context moves to the front of the continuation."""
    bare = F.regexp_replace(context, r"\s+$", "")
    spaces = F.substring(context, F.length(bare) + 1, F.length(context))
    return F.struct(bare.alias("context"), F.concat(spaces, continuation).alias("continuation"))


def cut_at_stop(text: Column, stops: Sequence[str]) -> Column:
    """Text before each stop string, applied in order."""
    for stop in stops:
        text = F.split_part(text, F.lit(stop), F.lit(1))
    return text
