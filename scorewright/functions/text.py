"""Corpus text: column functions for cleaning, routing and rendering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.operators.skew import unit_hash

# Phrases put in place of a person tag.
PERSON_PHRASES = ["a person", "someone", "somebody"]

# Caption openings that are deleted wherever they occur, in this order.
CAPTION_OPENINGS = [
    "The image features ",
    "The image presents ",
    "The image you've sent is, ",
    "In the center of the image, ",
    "The image showcases ",
    "The image is ",
    "The image captures ",
    "In the given image ",
    "The image portrays ",
    "In the image, ",
    "In this image, we see ",
    "The image depicts ",
    "This is ",
    "In this image, ",
    "This image captures ",
]

# Symbols treated by the answer punctuation rule.
PUNCTUATION = [";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",", "?", "!"]

# Number words and articles of the answer normaliser.
NUMBER_WORDS = {
    "none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
}
ARTICLES = ["a", "an", "the"]

# Contractions restored by the answer normaliser.
CONTRACTIONS = {
    "aint": "ain't", "arent": "aren't", "cant": "can't", "couldve": "could've", "couldnt": "couldn't",
    "couldn'tve": "couldn't've", "couldnt've": "couldn't've", "didnt": "didn't", "doesnt": "doesn't",
    "dont": "don't", "hadnt": "hadn't", "hadnt've": "hadn't've", "hadn'tve": "hadn't've", "hasnt": "hasn't",
    "havent": "haven't", "hed": "he'd", "hed've": "he'd've", "he'dve": "he'd've", "hes": "he's",
    "howd": "how'd", "howll": "how'll", "hows": "how's", "Id've": "I'd've", "I'dve": "I'd've", "Im": "I'm",
    "Ive": "I've", "isnt": "isn't", "itd": "it'd", "itd've": "it'd've", "it'dve": "it'd've", "itll": "it'll",
    "let's": "let's", "maam": "ma'am", "mightnt": "mightn't", "mightnt've": "mightn't've",
    "mightn'tve": "mightn't've", "mightve": "might've", "mustnt": "mustn't", "mustve": "must've",
    "neednt": "needn't", "notve": "not've", "oclock": "o'clock", "oughtnt": "oughtn't",
    "ow's'at": "'ow's'at", "'ows'at": "'ow's'at", "'ow'sat": "'ow's'at", "shant": "shan't",
    "shed've": "she'd've", "she'dve": "she'd've", "she's": "she's", "shouldve": "should've",
    "shouldnt": "shouldn't", "shouldnt've": "shouldn't've", "shouldn'tve": "shouldn't've",
    "somebody'd": "somebodyd", "somebodyd've": "somebody'd've", "somebody'dve": "somebody'd've",
    "somebodyll": "somebody'll", "somebodys": "somebody's", "someoned": "someone'd",
    "someoned've": "someone'd've", "someone'dve": "someone'd've", "someonell": "someone'll",
    "someones": "someone's", "somethingd": "something'd", "somethingd've": "something'd've",
    "something'dve": "something'd've", "somethingll": "something'll", "thats": "that's", "thered": "there'd",
    "thered've": "there'd've", "there'dve": "there'd've", "therere": "there're", "theres": "there's",
    "theyd": "they'd", "theyd've": "they'd've", "they'dve": "they'd've", "theyll": "they'll",
    "theyre": "they're", "theyve": "they've", "twas": "'twas", "wasnt": "wasn't", "wed've": "we'd've",
    "we'dve": "we'd've", "weve": "we've", "werent": "weren't", "whatll": "what'll", "whatre": "what're",
    "whats": "what's", "whatve": "what've", "whens": "when's", "whered": "where'd", "wheres": "where's",
    "whereve": "where've", "whod": "who'd", "whod've": "who'd've", "who'dve": "who'd've", "wholl": "who'll",
    "whos": "who's", "whove": "who've", "whyll": "why'll", "whyre": "why're", "whys": "why's",
    "wont": "won't", "wouldve": "would've", "wouldnt": "wouldn't", "wouldnt've": "wouldn't've",
    "wouldn'tve": "wouldn't've", "yall": "y'all", "yall'll": "y'all'll", "y'allll": "y'all'll",
    "yall'd've": "y'all'd've", "y'alld've": "y'all'd've", "y'all'dve": "y'all'd've", "youd": "you'd",
    "youd've": "you'd've", "you'dve": "you'd've", "youll": "you'll", "youre": "you're", "youve": "you've",
}

# Chat markup.
USER_HEADER = "<|start_header_id|>user<|end_header_id|>\n"
ASSISTANT_HEADER = "<|start_header_id|>assistant<|end_header_id|>\n"
START_OF_TEXT = "<|startoftext|>"
THINK_ANSWER = (
    "You should first think about the reasoning process in the mind and then provide the user with the answer. "
    "The reasoning process is enclosed within <think> </think> tags, i.e. <think> reasoning process here </think> "
    "answer here\n"
)
THINK_IMAGE = (
    "You should first think out a more detailed version of the description and then provide the user with the image. "
    "The detailed description is enclosed within <think> </think> tags, i.e. <think> detailed description here "
    "</think> image here\n"
)

# Source routing, first match wins: (column, substring, caption rule).
SOURCE_RULES = [
    ("key", "SA1B", "sidecar_caption"),
    ("key", "sa", "sidecar_caption"),
    ("url", "laion", "laion_sidecar"),
    ("url", "cc12m", "person_caption"),
    ("url", "text-to-image-2M", "prompt_caption"),
    ("url", "ai2d", "reasoning_png"),
    ("url", "clevr", "reasoning_jpg"),
    ("url", "docvqa", "reasoning_png"),
    ("url", "geo", "reasoning_jpg"),
]
SQUASH_SOURCES = ["ai2d", "clevr", "docvqa", "geo"]


def literal_map(values: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_space(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Split on white space; empty text gives an empty array."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def replace_person(text: Column, key: Column, seed: str = "0") -> Column:
    """Runs of person tags become " people "; every other tag becomes one of three phrases by a hash of key and position."""
    merged = F.regexp_replace(text, r"(?i)<person>([,\s]*(and)*[,\s]*<person>)+", " people ")
    parts = F.split(merged, "(?i)<person>")
    phrases = F.array(*[F.lit(p) for p in PERSON_PHRASES])

    def with_phrase(part: Column, i: Column) -> Column:
        pick = F.floor(unit_hash(key, i, seed=seed) * len(PERSON_PHRASES)).cast("int")
        return F.when(i == 0, part).otherwise(F.concat(F.lit(" "), F.element_at(phrases, pick + 1), F.lit(" "), part))

    return F.array_join(F.transform(parts, with_phrase), "")


def strip_caption_prefix(text: Column, phrases: Sequence[str] = tuple(CAPTION_OPENINGS)) -> Column:
    for phrase in phrases:
        text = F.replace(text, F.lit(phrase), F.lit(""))
    return text


def short_or_long(text: Column, key: Column, seed: str = "0") -> Column:
    """First sentence for half of the keys, the full text for the others."""
    return F.when(unit_hash(key, seed=seed) < 0.5, F.split_part(text, F.lit("."), F.lit(1))).otherwise(text)


def one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(""))


def random_crop(text: Column, n: int, key: Column, seed: str = "0") -> Column:
    """A window of ``n`` characters at a hashed start when the text is longer than ``n``."""
    start = F.floor(unit_hash(key, seed=seed) * (F.length(text) - n)).cast("int")
    return F.when(F.length(text) > n, F.substring(text, start + 1, F.lit(n))).otherwise(text)


def fits(token_count: Column, n: int, mode: str) -> Column:
    """Length rule of each sample kind."""
    limits = {"chat": token_count < n, "question": token_count <= n, "image_text": token_count <= n, "caption": token_count <= n - 2}
    return limits[mode]


def drop_long(df: DataFrame, count: str, n: int, mode: str = "chat") -> DataFrame:
    return df.filter(fits(F.col(count), n, mode))


def coalesce_alternatives(df: DataFrame, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """One column per target name: the first alternative that is present and not null; other columns are dropped."""
    columns = []
    for target, names in wanted.items():
        present = [F.col(n) for n in names if n in df.columns]
        columns.append((F.coalesce(*present) if present else F.lit(None).cast("string")).alias(target))
    return df.select(*columns)


def route_by_source(url: Column, key: Column, rules: Sequence[tuple[str, str, str]] = tuple(SOURCE_RULES), default: str = "key_map") -> Column:
    """Name of the caption rule of the first matching source."""
    route = F.lit(default)
    for column, part, rule in reversed(rules):
        route = F.when((key if column == "key" else url).contains(part), rule).otherwise(route)
    return route


def choose_image_mode(url: Column, squash: Sequence[str] = tuple(SQUASH_SOURCES)) -> Column:
    hit = F.lit(False)
    for part in squash:
        hit = hit | url.contains(part)
    return F.when(hit, "squash").otherwise("centre_crop")


def render_reasoning_prompt(question: Column, solution: Column) -> Column:
    return F.concat(F.lit(USER_HEADER + THINK_ANSWER), question, F.lit("\n<eot_id>" + ASSISTANT_HEADER), solution)


def render_caption_to_image_prompt(short_caption: Column, caption: Column) -> Column:
    return F.concat(F.lit(USER_HEADER + THINK_IMAGE), short_caption, F.lit("<eot_id>" + ASSISTANT_HEADER + "<think>"), caption, F.lit("</think>"))


def chat_role(speaker: Column) -> Column:
    return F.when(speaker.isin("human", "user"), "user").otherwise("assistant")


def render_turn(role: Column, content: Column) -> Column:
    return F.concat(F.lit("<|start_header_id|>"), role, F.lit("<|end_header_id|>\n"), content, F.lit("<|eot_id|>"))


def render_chat(messages: Column, add_generation_prompt: bool = True) -> Column:
    """Text of an array of (role, text) structs, without the start token and the trailing assistant header."""
    body = F.array_join(F.transform(messages, lambda m: render_turn(chat_role(m["role"]), m["text"])), "")
    full = F.concat(F.lit(START_OF_TEXT), body, F.lit(ASSISTANT_HEADER if add_generation_prompt else ""))
    tail = "<|eot_id|>" + ASSISTANT_HEADER
    bare = F.when(full.startswith(START_OF_TEXT), F.substring(full, F.lit(len(START_OF_TEXT) + 1), F.length(full))).otherwise(full)
    return F.when(bare.endswith(tail), F.substring(bare, F.lit(1), F.length(bare) - len(tail))).otherwise(bare)


def trim_turns(messages: Column, key: Column, seed: str = "0") -> Column:
    """First k question/answer pairs, k from 1..n by a hash; null when no pair exists."""
    pairs = F.floor(F.size(messages) / 2)
    k = F.floor(unit_hash(key, seed=seed) * pairs) + 1
    return F.when(pairs >= 1, F.slice(messages, F.lit(1), (2 * k).cast("int")))


def strip_image_placeholder(messages: Column) -> Column:
    def clean(m: Column, i: Column) -> Column:
        text = F.replace(F.replace(m["text"], F.lit("<image>\n"), F.lit("")), F.lit("\n<image>"), F.lit(""))
        return F.when(i == 0, m.withField("text", text)).otherwise(m)

    return F.transform(messages, clean)


def skip_bad_rows(df: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split rows into (good, quarantined); a quarantined row carries the names of the checks it failed."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]), lambda x: x.isNotNull())
    tagged = df.withColumn("_failed", failed)
    good = tagged.filter(F.size("_failed") == 0).drop("_failed")
    bad = tagged.filter(F.size("_failed") > 0).withColumnRenamed("_failed", "failed_checks")
    return good, bad


def is_chinese(text: Column) -> Column:
    return text.rlike("[一-鿿]")


def build_options(df: DataFrame, letters: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ") -> Column:
    """Map of the option columns that hold a value."""
    present = [c for c in letters if c in df.columns]
    pairs = [x for c in present for x in (F.lit(c), F.col(c).cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def option_text(options: Column) -> Column:
    lines = F.transform(F.map_entries(options), lambda e: F.concat(e["key"], F.lit(". "), e["value"], F.lit("\n")))
    return F.concat(F.lit("There are several options: \n"), F.array_join(lines, ""))


# Default matching templates; callers may pass their own by the same names.
JUDGE_TEMPLATES = {
    "choice": "Pick the option closest to the answer; reply with its letter, or Z if none fits.\nQuestion: {question}\n{options}Answer: {prediction}\nLetter: ",
    "choice_chinese": "请选出与回答最接近的选项，只回复字母；都不接近时回复 Z。\n问题：{question}\n{options}回答：{prediction}\n字母：",
    "sequence": "Give the order of the options stated by the answer as letters without blanks.\nQuestion: {question}\n{options}Answer: {prediction}\nOrder: ",
    "yes_no": "Decide whether the answer means Yes, No or Unknown; reply with that word.\nQuestion: {question}\nAnswer: {prediction}\nWord: ",
}


def fill_template(template: str, values: Mapping[str, Column]) -> Column:
    text = F.lit(template)
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return text


def build_judge_prompts(question: Column, options: Column, prediction: Column, kind: Column, templates: Mapping[str, str] = JUDGE_TEMPLATES) -> Column:
    """Prompt per row by question kind and language; options is the option block text (may be empty)."""
    values = {"options": options, "question": question, "prediction": prediction}
    filled = {name: fill_template(t, values) for name, t in templates.items()}
    return (F.when(kind == "yes_no", filled["yes_no"])
            .when(kind == "sort", filled["sequence"])
            .when(is_chinese(question), filled["choice_chinese"])
            .otherwise(filled["choice"]))


def normalise_punctuation(text: Column, max_periods: int | None = None, after_digit: bool = False) -> Column:
    """Symbols are dropped when the input has them beside a blank or holds a digit comma digit; else they turn into a blank.

    Full stops that touch no digit are removed; with ``after_digit`` also those that only follow one. ``max_periods`` is for compatibility with scorers that stop after so many of them.
    """
    def drop_symbols(s: Column) -> Column:
        out = s["t"]
        for p in PUNCTUATION:
            drop = s["t"].contains(p + " ") | s["t"].contains(" " + p) | s["d"]
            out = F.replace(out, F.lit(p), F.when(drop, "").otherwise(" "))
        return F.split(out, r"\.(?!\d)" if after_digit else r"(?<!\d)\.(?!\d)", -1)

    def join(pieces: Column) -> Column:
        if max_periods is None:
            return F.array_join(pieces, "")
        kept = F.array_join(F.slice(pieces, 1, max_periods + 1), "")
        rest = F.array_join(F.slice(pieces, F.lit(max_periods + 2), F.size(pieces)), ".")
        return F.when(F.size(pieces) > max_periods + 1, F.concat(kept, F.lit("."), rest)).otherwise(kept)

    source = F.struct(text.alias("t"), text.rlike(r"\d,\d").alias("d"))
    return let(let(source, drop_symbols), join)


def normalise_answer(text: Column) -> Column:
    """Answer form used by the consensus score: punctuation, case, number words, articles, contractions."""
    flat = strip_space(F.translate(text, "\n\t", "  "))
    tokens = words(F.lower(normalise_punctuation(flat)))
    numbers, contractions = literal_map(NUMBER_WORDS), literal_map(CONTRACTIONS)
    as_digit = F.transform(tokens, lambda w: F.coalesce(F.try_element_at(numbers, w), w))
    kept = F.filter(as_digit, lambda w: ~w.isin(*ARTICLES))
    return F.array_join(F.transform(kept, lambda w: F.coalesce(F.try_element_at(contractions, w), w)), " ")


def remove_markdown_fences(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?m)^```markdown\n?", ""), r"(?m)```\n?$", "")


def cap_repeated_characters(text: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(text, "_{4,}", "____"), " {4,}", "    ")
    return F.regexp_replace(text, r"([^a-zA-Z0-9])\1{10,}", "$1$1$1$1")


def full_to_half_width(text: Column) -> Column:
    """Full-width forms FF01..FF5E lie at a fixed distance from ASCII; the wide blank becomes a blank."""
    wide = "　" + "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    narrow = " " + "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    return F.translate(text, wide, narrow)


def keep_word_characters(text: Column) -> Column:
    for gone in ("\\t", "\\n", "\t", "\n", "/t", "/n"):
        text = F.replace(text, F.lit(gone), F.lit(""))
    return F.regexp_replace(text, r"[^\p{L}\p{N}_]", "")


def clean_document_text(text: Column) -> Column:
    return keep_word_characters(full_to_half_width(cap_repeated_characters(remove_markdown_fences(text))))


def drop_rejected(df: DataFrame, column: str, marker: str = "Failed to obtain answer via API") -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).contains(marker))


def drop_unscorable(df: DataFrame, column: str = "score", rule: str = "not_minus_one") -> DataFrame:
    return df.filter(F.col(column) != -1) if rule == "not_minus_one" else df.filter(F.col(column) >= 0)


def lower_headers(df: DataFrame) -> DataFrame:
    """Lower-case column names; single capital letters stay option names."""
    return df.toDF(*[c if len(c) == 1 and c.isupper() else c.lower() for c in df.columns])


def _short_label(text: Column) -> Column:
    return text.isin("{}", "Both", "None of above") | (F.length(text) <= 2)


def _label(text: Column) -> Column:
    staged = text.startswith("Stage ") & _short_label(F.substring(text, F.lit(7), F.length(text)))
    tokens = words(normalise_punctuation(text, after_digit=True))
    return _short_label(text) | staged | let(tokens, lambda ws: (F.size(ws) > 1) & F.forall(ws, _short_label))


def is_label_phrase(text: Column) -> Column:
    """Text made of short labels: up to two characters, stages, or labels joined by blanks or "and"."""
    return F.exists(F.array(F.array(text), F.split(text, " and ")), lambda parts: F.forall(parts, _label))


def flag_label_like_choices(question: Column, choices: Sequence[Column], marked: Column) -> Column:
    """A marked row is label-like when three of its choices are labels or its question names a single letter."""
    labels = F.size(F.filter(F.array(*choices), is_label_phrase))
    letter = F.exists(words(normalise_punctuation(question, after_digit=True)), lambda w: w.rlike("^[A-Za-z]$"))
    return marked & ((labels >= 3) | letter)
