"""Answer extraction: column functions that read an answer out of free text."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from scorewright.functions.text import let, literal_map, normalise_punctuation, strip_space, words

# Failure marker and refusal sentences.
FAILED = "Failed to obtain answer via API"
REFUSALS = [
    "Sorry, I can't help with images of people yet.",
    "I can't process this file.",
    "I'm sorry, but without the image provided",
    "Cannot determine the answer",
]
# Symbols turned into blanks before option letters are looked for.
OPTION_SYMBOLS = ".()[],:;!*#{}"

# Answer openings that are removed; two of them are joined pairs, as in the rule this follows.
ANSWER_OPENINGS = [
    "The best answer is",
    "The correct answer is",
    "The answer is",
    "The answer",
    "The best option isThe correct option is",
    "Best answer:Best option:",
]
VIDEO_OPENINGS = [
    "The best answer is",
    "The correct answer is",
    "The answer is",
    "The answer",
    "The best option isThe correct option is",
    "Best answer:Best option:Answer:",
    "Option:",
]
LONG_VIDEO_OPENINGS = [
    "The best answer is",
    "The correct answer is",
    "The answer is",
    "The answer",
    "The best option isThe correct option is",
    "Best answer:Best option:",
    "Answer:",
    "Option:",
]

# Ordinal words of answer sequences.
ORDINALS = ["first|1st|首先|第一步", "second|2nd|其次|第二步", "third|3rd|再次|第三步", "fourth|4th|最后|第四步"]

# Number words of counting answers.
COUNT_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
    "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000,
}

# Pairwise verdict marks.
VERDICTS = {"A>>B": -2, "A>B": -1, "A=B": 0, "B>A": 1, "B>>A": 2}


def _only(values: Column) -> Column:
    """The single element of an array, else null."""
    return F.when(F.size(values) == 1, F.element_at(values, 1))


def _empty_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def count_of(text: Column, part: Column | str) -> Column:
    """Occurrences of a literal part, without overlap."""
    part = F.lit(part) if isinstance(part, str) else part
    gone = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.when(F.length(part) > 0, (gone / F.length(part)).cast("int")).otherwise(0)


def infer_option(answer: Column, options: Column) -> Column:
    """Letter named by the answer; Z for refusals; null when none or several letters appear."""
    tokens = words(F.translate(answer, OPTION_SYMBOLS, " " * len(OPTION_SYMBOLS)))
    refused = F.lit(False)
    for sentence in REFUSALS:
        refused = refused | answer.contains(sentence)

    def pick(found: Column) -> Column:
        hits = F.array_intersect(F.map_keys(options), found)
        return F.when(F.size(hits) == 1, F.element_at(hits, 1)).when((F.size(hits) == 0) & F.array_contains(found, "Z"), "Z")

    return F.when(answer.contains(FAILED), F.lit(None).cast("string")).when(refused, "Z").otherwise(let(tokens, pick))


def infer_option_by_text(answer: Column, options: Column) -> Column:
    """Letter of the only option whose text occurs in the answer, ignoring case."""
    low = F.lower(answer)
    return _only(F.map_keys(F.map_filter(options, lambda _, v: low.contains(F.lower(v)))))


def infer(answer: Column, options: Column) -> Column:
    return F.coalesce(infer_option(answer, options), infer_option_by_text(answer, options))


def infer_sequence(answer: Column) -> Column:
    """Four distinct letters A-D: written together, after ordinals, or after step numbers."""
    up = F.upper(answer)
    block = F.regexp_extract(up, r"\b([A-D]{4})\b", 1)
    block = F.when((block != "") & (F.size(F.array_distinct(F.split(block, ""))) == 4), block)
    named = F.array(*[F.upper(F.regexp_extract(up, rf"(?i)(?:{o}).*?([A-D])", 1)) for o in ORDINALS])
    named = F.array_distinct(F.filter(named, lambda x: x != ""))
    steps = F.regexp_extract_all(up, F.lit(r"(?i)(?:step\s*[\d一二三四]+|步骤\s*[\d一二三四]+|第\s*[\d一二三四]\s*步).*?([A-D])"), F.lit(1))
    four = F.array_distinct(F.transform(F.slice(steps, 1, 4), lambda x: F.upper(x)))
    return F.coalesce(
        block,
        F.when(F.size(named) == 4, F.array_join(named, "")),
        F.when((F.size(steps) >= 4) & (F.size(four) == 4), F.array_join(four, "")),
    )


def infer_by_type(answer: Column, question_type: Column, options: Column) -> Column:
    """Sorting questions look for a sequence, other questions for a letter; then for option text."""
    first = F.when(question_type == "sort", infer_sequence(answer)).otherwise(infer_option(answer, options))
    return F.coalesce(first, infer_option_by_text(answer, options))


def first_letter(text: Column, alphabet: str = "ABCDE", openings: Sequence[str] = tuple(ANSWER_OPENINGS), choices: Sequence[str] = ()) -> Column:
    """First capital of ``alphabet`` after the answer openings are removed; else the letter of a choice holding the text; else ''."""
    bare = strip_space(text)
    for opening in openings:
        bare = F.replace(bare, F.lit(opening), F.lit(""))
    letter = F.regexp_extract(bare, f"[{alphabet}]", 0)
    fallback = F.lit("")
    for choice in reversed(choices):
        fallback = F.when(F.lit(choice.lower()).contains(F.lower(bare)), choice[1]).otherwise(fallback)
    return F.when(letter != "", letter).when(F.size(words(bare)) > 10, "").otherwise(fallback)


def yes_no(text: Column) -> Column:
    tokens = words(normalise_punctuation(F.lower(text)))
    found = F.array_join(F.array_sort(F.array_intersect(tokens, F.array(F.lit("yes"), F.lit("no")))), " ")
    return F.coalesce(F.try_element_at(literal_map({"yes": "Yes", "no": "No"}), found), F.lit("Unknown"))


def first_of(text: Column, positive: str, negative: str) -> Column:
    """1 when the positive word comes first, 0 for the negative one, -1 when neither occurs."""
    p = F.regexp_instr(text, F.lit(rf"(?iU)\b{positive}\b"))
    n = F.regexp_instr(text, F.lit(rf"(?iU)\b{negative}\b"))
    return F.when((p == 0) & (n == 0), -1).when((n == 0) | ((p > 0) & (p < n)), 1).otherwise(0)


def leading_yes_no(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.startswith("yes"), "yes").when(low.startswith("no"), "no")


def true_false(text: Column) -> Column:
    marks = F.regexp_extract_all(text, F.lit(r"(?iU)\b(t|f|true|false)\b"), F.lit(1))
    return F.upper(F.substring(_only(marks), 1, 1))


def choice_by_rule(prediction: Column, answer: Column) -> Column:
    """1 / 0 when the prediction is the answer, a letter, ``A.`` or ``A)``; null when the rule cannot decide."""
    letter = F.regexp_extract(prediction, r"^([ABCD])(?:$|[.)])", 1)
    return (F.when(prediction == answer, 1)
            .when(letter != "", (letter == F.substring(answer, 1, 1)).cast("int")))


def match_caption_option(prediction: Column, answer: Column, candidates: Column) -> Column:
    """1 / 0 when the prediction equals an option, its sentence or its label; null when it equals none."""
    label = lambda o: F.split_part(o, F.lit(": "), F.lit(1))
    sentence = lambda o: F.split_part(o, F.lit(": "), F.lit(2))

    def short(o):
        text = label(o)
        for prefix in ("Sentence ", "Option ", "Caption "):
            text = F.replace(text, F.lit(prefix), F.lit(""))
        return text

    last = lambda a: F.try_element_at(a, F.lit(-1))
    after = F.split_part(prediction, F.lit(") "), F.lit(2))
    bare = F.replace(prediction, F.lit("."), F.lit(""))
    whole = last(F.filter(candidates, lambda o: o == prediction))
    by_sentence = last(F.filter(F.transform(candidates, sentence), lambda s: (s == prediction) | (prediction.contains(") ") & (s == after))))
    labels = F.concat(F.transform(candidates, label), F.transform(candidates, short))
    by_label = last(F.filter(labels, lambda x: (x == prediction) | (x == bare)))
    found = F.coalesce(by_label, by_sentence, whole)
    head = label(answer)
    right = (found == answer) | (found == F.split_part(answer, F.lit(":"), F.lit(1))) | (found == sentence(answer)) | (found == F.try_element_at(words(head), F.lit(2)))
    return F.when(found.isNotNull(), F.coalesce(right, F.lit(False)).cast("int"))


def most_frequent_choice(response: Column, letters: Sequence[str], option_texts: dict[str, Column]) -> Column:
    """Letters mentioned most often, tied ones joined: bracketed letters, else bare letters, else option texts; null if none."""
    text = response
    for mark in [",", ".", "!", "?", ";", ":", "'"]:
        text = F.regexp_replace(text, rf"^\{mark}+|\{mark}+$", "")
    text = F.concat(F.lit(" "), text, F.lit(" "))
    names = F.array(*[F.lit(c) for c in letters])
    tier = lambda t, parts: F.array(*[count_of(t, p) for p in parts])

    def tiers(t: Column) -> Column:
        return F.array(tier(t, [f"({c})" for c in letters]), tier(t, list(letters)), tier(t, [option_texts[c] for c in letters]))

    def top(counts: Column) -> Column:
        most = F.array_max(counts)
        return F.array_join(F.filter(F.zip_with(names, counts, lambda n, k: F.when(k == most, n)), lambda x: x.isNotNull()), "")

    chosen = F.get(F.filter(let(text, tiers), lambda c: F.array_max(c) > 0), F.lit(0))
    return let(chosen, lambda c: F.when(c.isNotNull(), top(c)))


def last_answer_tag(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?s)<answer>\s*(.*?)\s*</answer>"), F.lit(1))
    return strip_space(F.try_element_at(found, F.lit(-1)))


def tagged_option(text: Column, letters: str = "ABCDEF") -> Column:
    """Letter inside the last answer tag; marked forms (``A ``, ``A:``, ``[A``) win over bare letters; WRONG if none."""
    def pick(inside: Column) -> Column:
        out = F.when(inside.isNull(), "WRONG")
        for c in letters:
            out = out.when(inside.contains(c + " ") | inside.contains(c + ":") | inside.contains("[" + c), c)
        for c in letters:
            out = out.when(inside.contains(c), c)
        return out.otherwise("WRONG")

    return let(last_answer_tag(text), pick)


def ans_tag(text: Column) -> Column:
    inner = F.split_part(F.split_part(text, F.lit("<ans>"), F.lit(2)), F.lit("</ans>"), F.lit(1))
    return F.when(text.contains("<ans>"), inner).otherwise(text)


def last_braces(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(strip_space(text)), F.lit(r"\{(.*?)\}"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def first_capital(text: Column) -> Column:
    return _empty_to_null(F.regexp_extract(text, "[A-Z]", 0))


def fenced_json(text: Column) -> Column:
    return strip_space(F.regexp_extract(text, r"(?s)```json(.*?)```", 1))


def fenced_choice_score(response: Column, right: Column) -> Column:
    """1 / 0 from the ``result`` of a fenced json block (bare words are quoted), else from capitals A-H in the text; -1 if none."""
    block = F.regexp_replace(fenced_json(response), r"(?<=:\s)([A-Za-z_]\w*)", '"$1"')
    result = F.from_json(block, "result STRING")["result"]
    capitals = F.regexp_extract_all(response, F.lit(r"\b[A-H]\b"), F.lit(0))
    return (F.when(result.isNotNull(), (result == right).cast("int"))
            .when(F.size(capitals) > 0, F.array_contains(capitals, right).cast("int"))
            .otherwise(-1))


def fenced_intervals(response: Column, duration: Column) -> Column:
    """Intervals of the fenced json ``result`` (fractions are scaled by the duration), else numbers of the text paired in order."""
    block = fenced_json(response)
    nested = F.from_json(block, "result ARRAY<ARRAY<DOUBLE>>")["result"]
    flat = F.from_json(block, "result ARRAY<DOUBLE>")["result"]
    given = F.coalesce(F.when(F.element_at(nested, 1).isNotNull(), nested), F.when(F.size(flat) >= 2, F.array(F.slice(flat, 1, 2))))
    relative = F.forall(given, lambda p: (p[0] <= 1) & (p[1] <= 1))
    scaled = F.when(relative, F.transform(given, lambda p: F.array(p[0] * duration, p[1] * duration))).otherwise(given)
    numbers = F.transform(F.regexp_extract_all(response, F.lit(r"-?\d+\.?\d*"), F.lit(0)), lambda x: x.cast("double"))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(numbers) / 2).cast("int") - 1, F.lit(0))),
                        lambda i: F.slice(numbers, i * 2 + 1, 2))
    return F.coalesce(scaled, F.when(F.size(numbers) >= 2, pairs))


def fenced_open_result(response: Column) -> Column:
    """``result`` of a fenced json block, else the whole response; null for missing or failed ones."""
    result = F.get_json_object(F.when(fenced_json(response) != "", fenced_json(response)), "$.result")
    return F.when((response != "") & ~response.contains(FAILED), F.coalesce(result, response))


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_objects(texts: pd.Series) -> pd.Series:
    """Every decodable ``{...}`` object of the text, as JSON strings."""
    decoder = json.JSONDecoder()

    def scan(text):
        if text is None:
            return None
        found, at = [], text.find("{")
        while at != -1:
            try:
                value, end = decoder.raw_decode(text, at)
                found.append(json.dumps(value, ensure_ascii=False))
                at = text.find("{", end)
            except ValueError:
                at = text.find("{", at + 1)
        return found

    return texts.map(scan)


def numbers(text: Column) -> Column:
    """Digit runs, followed by the value of all number words read as one phrase (a zero total is left out)."""
    low = F.lower(text)
    digits = F.transform(F.regexp_extract_all(low, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("decimal(38,0)").cast("double"))
    found = F.regexp_extract_all(low, F.lit(r"\b(" + "|".join(COUNT_WORDS) + r")\b"), F.lit(1))
    value = literal_map(COUNT_WORDS)

    def step(acc: Column, word: Column) -> Column:
        n = F.element_at(value, word).cast("double")
        big = n >= 100
        closed = F.when(acc["run"] == 0, 1.0).otherwise(acc["run"]) * n
        return F.struct(F.when(big, acc["total"] + closed).otherwise(acc["total"]).alias("total"),
                        F.when(big, 0.0).otherwise(acc["run"] + n).alias("run"))

    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("run"))
    phrase = F.aggregate(found, start, step, lambda acc: acc["total"] + acc["run"])
    return F.concat(digits, F.when(phrase != 0, F.array(phrase)).otherwise(F.array().cast("array<double>")))


def single_number(text: Column) -> Column:
    return _only(numbers(text))


def count_0_20(text: Column) -> Column:
    """First integer 0-20 written in digits or words."""
    small = {w: n for w, n in COUNT_WORDS.items() if n <= 20}
    found = F.regexp_extract(F.lower(text), r"\b(?:[0-9]|1[0-9]|20)\b|\b(?:" + "|".join(small) + r")\b", 0)
    return F.coalesce(F.try_element_at(literal_map(small), found), found.try_cast("int"))


def parse_box(text: Column) -> Column:
    """The only ``a, b, c, d`` group of the text as numbers; null when there is none, several, or a blank part."""
    one = r"(\d?(?:\.\d+)?),\s?(\d?(?:\.\d+)?),\s?(\d?(?:\.\d+)?),\s?(\d?(?:\.\d+)?)"
    flat = F.replace(text, F.lit("\n"), F.lit(""))
    parts = [F.regexp_extract(flat, one, i).try_cast("double") for i in range(1, 5)]
    ok = (F.regexp_count(flat, F.lit(one)) == 1)
    for p in parts:
        ok = ok & p.isNotNull()
    return F.when(ok, F.array(*parts))


def parse_point(text: Column) -> Column:
    pattern = r"x=([\d.]+), y=([\d.]+)"
    read = [F.regexp_extract(text, pattern, i).try_cast("double") for i in (1, 2)]
    return F.when(text.rlike(pattern), F.array(*read)).otherwise(F.array(F.lit(0.0), F.lit(0.0)))


def rating_lines(text: Column, kind: str = "gold") -> Column:
    """Reality, aesthetics and consistency ratings; null unless all three are present."""
    patterns = {
        "gold": [r"(?i)Reality Assessment Score:\s*([\d.]+)", r"(?i)Aesthetics Rating:\s*([\d.]+)", r"(?i)Instruction Consistency Rating:\s*([\d.]+)"],
        "prediction": [r"(?i)Total Score(?: for Reality Assessment)?:[\s\*]*([\d.]+)", r"(?i)Aesthetics Rating\D*([\d.]+)", r"(?i)Instruction Consistency Rating\D*([\d.]+)"],
    }[kind]
    values = [F.regexp_extract(text, p, 1).try_cast("double") for p in patterns]
    present = values[0].isNotNull() & values[1].isNotNull() & values[2].isNotNull()
    return F.when(present, F.struct(*[v.alias(n) for v, n in zip(values, ("reality", "aesthetics", "consistency"))]))


def component_fractions(raw: Column, components: Column) -> Column:
    """Map component -> a/b of ``name: a/b, ..., total: e/f`` (first sentence); the last part is ``total_score``."""
    parts = F.split(F.split_part(raw, F.lit("."), F.lit(1)), ",")
    fraction = lambda p: (F.regexp_extract(p, r":\s?(\d+)\s*/\s*(\d+)", 1).try_cast("double") / F.nullif(F.regexp_extract(p, r":\s?(\d+)\s*/\s*(\d+)", 2).try_cast("double"), F.lit(0.0)))
    count = F.size(parts)
    name = lambda i: F.when(i == count - 1, "total_score").otherwise(F.try_element_at(components, i + 1))
    entries = F.transform(parts, lambda p, i: F.struct(name(i).alias("component"), fraction(p).alias("score")))
    valid = F.forall(entries, lambda e: e["component"].isNotNull() & e["score"].isNotNull())
    return F.when(valid, F.map_from_entries(entries))


def pairwise_verdict(judgement: Column) -> Column:
    """-2..2 when exactly one distinct ``[[A>>B]]``-style mark occurs, else null."""
    marks = F.array_distinct(F.regexp_extract_all(judgement, F.lit(r"\[\[([AB<>=]+)\]\]"), F.lit(1)))
    return F.try_element_at(literal_map(VERDICTS), _only(marks))


def clock_to_seconds(text: Column) -> Column:
    part = lambda i: F.split_part(text, F.lit(":"), F.lit(i))
    return part(1).try_cast("int") * 3600 + part(2).try_cast("int") * 60 + part(3).try_cast("double")


def options_from_question(question: Column) -> Column:
    """Option lines after the first line become a letter -> text map; the i-th line must hold the i-th letter and a dot."""
    lines = F.slice(F.split(question, "\n"), 2, F.greatest(F.size(F.split(question, "\n")), F.lit(1)))

    def entry(line: Column, i: Column) -> Column:
        letter = F.char(i + 65)
        at = F.instr(line, F.concat(letter, F.lit(".")))
        body = F.regexp_replace(F.substring(line, at + 2, F.length(line)), r"^[. \n]+|[. \n]+$", "")
        return F.when(at > 0, F.struct(letter.alias("key"), body.alias("value")))

    return F.map_from_entries(F.filter(F.transform(lines, entry), lambda e: e.isNotNull()))


def clean_split_answer(text: Column) -> Column:
    """First letter A-H after the last "Answer" once ``< > : .`` are removed."""
    tail = F.split_part(text, F.lit("Answer"), F.lit(-1))
    bare = strip_space(F.regexp_replace(strip_space(tail), "[<>:.]", ""))
    return _empty_to_null(F.regexp_extract(bare, "^[A-H]", 0))


def key_scores_sum(text: Column, keys: Sequence[str]) -> Column:
    """Sum of the numbers that follow the named keys; absent keys add nothing."""
    values = [F.regexp_extract(text, rf"(?s){k}.*?:.([^,}}]*)", 1).try_cast("double") for k in keys]
    return sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))


def correct_phrase(text: Column) -> Column:
    right, wrong = text.contains("Correct"), text.contains("Incorrect")
    return F.when(text.startswith("Correct") | (right & ~wrong), 1).otherwise(0)


def judged_answer(output: Column, gold: Column) -> Column:
    """Rating of an "Answer:" line: text before ". " equals the gold's and exactly one option mark occurs; -1 for a failed call."""
    lines = F.filter(F.transform(F.split(output, "\n"), strip_space), lambda x: x.contains("Answer"))
    said = F.coalesce(strip_space(F.replace(F.try_element_at(lines, F.lit(-1)), F.lit("Answer:"), F.lit(""))), output)
    marks = sum((count_of(said, c + ".") for c in "ABCD"), F.lit(0))
    head = lambda t: F.split_part(t, F.lit(". "), F.lit(1))
    failed = output.isNull() | (output == "") | (output == "invalid_request_error")
    return F.when(failed, -1).otherwise(((head(said) == head(gold)) & (marks == 1)).cast("int"))


def direct_scores(text: Column) -> Column:
    """Map of ``Score of name: a/b`` lines."""
    flat = F.replace(F.regexp_replace(text, r"\s+", " "), F.lit("*"), F.lit(""))
    found = F.regexp_extract_all(flat, F.lit(r"(?i)Score\s+of\s+[a-zA-Z0-9_\-]+:\s*\d+\s*/\s*\d+"), F.lit(0))
    pattern = r"(?i)Score\s+of\s+([a-zA-Z0-9_\-]+):\s*(\d+)\s*/\s*(\d+)"
    entry = lambda s: F.struct(
        F.lower(F.regexp_extract(s, pattern, 1)).alias("key"),
        (F.regexp_extract(s, pattern, 2).cast("double") / F.nullif(F.regexp_extract(s, pattern, 3).cast("double"), F.lit(0.0))).alias("value"))
    entries = F.transform(found, entry)
    # a repeated component keeps its last score
    names = F.reverse(F.transform(entries, lambda x: x["key"]))
    keep = F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == F.size(entries) - i)
    return F.when(F.size(found) > 0, F.map_from_entries(keep))


def right_wrong(text: Column) -> Column:
    return F.when(text.rlike("(?i)right"), 1).when(text.rlike("(?i)wrong"), 0)


def summary_true_false(text: Column) -> Column:
    """Word true / false after the last "summary"."""
    tail = F.split_part(F.lower(text), F.lit("summary"), F.lit(-1))
    word = F.regexp_extract(tail, r"\b(true|false)\b", 1)
    return F.when(F.lower(text).contains("summary") & (word != ""), (word == "true").cast("int"))


def score_dictionary(text: Column) -> Column:
    """{'pred': yes/no, 'score': n} -> struct(correct, score); -1 for both when it cannot be read."""
    fields = F.from_json(quote_fix(text), "pred STRING, score DOUBLE")
    ok = fields["pred"].isNotNull() & fields["score"].isNotNull()
    return F.struct(F.when(ok, (F.lower(fields["pred"]) == "yes").cast("int")).otherwise(-1).alias("correct"),
                    F.when(ok, fields["score"]).otherwise(-1.0).alias("score"))


def quote_fix(text: Column) -> Column:
    """Single quoted literals become JSON text: quotes at token edges turn double, tuples turn into lists."""
    text = F.regexp_replace(text, r"(?<=[\[{(,:\s])'|'(?=\s*[\]}),:])|^'|'$", '"')
    return F.translate(text, "()", "[]")


def answer_field(response: Column) -> Column:
    """Text after "Answer:" without its code fence and outer quotes; bracketed content passes through as JSON text."""
    pattern = r"(?s)\*\*?Answer:\s*(.*?)\*\*?|\bAnswer:\s*(.*)"
    bold, plain = F.regexp_extract(response, pattern, 1), F.regexp_extract(response, pattern, 2)
    content = strip_space(F.when(response.rlike(pattern), F.when(bold != "", bold).otherwise(plain)).otherwise(response))
    fence = r"(?s)```\w*\s*\n*(.*?)\s*```"
    content = F.when(content.rlike(fence), strip_space(F.regexp_extract(content, fence, 1))).otherwise(content)
    quoted = F.regexp_extract(content, r"""(?s)^(["'])(.*)\1$""", 2)
    return F.when(content.rlike(r"^[\[{]"), content).when(quoted != "", quoted).otherwise(content)


def drop_additional_text(content: Column) -> Column:
    """First paragraph when it is a short answer and its line is followed by a blank one."""
    paragraph = strip_space(F.split_part(content, F.lit("\n\n"), F.lit(1)))
    short = paragraph.rlike(r"^(?:[a-zA-Z0-9_-]+(?:,\s*[a-zA-Z0-9_-]+)*|[a-zA-Z0-9_-]+\.|\([a-zA-Z0-9_-]+\)$)")
    lone = F.regexp_replace(content, r"^\s+", "").rlike(r"^[^\n]*(?:\n[ \t]*(?:\n|$)|$)") & content.contains("\n")
    return F.when(short & (paragraph != "") & lone, paragraph).otherwise(content)


def literal_list(text: Column) -> Column:
    """List text -> array of strings: JSON or quoted literals, else the parts between commas."""
    bare = F.trim(text)
    bracketed = bare.rlike(r"^(\[.*\]|\(.*\)|\{.*\})$")
    typed = F.from_json(quote_fix(F.translate(bare, "{}", "[]")), "array<string>")
    inner = F.when(bracketed, F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)
    parts = F.transform(F.split(inner, ","), lambda x: strip_space(x))
    return F.when(bare == "", F.array().cast("array<string>")).when(bracketed, F.coalesce(typed, parts)).otherwise(parts)


def literal_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(literal_list(text)))


def literal_dict(text: Column) -> Column:
    return F.from_json(quote_fix(text), "map<string,string>")


def literal_boxes(text: Column) -> Column:
    """One box or a list of boxes -> array of four-number arrays; others are left out."""
    fixed = F.translate(text, "()", "[]")
    many = F.from_json(fixed, "array<array<double>>")
    one = F.from_json(fixed, "array<double>")
    good = lambda a: F.filter(a, lambda b: (F.size(b) == 4) & F.forall(b, lambda x: x.isNotNull()))
    return F.when((F.size(one) == 4) & F.forall(one, lambda x: x.isNotNull()), F.array(one)).otherwise(F.coalesce(good(many), F.array().cast("array<array<double>>")))


def literal_points(text: Column) -> Column:
    many = F.from_json(F.translate(text, "()", "[]"), "array<array<double>>")
    return F.coalesce(F.filter(many, lambda b: (F.size(b) == 2) & F.forall(b, lambda x: x.isNotNull())), F.array().cast("array<array<double>>"))
