"""Answer extraction queries (C) over answer texts derived from the tables."""

from pyspark.sql import functions as F

from scorewright.functions import extract as E
from scorewright.plans.catalog import over, query
from scorewright.plans.text import map_sql, plain, punctuation_sql, quoted

OPTIONS = {"A": "Urgent box", "B": "high ring", "C": "Medium bolt", "D": "low gear"}
LETTER = "substr('ABCD', CAST(o_custkey % 4 + 1 AS INTEGER), 1)"
TEXT_OF = f"CASE {LETTER} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OPTIONS.items()) + " END"
CHOICE = f"""o_orderkey AS idx, CASE o_orderkey % 14 WHEN 0 THEN concat('The answer is ', {LETTER}, '.') WHEN 1 THEN concat({LETTER}, ' or D') WHEN 2 THEN concat('(', {LETTER}, ')') WHEN 3 THEN 'Failed to obtain answer via API.'
 WHEN 4 THEN concat('Cannot determine the answer, maybe ', {LETTER}) WHEN 5 THEN 'It is Z' WHEN 6 THEN concat('I think ', lower({TEXT_OF}), ' fits') WHEN 7 THEN 'none of them' WHEN 8 THEN concat({LETTER}, '. because A is wrong')
 WHEN 9 THEN concat('Option:', {LETTER}) WHEN 10 THEN concat('the {{', {LETTER}, '}} one') WHEN 11 THEN concat('The best answer is ', {LETTER}, ') of all the given ones here and there') WHEN 12 THEN 'the urgent box and the low gear'
 ELSE 'i would say that it is one of those things you can never really know' END AS answer"""
_TOKENS = "list_filter(regexp_split_to_array(translate(answer, '.()[],:;!*#{}', '             '), '\\s+'), lambda w: w <> '')"
_HITS = f"list_filter(['A','B','C','D'], lambda c: list_contains({_TOKENS}, c))"
_C1 = f"""CASE WHEN contains(answer, 'Failed to obtain answer via API') THEN NULL WHEN {' OR '.join(f'contains(answer, {quoted(r)})' for r in E.REFUSALS)} THEN 'Z'
 WHEN len({_HITS}) = 1 THEN {_HITS}[1] WHEN len({_HITS}) = 0 AND list_contains({_TOKENS}, 'Z') THEN 'Z' END"""
_TEXTS = f"list_filter(['A','B','C','D'], lambda c: contains(lower(answer), lower({map_sql(OPTIONS)}[c])))"
_C2 = f"CASE WHEN len({_TEXTS}) = 1 THEN {_TEXTS}[1] END"


def options():
    return F.create_map(*[F.lit(x) for pair in OPTIONS.items() for x in pair])


def simple(name, table, select, sql, column, value="value", **kw):
    """A query of ``idx`` and one extracted value."""
    @query(name, over(table, select, f"SELECT idx, {sql} AS {value} FROM d"), **kw)
    def run(t):
        return t.derive(table, select).select("idx", column().alias(value))


c = F.col
simple("c01_infer_option", "orders", CHOICE, _C1, lambda: E.infer_option(c("answer"), options()))
simple("c02_infer_option_by_text", "orders", CHOICE, _C2, lambda: E.infer_option_by_text(c("answer"), options()))
simple("c03_infer", "orders", CHOICE, f"coalesce({_C1}, {_C2})", lambda: E.infer(c("answer"), options()))

SEQ = """o_orderkey AS idx, CASE WHEN o_orderkey % 2 = 0 THEN 'sort' ELSE 'choice' END AS kind, CASE o_orderkey % 6 WHEN 0 THEN concat('order: ', CASE o_custkey % 3 WHEN 0 THEN 'dbca' WHEN 1 THEN 'ABCC' ELSE 'CADB' END, '.') WHEN 1 THEN 'First comes B, second D, third A and fourth C.'
 WHEN 2 THEN 'Step 1: C then Step 2: B then Step 3: A then Step 4: D' WHEN 3 THEN '首先 A，其次 C，再次 B，最后 D' WHEN 4 THEN 'second A, third B' ELSE 'The answer is D' END AS answer"""
_UP = "upper(answer)"
_BLOCK = f"regexp_extract({_UP}, '\\b([A-D]{{4}})\\b', 1)"
_ORD = "[" + ", ".join(f"regexp_extract({_UP}, '(?i)(?:{o}).*?([A-D])', 1)" for o in E.ORDINALS) + "]"
_STEPS = f"regexp_extract_all({_UP}, '(?i)(?:step\\s*[0-9一二三四]+|步骤\\s*[0-9一二三四]+|第\\s*[0-9一二三四]\\s*步).*?([A-D])', 1)"
_SEQ = f"""CASE WHEN {_BLOCK} <> '' AND len(list_distinct(string_split({_BLOCK}, ''))) = 4 THEN {_BLOCK} WHEN len(list_distinct(list_filter({_ORD}, lambda x: x <> ''))) = 4 THEN array_to_string(list_transform({_ORD}, lambda x: upper(x)), '')
 WHEN len({_STEPS}) >= 4 AND len(list_distinct({_STEPS}[1:4])) = 4 THEN array_to_string({_STEPS}[1:4], '') END"""
simple("c04_infer_sequence", "orders", SEQ, _SEQ, lambda: E.infer_sequence(c("answer")))
simple("c04_infer_by_type", "orders", SEQ, f"coalesce(CASE WHEN kind = 'sort' THEN {_SEQ} ELSE {_C1} END, {_C2})", lambda: E.infer_by_type(c("answer"), c("kind"), options()))


def _first_letter_sql(openings, alphabet):
    out = "regexp_replace(answer, '^\\s+|\\s+$', '', 'g')"
    for o in openings:
        out = f"replace({out}, {quoted(o)}, '')"
    return f"regexp_extract({out}, '[{alphabet}]', 0)"


simple("c05_first_letter", "orders", CHOICE, _first_letter_sql(E.ANSWER_OPENINGS, "ABCDE"), lambda: E.first_letter(c("answer")))
simple("c05_first_letter_video", "orders", CHOICE, _first_letter_sql(E.VIDEO_OPENINGS, "ABCD"), lambda: E.first_letter(c("answer"), "ABCD", E.VIDEO_OPENINGS))
simple("c05_first_letter_long_video", "orders", CHOICE, _first_letter_sql(E.LONG_VIDEO_OPENINGS, "ABCDE"), lambda: E.first_letter(c("answer"), "ABCDE", E.LONG_VIDEO_OPENINGS))

YES = f"doc_id AS idx, CASE doc_id % 5 WHEN 0 THEN concat('Yes, ', {plain('text')}) WHEN 1 THEN concat({plain('text')}, ' no.') WHEN 2 THEN concat('No; but yes. ', {plain('text')}) WHEN 3 THEN concat('A then B ', {plain('text')}) ELSE {plain('text')} END AS answer"
_YW = f"list_filter(regexp_split_to_array({punctuation_sql('lower(answer)')}, '\\s+'), lambda w: w <> '')"
simple("c06_yes_no", "documents", YES, f"CASE WHEN list_contains({_YW}, 'yes') AND NOT list_contains({_YW}, 'no') THEN 'Yes' WHEN list_contains({_YW}, 'no') AND NOT list_contains({_YW}, 'yes') THEN 'No' ELSE 'Unknown' END", lambda: E.yes_no(c("answer")))


def _first_of_sql(p, n):
    at = lambda w: f"CASE WHEN regexp_matches(answer, '(?i)\\b{w}\\b') THEN length(regexp_extract(answer, '(?is)^(.*?)\\b{w}\\b', 1)) ELSE -1 END"
    return f"CASE WHEN {at(p)} = -1 AND {at(n)} = -1 THEN -1 WHEN {at(n)} = -1 OR ({at(p)} >= 0 AND {at(p)} < {at(n)}) THEN 1 ELSE 0 END"


simple("c07_first_yes_or_no", "documents", YES, _first_of_sql("yes", "no"), lambda: E.first_of(c("answer"), "yes", "no"), ints="value")
simple("c07_first_a_or_b", "documents", YES, _first_of_sql("A", "B"), lambda: E.first_of(c("answer"), "A", "B"), ints="value")
simple("c08_leading_yes_no", "documents", YES, "CASE WHEN starts_with(lower(answer), 'yes') THEN 'yes' WHEN starts_with(lower(answer), 'no') THEN 'no' END", lambda: E.leading_yes_no(c("answer")))

TF = "o_orderkey AS idx, CASE o_orderkey % 5 WHEN 0 THEN 'It is True.' WHEN 1 THEN 'F' WHEN 2 THEN 'true or false?' WHEN 3 THEN 'unknown' ELSE concat('t', CASE WHEN o_custkey % 2 = 0 THEN ' it is' ELSE 'he thing, FALSE' END) END AS answer"
simple("c09_true_false", "orders", TF, "CASE WHEN len(regexp_extract_all(answer, '(?i)\\b(t|f|true|false)\\b')) = 1 THEN upper(regexp_extract(answer, '(?i)\\b(t|f|true|false)\\b', 1)[1]) END", lambda: E.true_false(c("answer")))

RULE = f"o_orderkey AS idx, CASE o_orderkey % 6 WHEN 0 THEN {LETTER} WHEN 1 THEN concat({LETTER}, '. x') WHEN 2 THEN concat({LETTER}, ') y') WHEN 3 THEN 'B. high ring' WHEN 4 THEN 'E' ELSE concat({LETTER}, '; z') END AS answer, 'B. high ring' AS gold"
simple("c10_choice_by_rule", "orders", RULE, "CASE WHEN answer = gold THEN 1 WHEN answer IN ('A','B','C','D') THEN CAST(answer = gold[1] AS INT) WHEN regexp_matches(answer, '^[ABCD]\\.') THEN CAST(split_part(answer, '.', 1) = gold[1] AS INT) WHEN regexp_matches(answer, '^[ABCD]\\)') THEN CAST(split_part(answer, ')', 1) = gold[1] AS INT) END", lambda: E.choice_by_rule(c("answer"), c("gold")), ints="value")

CAP = """o_orderkey AS idx, CASE o_orderkey % 8 WHEN 0 THEN 'Caption A: a cat runs' WHEN 1 THEN 'a cat runs' WHEN 2 THEN '(A) a dog sits' WHEN 3 THEN 'Caption B' WHEN 4 THEN 'B.' WHEN 5 THEN 'A' WHEN 6 THEN 'Option C' ELSE 'nothing' END AS answer,
 CASE WHEN o_custkey % 2 = 0 THEN 'Caption A: a cat runs' ELSE 'Caption B: a dog sits' END AS gold"""
simple("c11_match_caption_option", "orders", CAP, "CASE WHEN answer IN ('Caption A: a cat runs', 'a cat runs', 'A') THEN CAST(starts_with(gold, 'Caption A') AS INT) WHEN answer IN ('(A) a dog sits', 'Caption B', 'B.') THEN CAST(starts_with(gold, 'Caption B') AS INT) END",
       lambda: E.match_caption_option(c("answer"), c("gold"), F.array(F.lit("Caption A: a cat runs"), F.lit("Caption B: a dog sits"))), ints="value")

MOST = f"o_orderkey AS idx, CASE o_orderkey % 6 WHEN 0 THEN concat('(', {LETTER}, ') and (B), ') WHEN 1 THEN concat(' ', {LETTER}, {LETTER}, 'C') WHEN 2 THEN 'the high ring.' WHEN 3 THEN 'low gear, low gear; high ring' WHEN 4 THEN 'nothing at all?' ELSE '(A)(B)(A) C' END AS answer"
_STRIPPED = "answer"
for _m in [",", ".", "!", "?", ";", ":", "'"]:
    _STRIPPED = f"regexp_replace({_STRIPPED}, {quoted('^[' + _m + ']+|[' + _m + ']+$')}, '', 'g')"
_cnt = lambda part: f"((length(s) - length(replace(s, {part}, ''))) // length({part}))"
_tier = lambda parts: "[" + ", ".join(_cnt(p) for p in parts) + "]"
_T1, _T2, _T3 = _tier([f"'({x})'" for x in "ABCD"]), _tier([f"'{x}'" for x in "ABCD"]), _tier([quoted(OPTIONS[x]) for x in "ABCD"])


@query("c12_most_frequent_choice", over("orders", MOST, f""", s AS (SELECT idx, ' ' || {_STRIPPED} || ' ' AS s FROM d), t AS (SELECT idx, CASE WHEN list_max({_T1}) > 0 THEN {_T1} WHEN list_max({_T2}) > 0 THEN {_T2} WHEN list_max({_T3}) > 0 THEN {_T3} END AS n FROM s)
 SELECT idx, CASE WHEN n IS NOT NULL THEN array_to_string(list_filter(['A','B','C','D'], lambda x, i: n[i] = list_max(n)), '') END AS value FROM t"""))
def most_frequent_choice(t):
    texts = {k: F.lit(v) for k, v in OPTIONS.items()}
    return t.derive("orders", MOST).select("idx", E.most_frequent_choice(c("answer"), list("ABCD"), texts).alias("value"))


TAGS = f"""o_orderkey AS idx, CASE o_orderkey % 7 WHEN 0 THEN concat('<think>A</think><answer>', {LETTER}, ': yes</answer>') WHEN 1 THEN concat('<answer> E </answer> later <answer>', {LETTER}, '</answer>') WHEN 2 THEN '<answer>AB [F]</answer>' WHEN 3 THEN 'no tag'
 WHEN 4 THEN concat('so <ans>', {LETTER}, '</ans> done') WHEN 5 THEN concat('{{x}} and {{ ', {LETTER}, ' }}') ELSE '<answer>none</answer>' END AS answer"""
_LAST = "regexp_replace(regexp_extract_all(answer, '(?s)<answer>\\s*(.*?)\\s*</answer>', 1)[-1], '^\\s+|\\s+$', '', 'g')"
_TAG = "CASE " + " ".join(f"WHEN contains({_LAST}, '{x} ') OR contains({_LAST}, '{x}:') OR contains({_LAST}, '[{x}') THEN '{x}'" for x in "ABCDEF") + " " + " ".join(f"WHEN contains({_LAST}, '{x}') THEN '{x}'" for x in "ABCDEF") + " ELSE 'WRONG' END"


@query("c13_tagged_answer", over("orders", TAGS, f"""SELECT idx, {_TAG} AS tagged, CASE WHEN contains(answer, '<ans>') THEN split_part(split_part(answer, '<ans>', 2), '</ans>', 1) ELSE answer END AS ans,
 coalesce(regexp_extract_all(lower(answer), '\\{{(.*?)\\}}', 1)[-1], '') AS braces, nullif(regexp_extract(answer, '[A-Z]', 0), '') AS capital FROM d"""))
def tagged_answer(t):
    a = c("answer")
    return t.derive("orders", TAGS).select("idx", E.tagged_option(a).alias("tagged"), E.ans_tag(a).alias("ans"), E.last_braces(a).alias("braces"), E.first_capital(a).alias("capital"))


FENCE = f"""o_orderkey AS idx, {LETTER} AS gold, o_custkey % 50 + 10.5 AS duration, CASE o_orderkey % 6 WHEN 0 THEN concat('```json', chr(10), '{{"result": ', {LETTER}, '}}', chr(10), '```') WHEN 1 THEN '```json {{"result": "B"}} ``` C' WHEN 2 THEN concat('the answer is ', {LETTER}, ' or C') WHEN 3 THEN 'nothing here'
 WHEN 4 THEN '```json {{broken ``` D' ELSE '```json {{"other": 1}} ```' END AS answer""".replace("{{", "{").replace("}}", "}")
_FJ = "regexp_replace(regexp_extract(answer, '(?s)```json(.*?)```', 1), '^\\s+|\\s+$', '', 'g')"
_FQ = f"regexp_replace({_FJ}, '(:\\s)([A-Za-z_]\\w*)', '\\1\"\\2\"', 'g')"
_FR = f"CASE WHEN json_valid({_FQ}) THEN json_extract_string({_FQ}, '$.result') END"
simple("c14_fenced_choice_score", "orders", FENCE, f"CASE WHEN {_FR} IS NOT NULL THEN CAST({_FR} = gold AS INT) WHEN len(regexp_extract_all(answer, '\\b[A-H]\\b')) > 0 THEN CAST(list_contains(regexp_extract_all(answer, '\\b[A-H]\\b'), gold) AS INT) ELSE -1 END",
       lambda: E.fenced_choice_score(c("answer"), c("gold")), ints="value")
simple("c14_fenced_open_result", "orders", FENCE, f"coalesce(CASE WHEN json_valid({_FJ}) THEN json_extract_string({_FJ}, '$.result') END, answer)", lambda: E.fenced_open_result(c("answer")))

SPANS = """event_id AS idx, 100e0 AS duration, concat(CASE event_id % 4 WHEN 0 THEN '```json {"result": [[0.1, 0.4], [0.5, 0.75]]} ```' WHEN 1 THEN '```json {"result": [5, 20.5]} ```' WHEN 2 THEN concat('from ', CAST(event_id % 50 AS VARCHAR(9)), ' to ', CAST(event_id % 50 + 9 AS VARCHAR(9)), ' sec, 3') ELSE 'about 7' END, '') AS answer"""


@query("c14_fenced_intervals", over("events", SPANS, "SELECT idx, CASE event_id_mod WHEN 0 THEN '10.0,40.0;50.0,75.0' WHEN 1 THEN '5.0,20.5' WHEN 2 THEN CAST(idx % 50 AS VARCHAR) || '.0,' || CAST(idx % 50 + 9 AS VARCHAR) || '.0' END AS spans FROM (SELECT *, idx % 4 AS event_id_mod FROM d)"))
def fenced_intervals(t):
    found = E.fenced_intervals(c("answer"), c("duration"))
    text = F.array_join(F.transform(found, lambda p: F.concat_ws(",", p[0].cast("string"), p[1].cast("string"))), ";")
    return t.derive("events", SPANS).select("idx", text.alias("spans"))


OBJECTS = "event_id AS idx, concat('so ', props, ' {bad ', CASE WHEN event_id % 2 = 0 THEN concat('{\"a\": {\"b\": ', CAST(event_id % 9 AS VARCHAR(9)), '}}') ELSE '' END, ' end}') AS answer"


@query("c15_json_objects", over("events", OBJECTS, """, p AS (SELECT idx, unnest(CASE WHEN idx % 2 = 0 THEN [regexp_extract(answer, '\\{\"k\": \\d+\\}', 0), '{\"a\": {\"b\": ' || (idx % 9) || '}}'] ELSE [regexp_extract(answer, '\\{\"k\": \\d+\\}', 0)] END) AS obj FROM d) SELECT idx, obj FROM p"""))
def json_objects(t):
    return t.derive("events", OBJECTS).select("idx", F.explode(E.json_objects(c("answer"))).alias("obj"))


COUNTS = """o_orderkey AS idx, CASE o_orderkey % 8 WHEN 0 THEN concat('There are ', CAST(o_custkey % 40 AS VARCHAR(9)), ' cats') WHEN 1 THEN 'twenty one' WHEN 2 THEN 'two hundred and five things' WHEN 3 THEN 'three or 4' WHEN 4 THEN 'nothing' WHEN 5 THEN 'zero' WHEN 6 THEN 'Thousand' ELSE concat('fig. ', CAST(o_custkey % 25 AS VARCHAR(9)), ' has seven') END AS answer"""
_WORDS = "(" + "|".join(E.COUNT_WORDS) + ")"


@query("c16_numbers", over("orders", COUNTS, f""", w AS (SELECT idx, regexp_extract_all(lower(answer), '\\d+') AS g, list_transform(regexp_extract_all(lower(answer), '\\b{_WORDS}\\b', 1), lambda x: CAST({map_sql(E.COUNT_WORDS)}[x] AS INT)) AS v FROM d),
 s AS (SELECT idx, g, list_reduce(list_transform(v, lambda x: {{'t': 0, 'r': x, 'x': x}}), lambda a, b: CASE WHEN b.x >= 100 THEN {{'t': a.t + greatest(a.r, 1) * b.x, 'r': 0, 'x': 0}} ELSE {{'t': a.t, 'r': a.r + b.x, 'x': 0}} END, {{'t': 0, 'r': 0, 'x': 0}}) AS f FROM w),
 l AS (SELECT idx, list_concat(list_transform(g, lambda x: CAST(x AS DOUBLE)), CASE WHEN f.t + f.r <> 0 THEN [CAST(f.t + f.r AS DOUBLE)] ELSE [] END) AS n FROM s) SELECT idx, CASE WHEN len(n) = 1 THEN n[1] END AS single, len(n) AS found FROM l"""), "single", "found")
def numbers(t):
    n = E.numbers(c("answer"))
    return t.derive("orders", COUNTS).select("idx", E.single_number(c("answer")).alias("single"), F.size(n).alias("found"))


_SMALL = [w for w, n in E.COUNT_WORDS.items() if n <= 20]
_FOUND = f"regexp_extract(lower(answer), '\\b(?:[0-9]|1[0-9]|20)\\b|\\b(?:{'|'.join(_SMALL)})\\b', 0)"
simple("c17_count_0_20", "orders", COUNTS, f"CAST(coalesce({map_sql({w: E.COUNT_WORDS[w] for w in _SMALL})}[{_FOUND}], nullif({_FOUND}, '')) AS INT)", lambda: E.count_0_20(c("answer")), ints="value")

BOXES = """o_orderkey AS idx, CASE o_orderkey % 5 WHEN 0 THEN concat('[0.1, 0.2, 0.', CAST(o_custkey % 9 + 1 AS VARCHAR(3)), ', 1]') WHEN 1 THEN '0.1,0.2,0.3,0.4 and 0.5,0.6,0.7,0.8' WHEN 2 THEN 'none' WHEN 3 THEN concat('pyautogui.click(x=0.', CAST(o_custkey % 90 + 10 AS VARCHAR(3)), ', y=0.5)') ELSE '0, .5, 1, 0.75' END AS answer"""
_ONE = "(\\d?(?:\\.\\d+)?),\\s?(\\d?(?:\\.\\d+)?),\\s?(\\d?(?:\\.\\d+)?),\\s?(\\d?(?:\\.\\d+)?)"


@query("c18_parse_box_point", over("orders", BOXES, f"SELECT idx, {', '.join(f'''CASE WHEN len(regexp_extract_all(answer, '{_ONE}')) = 1 THEN try_cast(regexp_extract(answer, '{_ONE}', {i}) AS DOUBLE) END AS b{i}''' for i in range(1, 5))}, coalesce(try_cast(nullif(regexp_extract(answer, 'x=([\\d.]+), y=([\\d.]+)', 1), '') AS DOUBLE), 0) AS x, coalesce(try_cast(nullif(regexp_extract(answer, 'x=([\\d.]+), y=([\\d.]+)', 2), '') AS DOUBLE), 0) AS y FROM d"), "b1 b2 b3 b4 x y")
def parse_box_point(t):
    df = t.derive("orders", BOXES).withColumn("b", E.parse_box(c("answer"))).withColumn("p", E.parse_point(c("answer")))
    return df.select("idx", *[F.get("b", F.lit(i - 1)).alias(f"b{i}") for i in range(1, 5)], F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))


RATING = """event_id AS idx, concat(CASE WHEN event_id % 3 = 0 THEN 'Reality Assessment Score: ' ELSE 'Total Score for Reality Assessment: **' END, CAST(event_id % 10 / 10e0 AS VARCHAR(9)), chr(10), 'Aesthetics Rating: ', CAST(event_id % 7 / 7e0 AS VARCHAR(30)), chr(10), CASE WHEN event_id % 4 = 0 THEN '' ELSE 'Instruction consistency rating: 0.5' END) AS answer"""
_rate = lambda pats: [f"try_cast(nullif(regexp_extract(answer, '(?i){p}', 1), '') AS DOUBLE)" for p in pats]
_GOLD = _rate(["Reality Assessment Score:\\s*([\\d.]+)", "Aesthetics Rating:\\s*([\\d.]+)", "Instruction Consistency Rating:\\s*([\\d.]+)"])
_PRED = _rate(["Total Score(?: for Reality Assessment)?:[\\s\\*]*([\\d.]+)", "Aesthetics Rating\\D*([\\d.]+)", "Instruction Consistency Rating\\D*([\\d.]+)"])


@query("c19_rating_lines", over("events", RATING, "SELECT idx, " + ", ".join(f"CASE WHEN {' IS NOT NULL AND '.join(p)} IS NOT NULL THEN {p[i]} END AS {n}_{k}" for n, p in (("gold", _GOLD), ("pred", _PRED)) for i, k in enumerate(("reality", "aesthetics", "consistency"))) + " FROM d"),
       "gold_reality gold_aesthetics gold_consistency pred_reality pred_aesthetics pred_consistency")
def rating_lines(t):
    df = t.derive("events", RATING)
    g, p = E.rating_lines(c("answer"), "gold"), E.rating_lines(c("answer"), "prediction")
    return df.select("idx", *[s[k].alias(f"{n}_{k}") for n, s in (("gold", g), ("pred", p)) for k in ("reality", "aesthetics", "consistency")])


FRACTIONS = "event_id AS idx, concat('score of component 1: ', CAST(event_id % 3 AS VARCHAR(9)), '/2, score of component 2: ', CAST(event_id % 9 AS VARCHAR(9)), '/8, total score: ', CAST(event_id % 11 AS VARCHAR(9)), CASE WHEN event_id % 10 = 0 THEN '' ELSE '/10' END, '. Because it is so, 1/2.') AS raw"


@query("c20_component_fractions", over("events", FRACTIONS, ", e AS (SELECT 'content' AS component, (idx % 3) / 2 AS score FROM d WHERE idx % 10 > 0 UNION ALL SELECT 'length', (idx % 9) / 8 FROM d WHERE idx % 10 > 0 UNION ALL SELECT 'total_score', (idx % 11) / 10 FROM d WHERE idx % 10 > 0) SELECT component, avg(score) AS score, count(*) AS n FROM e GROUP BY component"), "score", "n")
def component_fractions(t):
    parsed = E.component_fractions(c("raw"), F.array(F.lit("content"), F.lit("length")))
    return t.derive("events", FRACTIONS).select(F.explode(parsed).alias("component", "score")).groupBy("component").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n"))


VERDICT = "o_orderkey AS idx, CASE o_orderkey % 7 WHEN 0 THEN 'So [[A>>B]] and again [[A>>B]]' WHEN 1 THEN '[[A>B]]' WHEN 2 THEN '[[A=B]] [[B>A]]' WHEN 3 THEN '[[B>A]]' WHEN 4 THEN '[[B>>A]]' WHEN 5 THEN 'tie' ELSE '[[AB]]' END AS answer"
simple("c21_pairwise_verdict", "orders", VERDICT, "CASE WHEN len(list_distinct(regexp_extract_all(answer, '\\[\\[([AB<>=]+)\\]\\]', 1))) = 1 THEN CAST(MAP {'A>>B': -2, 'A>B': -1, 'A=B': 0, 'B>A': 1, 'B>>A': 2}[regexp_extract(answer, '\\[\\[([AB<>=]+)\\]\\]', 1)] AS INT) END", lambda: E.pairwise_verdict(c("answer")), ints="value")
simple("c22_clock_to_seconds", "orders", "o_orderkey AS idx, concat(CAST(o_orderkey % 24 AS VARCHAR(9)), ':', CAST(o_custkey % 60 AS VARCHAR(9)), ':', CAST(o_custkey % 60 + 0.25 AS VARCHAR(9))) AS answer", "(idx % 24) * 3600 + CAST(split_part(answer, ':', 2) AS INT) * 60 + CAST(split_part(answer, ':', 3) AS DOUBLE)", lambda: E.clock_to_seconds(c("answer")), doubles="value")

OPTQ = "p_partkey AS idx, concat('Which one?', chr(10), 'A. ', p_name, '.', chr(10), ' B. ', p_type, chr(10), 'no option', chr(10), 'D.', p_brand, ' . ') AS question"


@query("c23_options_from_question", over("part", OPTQ, "SELECT idx, trim(split_part(split_part(question, 'A. ', 2), chr(10), 1), '. ') AS a, split_part(split_part(question, ' B. ', 2), chr(10), 1) AS b, NULL AS c, trim(split_part(question, 'D.', 2), '. ') AS d FROM d"))
def options_from_question(t):
    m = E.options_from_question(c("question"))
    return t.derive("part", OPTQ).select("idx", *[F.try_element_at(m, F.lit(x.upper())).alias(x) for x in "abcd"])


SPLITS = f"o_orderkey AS idx, CASE o_orderkey % 4 WHEN 0 THEN concat('Reason. Answer: <<', {LETTER}, '>>.') WHEN 1 THEN concat('Answer A, no, Answer :', {LETTER}, ' it is') WHEN 2 THEN 'K is it' ELSE concat('Answer: it is ', {LETTER}) END AS answer"
simple("c24_clean_split_answer", "orders", SPLITS, "nullif(regexp_extract(trim(regexp_replace(trim(string_split(answer, 'Answer')[-1]), '[<>:.]', '', 'g')), '^[A-H]', 0), '')", lambda: E.clean_split_answer(c("answer")))

SCORES = f"""o_orderkey AS idx, CASE o_orderkey % 6 WHEN 0 THEN concat('{{"score_completeness": ', CAST(o_custkey % 5 AS VARCHAR(9)), ', "score_reliability": 3, x}}') WHEN 1 THEN 'Correct! It is.' WHEN 2 THEN 'This is Incorrect' WHEN 3 THEN concat('Reasoning: none', chr(10), 'Answer: ', {LETTER}, '. yes') WHEN 4 THEN 'the score is right' ELSE '{{''pred'': ''Yes'', ''score'': 4}}' END AS answer, 'B. yes' AS gold""".replace("{{", "{").replace("}}", "}")


@query("c25_judge_scores", over("orders", SCORES, f"""SELECT idx, CASE WHEN idx % 6 = 0 THEN CAST(regexp_extract(answer, 'completeness": (\\d+)', 1) AS DOUBLE) + 3 ELSE 0 END AS key_sum, CASE WHEN idx % 6 = 1 THEN 1 ELSE 0 END AS phrase,
 CASE WHEN idx % 6 = 3 AND contains(answer, 'Answer: B. yes') THEN 1 ELSE 0 END AS judged, CASE WHEN idx % 6 = 4 THEN 1 END AS right_wrong, CASE WHEN idx % 6 = 5 THEN 1 ELSE -1 END AS dict_correct, CASE WHEN idx % 6 = 5 THEN 4.0 ELSE -1.0 END AS dict_score FROM d"""), "key_sum dict_score", "phrase judged right_wrong dict_correct")
def judge_scores(t):
    a = c("answer")
    d = E.score_dictionary(a)
    return t.derive("orders", SCORES).select("idx", E.key_scores_sum(a, ["score_completeness", "score_reliability"]).alias("key_sum"), E.correct_phrase(a).alias("phrase"),
                                             E.judged_answer(a, c("gold")).alias("judged"), E.right_wrong(a).alias("right_wrong"), d["correct"].alias("dict_correct"), d["score"].alias("dict_score"))


DIRECT = """event_id AS idx, concat('**Score of color:** ', CAST(event_id % 6 AS VARCHAR(9)), ' / 5', chr(10), 'score of text_size: 1/4 ', CASE WHEN event_id % 3 = 0 THEN 'Summary: it is **True** now' WHEN event_id % 3 = 1 THEN 'summary false summary True' ELSE '' END) AS answer"""


@query("c25_direct_scores", over("events", DIRECT, "SELECT idx, (idx % 6) / 5 AS color, 0.25 AS text_size, CASE WHEN idx % 3 < 2 THEN 1 END AS summary FROM d"), "color text_size", "summary")
def direct_scores(t):
    m = E.direct_scores(c("answer"))
    return t.derive("events", DIRECT).select("idx", F.try_element_at(m, F.lit("color")).alias("color"), F.try_element_at(m, F.lit("text_size")).alias("text_size"), E.summary_true_false(c("answer")).alias("summary"))


FIELD = f"""o_orderkey AS idx, CASE o_orderkey % 6 WHEN 0 THEN concat('Thoughts. Answer: ', {LETTER}, ' ') WHEN 1 THEN concat('**Answer: ', {LETTER}, '** because') WHEN 2 THEN concat('```python', chr(10), {LETTER}, ' = 1', chr(10), '```') WHEN 3 THEN concat('Answer: "', {LETTER}, ' x"') WHEN 4 THEN 'Answer: [1, 2]' ELSE concat('Answer: yes', chr(10), chr(10), 'Further text ', {LETTER}) END AS answer, {LETTER} AS letter"""


@query("c26_answer_field", over("orders", FIELD, """SELECT idx, CASE idx % 6 WHEN 0 THEN letter WHEN 1 THEN letter WHEN 2 THEN letter || ' = 1' WHEN 3 THEN letter || ' x' WHEN 4 THEN '[1, 2]' ELSE 'yes' || chr(10) || chr(10) || 'Further text ' || letter END AS field,
 CASE idx % 6 WHEN 0 THEN letter WHEN 1 THEN letter WHEN 2 THEN letter || ' = 1' WHEN 3 THEN letter || ' x' WHEN 4 THEN '[1, 2]' ELSE 'yes' END AS single_line FROM d"""))
def answer_field(t):
    field = E.answer_field(c("answer"))
    return t.derive("orders", FIELD).select("idx", field.alias("field"), E.drop_additional_text(field).alias("single_line"))


LITERALS = """o_orderkey AS idx, concat('[''it''s'', ', CAST(o_custkey % 7 AS VARCHAR(9)), ', "x"]') AS l, concat('b, a ,', CAST(o_custkey % 3 AS VARCHAR(9)), ', b') AS s, concat('{''k'': ''v', CAST(o_custkey % 5 AS VARCHAR(9)), ''', "n": 2}') AS m,
 concat('[(0.1, 0.2, 0.', CAST(o_custkey % 9 + 1 AS VARCHAR(9)), ', 1), [1, 2]]') AS b, '[(1, 2), (3, 4, 5), (6, 7)]' AS p"""


@query("c27_parse_literals", over("orders", LITERALS, """SELECT idx, array_to_string(['it''s', split_part(l, ', ', 2), 'x'], '|') AS list_text, array_to_string(list_sort(list_distinct(list_transform(string_split(s, ','), lambda x: trim(x)))), '|') AS set_text,
 regexp_extract(m, 'v\\d+', 0) || '|2' AS map_text, 1 AS boxes, CAST(split_part(b, ', ', 3) AS DOUBLE) AS x2, 2 AS points FROM d"""), "x2", "boxes points")
def parse_literals(t):
    m, boxes = E.literal_dict(c("m")), E.literal_boxes(c("b"))
    return t.derive("orders", LITERALS).select("idx", F.array_join(E.literal_list(c("l")), "|").alias("list_text"), F.array_join(E.literal_set(c("s")), "|").alias("set_text"),
                                               F.concat_ws("|", F.try_element_at(m, F.lit("k")), F.try_element_at(m, F.lit("n"))).alias("map_text"), F.size(boxes).alias("boxes"),
                                               F.element_at(boxes, 1)[2].alias("x2"), F.size(E.literal_points(c("p"))).alias("points"))
