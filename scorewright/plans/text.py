"""Corpus text queries (B)."""

from pyspark.sql import functions as F

from scorewright.functions import text as X
from scorewright.operators.skew import spread
from scorewright.plans.catalog import over, query

U32 = "4294967296.0"


def unit_sql(*parts: str, seed: str = "0") -> str:
    """Check form of the seeded hash draw."""
    key = " || ':' || ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"(('0x' || substr(md5({key}), 1, 8))::UBIGINT / {U32})"


# letters with accents, spelled as a plain x where the check engine counts bytes or sees them as no word letters
ACCENTS = "éèêëçôàâîïûùüöäßñáíóúÉÈÊËÇÔÀÂÎÏÛÙÜÖÄÑÁÍÓÚ"


def plain(column: str) -> str:
    return f"translate({column}, '{ACCENTS}', '{'x' * len(ACCENTS)}')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PERSONS = "doc_id, replace(replace(text, ' the ', ' <person> '), ' of ', ' <PERSON>, and <Person> ') AS text"


@query("b01_replace_person", over("documents", PERSONS, f""", m AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '<person>([,\\s]*(and)*[,\\s]*<person>)+', ' people ', 'gi'), '(?i)<person>') AS p FROM d)
 SELECT doc_id, array_to_string(list_transform(p, lambda x, i: CASE WHEN i = 1 THEN x ELSE ' ' || {X.PERSON_PHRASES}[CAST(floor({unit_sql('doc_id', '(i - 1)')} * 3) AS INT) + 1] || ' ' || x END), '') AS text FROM m"""))
def replace_person(t):
    df = t.derive("documents", PERSONS)
    return df.select("doc_id", X.replace_person(F.col("text"), F.col("doc_id")).alias("text"))


CAPTIONS = "doc_id, concat(CASE doc_id % 3 WHEN 0 THEN 'The image features This is ' WHEN 1 THEN 'In this image, we see ' ELSE 'It. The image is ' END, text) AS text"


def _strip_sql(expr):
    for p in X.CAPTION_OPENINGS:
        expr = f"replace({expr}, {quoted(p)}, '')"
    return expr


@query("b02_strip_caption_prefix", over("documents", CAPTIONS, f"SELECT doc_id, {_strip_sql('text')} AS text FROM d"))
def strip_caption_prefix(t):
    return t.derive("documents", CAPTIONS).select("doc_id", X.strip_caption_prefix(F.col("text")).alias("text"))


@query("b03_short_or_long", f"SELECT doc_id, CASE WHEN {unit_sql('doc_id')} < 0.5 THEN split_part(text, '.', 1) ELSE text END AS text FROM documents")
def short_or_long(t):
    return t.documents.select("doc_id", X.short_or_long(F.col("text"), F.col("doc_id")).alias("text"))


@query("b04_one_line", "SELECT doc_id, replace(text, chr(10), '') AS text FROM documents")
def one_line(t):
    return t.documents.select("doc_id", X.one_line(F.col("text")).alias("text"))


@query("b05_random_crop", f"SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, CAST(floor({unit_sql('doc_id', seed='7')} * (length(text) - 200)) AS INT) + 1, 200) ELSE text END AS text FROM documents")
def random_crop(t):
    return t.documents.select("doc_id", X.random_crop(F.col("text"), 200, F.col("doc_id"), seed="7").alias("text"))


_COUNT = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"


@query("b06_drop_long", f"WITH d AS (SELECT doc_id, {_COUNT} AS n FROM documents) SELECT doc_id, n, mode FROM d, (SELECT unnest(['chat', 'question', 'image_text', 'caption']) AS mode) m WHERE CASE mode WHEN 'chat' THEN n < 120 WHEN 'caption' THEN n <= 118 ELSE n <= 120 END", ints="n")
def drop_long(t):
    counted = t.documents.select("doc_id", F.size(X.words(F.col("text"))).alias("n"))
    modes = F.filter(F.array(*[F.when(X.fits(F.col("n"), 120, m), m) for m in ("chat", "question", "image_text", "caption")]), lambda m: m.isNotNull())
    return counted.select("doc_id", "n", F.explode(modes).alias("mode"))


MEMBERS = "page_id, CASE WHEN page_id % 3 = 0 THEN url END AS jpg, CASE WHEN page_id % 2 = 0 THEN url END AS png, CASE WHEN page_id % 5 = 0 THEN html END AS txt, html AS caption, url AS extra"


@query("b07_coalesce_alternatives", over("pages", MEMBERS, "SELECT coalesce(jpg, png) AS images, coalesce(txt, caption) AS input_ids FROM d"))
def coalesce_alternatives(t):
    return X.coalesce_alternatives(t.derive("pages", MEMBERS), {"images": ["jpg", "png", "jpeg", "webp"], "input_ids": ["text", "txt", "caption"]})


URLS = """doc_id, concat('/data/', CASE doc_id % 7 WHEN 0 THEN 'laion-12m' WHEN 1 THEN 'cc12m' WHEN 2 THEN 'text-to-image-2M' WHEN 3 THEN 'ai2d' WHEN 4 THEN 'clevr' WHEN 5 THEN 'geo170k' ELSE 'other' END, '/', source, '.tar') AS url,
 concat(CASE WHEN doc_id % 11 = 0 THEN 'sa_' ELSE 'img_' END, CAST(doc_id AS VARCHAR(20))) AS key"""
_ROUTE = "CASE " + " ".join(f"WHEN contains({c}, '{p}') THEN '{r}'" for c, p, r in X.SOURCE_RULES) + " ELSE 'key_map' END"


@query("b08_route_by_source", over("documents", URLS, f"SELECT doc_id, {_ROUTE} AS rule FROM d"))
def route_by_source(t):
    return t.derive("documents", URLS).select("doc_id", X.route_by_source(F.col("url"), F.col("key")).alias("rule"))


@query("b09_choose_image_mode", over("documents", URLS, "SELECT doc_id, CASE WHEN contains(url, 'ai2d') OR contains(url, 'clevr') OR contains(url, 'docvqa') OR contains(url, 'geo') THEN 'squash' ELSE 'centre_crop' END AS mode FROM d"))
def choose_image_mode(t):
    return t.derive("documents", URLS).select("doc_id", X.choose_image_mode(F.col("url")).alias("mode"))


@query("b10_render_reasoning_prompt", f"""SELECT q.conv_id, q.turn, {quoted(X.USER_HEADER + X.THINK_ANSWER)} || q.text || {quoted(chr(10) + '<eot_id>' + X.ASSISTANT_HEADER)} || a.text AS txt
 FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'""")
def render_reasoning_prompt(t):
    q = t.conversations.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = t.conversations.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("solution"))
    return q.join(a, ["conv_id", "turn"]).select("conv_id", "turn", X.render_reasoning_prompt(F.col("question"), F.col("solution")).alias("txt"))


@query("b11_render_caption_to_image_prompt", f"""SELECT doc_id, {quoted(X.USER_HEADER + X.THINK_IMAGE)} || split_part(text, '.', 1) || {quoted('<eot_id>' + X.ASSISTANT_HEADER + '<think>')} || text || '</think>' AS txt FROM documents""")
def render_caption_to_image_prompt(t):
    return t.documents.select("doc_id", X.render_caption_to_image_prompt(F.split_part("text", F.lit("."), F.lit(1)), F.col("text")).alias("txt"))


def _messages(t):
    from scorewright.operators.sampling import gather_turns
    return gather_turns(t.conversations, "conv_id", "turn")


_TURN = "'<|start_header_id|>' || CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END || '<|end_header_id|>' || chr(10) || text || '<|eot_id|>'"


@query("b12_render_chat", f"""WITH r AS (SELECT conv_id, string_agg({_TURN}, '' ORDER BY turn) AS body FROM conversations GROUP BY conv_id) SELECT conv_id, substr(body, 1, length(body) - 10) AS txt FROM r""")
def render_chat(t):
    return _messages(t).select("conv_id", X.render_chat(F.col("messages")).alias("txt"))


@query("b13_trim_turns", f"""WITH n AS (SELECT conv_id, count(*) // 2 AS pairs FROM conversations GROUP BY conv_id), k AS (SELECT conv_id, (floor({unit_sql('conv_id', seed='3')} * pairs) + 1) * 2 AS keep FROM n WHERE pairs >= 1),
 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)
 SELECT o.conv_id, count(*) AS n, string_agg(role || ':' || text, '|' ORDER BY turn) AS body FROM o JOIN k USING (conv_id) WHERE rn <= keep GROUP BY o.conv_id""", ints="n")
def trim_turns(t):
    kept = _messages(t).withColumn("messages", X.trim_turns(F.col("messages"), F.col("conv_id"), seed="3")).filter("messages is not null")
    body = F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["text"])), "|")
    return kept.select("conv_id", F.size("messages").alias("n"), body.alias("body"))


@query("b14_strip_image_placeholder", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)
 SELECT conv_id, string_agg(CASE WHEN rn = 1 THEN text ELSE text || chr(10) || '<image>' END, '|' ORDER BY turn) AS body FROM o GROUP BY conv_id""")
def strip_image_placeholder(t):
    with_marks = t.conversations.withColumn("text", F.when(F.col("turn") % 2 == 0, F.concat(F.col("text"), F.lit("\n<image>"))).otherwise(F.concat(F.col("text"), F.lit("\n<image>"))))
    from scorewright.operators.sampling import gather_turns
    cleaned = gather_turns(with_marks, "conv_id", "turn").withColumn("messages", X.strip_image_placeholder(F.col("messages")))
    return cleaned.select("conv_id", F.array_join(F.transform("messages", lambda m: m["text"]), "|").alias("body"))


RAW = "event_id, CASE WHEN event_id % 13 = 0 THEN 'broken' ELSE CAST(value AS VARCHAR(30)) END AS value, CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_type END AS event_type"


@query("b15_skip_bad_rows", over("events", RAW, """SELECT event_id, 'good' AS side, '' AS failed FROM d WHERE try_cast(value AS DOUBLE) IS NOT NULL AND event_type IS NOT NULL
 UNION ALL SELECT event_id, 'bad', concat_ws(',', CASE WHEN try_cast(value AS DOUBLE) IS NULL THEN 'number' END, CASE WHEN event_type IS NULL THEN 'type' END) FROM d WHERE try_cast(value AS DOUBLE) IS NULL OR event_type IS NULL"""))
def skip_bad_rows(t):
    good, bad = X.skip_bad_rows(t.derive("events", RAW), {"number": F.col("value").try_cast("double").isNotNull(), "type": F.col("event_type").isNotNull()})
    return good.select("event_id", F.lit("good").alias("side"), F.lit("").alias("failed")).unionByName(
        bad.select("event_id", F.lit("bad").alias("side"), F.array_join("failed_checks", ",").alias("failed")))


CHINESE = "doc_id, lang, CASE WHEN doc_id % 6 = 0 THEN concat(text, '图') ELSE text END AS text"


@query("b16_is_chinese", over("documents", CHINESE, "SELECT lang, regexp_matches(text, '[一-鿿]') AS chinese, count(*) AS n FROM d GROUP BY ALL"), ints="n")
def is_chinese(t):
    return t.derive("documents", CHINESE).groupBy("lang", X.is_chinese(F.col("text")).alias("chinese")).agg(F.count(F.lit(1)).alias("n"))


CHOICES = "p_partkey AS idx, p_name AS A, p_brand AS B, CASE WHEN p_size % 2 = 0 THEN p_type END AS C, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR(9)) END AS D"


@query("b17_option_text", over("part", CHOICES, "SELECT idx, 'There are several options: ' || chr(10) || 'A. ' || A || chr(10) || 'B. ' || B || chr(10) || coalesce('C. ' || C || chr(10), '') || coalesce('D. ' || D || chr(10), '') AS block FROM d"))
def option_text(t):
    df = t.derive("part", CHOICES)
    return df.select("idx", X.option_text(X.build_options(df)).alias("block"))


QUESTIONS = """item_id, CASE WHEN item_id % 3 = 0 THEN concat('问', text) ELSE text END AS question, text AS prediction, CASE item_id % 4 WHEN 0 THEN 'yes_no' WHEN 1 THEN 'sort' ELSE 'choice' END AS kind"""


def _fill_sql(name):
    out = quoted(X.JUDGE_TEMPLATES[name])
    for field, value in {"options": "'A. x' || chr(10)", "question": "question", "prediction": "prediction"}.items():
        out = f"replace({out}, '{{{field}}}', {value})"
    return out


@query("b18_build_judge_prompts", over("benchmark", QUESTIONS, f"SELECT item_id, CASE WHEN kind = 'yes_no' THEN {_fill_sql('yes_no')} WHEN kind = 'sort' THEN {_fill_sql('sequence')} WHEN regexp_matches(question, '[一-鿿]') THEN {_fill_sql('choice_chinese')} ELSE {_fill_sql('choice')} END AS prompt FROM d"))
def build_judge_prompts(t):
    df = t.derive("benchmark", QUESTIONS)
    return df.select("item_id", X.build_judge_prompts(F.col("question"), F.lit("A. x\n"), F.col("prediction"), F.col("kind")).alias("prompt"))


def punctuation_sql(text: str) -> str:
    """Check form of the punctuation rule; full stops beside digits are marked before the others are dropped."""
    out = text
    for p in X.PUNCTUATION:
        q = quoted(p)
        out = f"replace({out}, {q}, CASE WHEN contains({text}, {q} || ' ') OR contains({text}, ' ' || {q}) OR regexp_matches({text}, '[0-9],[0-9]') THEN '' ELSE ' ' END)"
    marked = f"regexp_replace(regexp_replace({out}, '([0-9])\\.', '\\1' || chr(1), 'g'), '\\.([0-9])', chr(1) || '\\1', 'g')"
    return f"(SELECT replace(replace({marked}, '.', ''), chr(1), '.'))"


@query("b19_normalise_punctuation", f"SELECT doc_id, {punctuation_sql('text')} AS text FROM documents")
def normalise_punctuation(t):
    return spread(t.documents).select("doc_id", X.normalise_punctuation(F.col("text")).alias("text"))


def map_sql(values: dict) -> str:
    return "MAP {" + ", ".join(f"{quoted(k)}: {quoted(str(v))}" for k, v in values.items()) + "}"


def normalise_sql(text: str) -> str:
    flat = f"regexp_replace(translate({text}, chr(10) || chr(9), '  '), '^\\s+|\\s+$', '', 'g')"
    return f"""(SELECT array_to_string(list_transform(list_filter(list_transform(list_filter(regexp_split_to_array(lower({punctuation_sql('y.f')}), '\\s+'), lambda w: w <> ''), lambda w: coalesce({map_sql(X.NUMBER_WORDS)}[w], w)),
     lambda w: w NOT IN ('a', 'an', 'the')), lambda w: coalesce({map_sql(X.CONTRACTIONS)}[w], w)), ' ') FROM (SELECT {flat} AS f) y)"""


ANSWERS = "item_id, concat(text, ' The dont one, youre (two) 1,000 cats.') AS text"


@query("b20_normalise_answer", over("benchmark", ANSWERS, f"SELECT item_id, {normalise_sql('text')} AS text FROM d"))
def normalise_answer(t):
    return t.derive("benchmark", ANSWERS).select("item_id", X.normalise_answer(F.col("text")).alias("text"))


DIRTY = "doc_id, concat('```markdown', chr(10), text, ' ________ ！！！！！！！！！！！！！！ＡＢＣ　１２ /t -------------- ==', chr(10), '```') AS text"
_WIDE = "　" + "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = " " + "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


@query("b21_clean_document_text", over("documents", DIRTY, f""", f AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^```markdown\\n?', '', 'g'), '(?m)```\\n?$', '', 'g'), '_{{4,}}', '____', 'g'), ' {{4,}}', '    ', 'g') AS text FROM d),
 c AS (SELECT doc_id, i, text[i] AS ch FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM f)),
 g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS run FROM c),
 r AS (SELECT doc_id, ch, min(i) AS i, count(*) AS n FROM g GROUP BY doc_id, ch, run),
 k AS (SELECT doc_id, string_agg(CASE WHEN n >= 11 AND NOT regexp_matches(ch, '[a-zA-Z0-9]') THEN repeat(ch, 4) ELSE repeat(ch, n) END, '' ORDER BY i) AS text FROM r GROUP BY doc_id)
 SELECT doc_id, regexp_replace(replace(replace(replace(replace(replace(replace(translate(text, {quoted(_WIDE)}, {quoted(_NARROW)}), '\\t', ''), '\\n', ''), chr(9), ''), chr(10), ''), '/t', ''), '/n', ''), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS text FROM k"""))
def clean_document_text(t):
    return t.derive("documents", DIRTY, deal=True).select("doc_id", X.clean_document_text(F.col("text")).alias("text"))


JUDGED = "doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN concat('x Failed to obtain answer via API.', text) ELSE text END AS prediction, CASE WHEN doc_id % 4 = 0 THEN -1 ELSE doc_id % 2 END AS score"


@query("b22_drop_rejected", over("documents", JUDGED, "SELECT doc_id, length(prediction) AS n FROM d WHERE prediction IS NOT NULL AND NOT contains(prediction, 'Failed to obtain answer via API')"), ints="n")
def drop_rejected(t):
    return X.drop_rejected(t.derive("documents", JUDGED), "prediction").select("doc_id", F.length("prediction").alias("n"))


@query("b23_drop_unscorable", over("documents", JUDGED, "SELECT doc_id, score FROM d WHERE score <> -1"), ints="score")
def drop_unscorable(t):
    return X.drop_unscorable(t.derive("documents", JUDGED)).select("doc_id", "score")


@query("b24_lower_headers", "SELECT p_partkey AS \"index\", p_name AS question, p_brand AS \"A\", p_type AS answer FROM part")
def lower_headers(t):
    return X.lower_headers(t.part.select(F.col("p_partkey").alias("Index"), F.col("p_name").alias("QUESTION"), F.col("p_brand").alias("A"), F.col("p_type").alias("Answer")))


LABELLED = """p_partkey AS idx, concat('What is shown', CASE WHEN p_size % 4 = 0 THEN ' at B?' ELSE ' there?' END) AS question, CASE WHEN p_size % 3 = 0 THEN 'A' ELSE 'Stage 1' END AS a, CASE WHEN p_size % 5 = 0 THEN 'B and C' ELSE p_name END AS b,
 CASE WHEN p_size % 2 = 0 THEN 'Both' ELSE p_brand END AS c, p_size % 7 > 0 AS marked"""


# the second choice is a two-word name unless it is "B and C", the third is Both or a brand name
@query("b25_flag_label_like_choices", over("part", LABELLED, "SELECT idx, marked AND (1 + CASE WHEN b = 'B and C' THEN 1 ELSE 0 END + CASE WHEN c = 'Both' THEN 1 ELSE 0 END >= 3 OR contains(question, ' B?')) AS flagged FROM d"))
def flag_label_like_choices(t):
    return t.derive("part", LABELLED).select("idx", X.flag_label_like_choices(F.col("question"), [F.col("a"), F.col("b"), F.col("c")], F.col("marked")).alias("flagged"))


SUBTITLES = "user_id AS video, event_id AS line, ts, value, concat(event_type, ' ', CAST(CAST(floor(value) AS BIGINT) % 40 AS VARCHAR(9))) AS text"


@query("b26_subtitle_text", over("events", SUBTITLES, """, s AS (SELECT *, epoch_us(ts) / 1e6 - 1704067200 AS a, epoch_us(ts) / 1e6 - 1704067200 + value * 100 AS b FROM d), f AS (SELECT unnest(generate_series(0, 30)) * 86400.0 AS c),
 h AS (SELECT video, text, min(c) AS c, arg_min(line, (c, a, line)) AS line, arg_min(a, (c, a, line)) AS a FROM s JOIN f ON a < c AND b > c GROUP BY video, text)
 SELECT video, 'The subtitles of the video are as follows:' || chr(10) || chr(10) || string_agg(text, chr(10) ORDER BY c, a, line) || chr(10) || chr(10) AS body FROM h GROUP BY video"""))
def subtitle_text(t):
    from scorewright.operators.intervals import subtitle_text as build
    df = t.derive("events", SUBTITLES)
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200
    lines = df.select("video", "line", "text", seconds.alias("start"), (seconds + F.col("value") * 100).alias("end"))
    times = t.events.select(F.col("user_id").alias("video")).distinct().withColumn("times", F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: i * 86400.0))
    return build(lines, times)


@query("b27_merge_linked_fragments", """WITH RECURSIVE n AS (SELECT o_orderkey AS id, o_custkey % 40 AS page, (o_orderkey * 7919) % 15013 AS pos, o_orderpriority AS category, CAST(o_orderkey AS VARCHAR) AS text FROM orders),
 e AS (SELECT o_orderkey AS a, o_orderkey + 40 * (1 + o_orderkey % 3) AS b FROM orders WHERE o_orderkey % 5 < 2), l AS (SELECT a, b FROM e JOIN n x ON x.id = a JOIN n y ON y.id = b UNION ALL SELECT b, a FROM e JOIN n x ON x.id = a JOIN n y ON y.id = b),
 r(id, root) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
 g AS (SELECT id, min(root) AS root FROM r GROUP BY id),
 m AS (SELECT root, min(pos) AS pos, arg_min(id, (pos, id)) AS id, arg_min(category, (pos, n.id)) AS category, string_agg(text, '' ORDER BY pos, n.id) AS text, count(*) AS parts FROM g JOIN n USING (id) GROUP BY root)
 SELECT id, pos, category, text, parts FROM m UNION ALL SELECT id, pos, category, text, 1 FROM n WHERE id NOT IN (SELECT id FROM g)""", ints="pos parts")
def merge_linked_fragments(t):
    from scorewright.operators.matching import merge_linked_fragments as merge
    nodes = t.orders.select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") * 7919) % 15013).alias("pos"), F.col("o_orderpriority").alias("category"), F.col("o_orderkey").cast("string").alias("text"))
    links = t.orders.filter("o_orderkey % 5 < 2").select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 40 * (1 + F.col("o_orderkey") % 3)).alias("b"))
    return merge(nodes, links)
