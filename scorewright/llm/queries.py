"""Catalogue queries of the operators in this subpackage, with production parameters, and their check statements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from scorewright.llm.centroids import clustered
from scorewright.llm.conversations import damaged, repair_report
from scorewright.llm.decontaminate import contaminated
from scorewright.llm.html_text import extract_text
from scorewright.llm.language_model import language_scores
from scorewright.llm.line_dedup import line_dedup
from scorewright.llm.mixing import mixed
from scorewright.llm.near_duplicates import near_duplicates
from scorewright.llm.neighbours import nearest_vectors
from scorewright.llm.personal_data import counted, personal_data
from scorewright.llm.quality import quality
from scorewright.llm.tables import table
from scorewright.llm.token_counts import token_counts
from scorewright.llm.toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers  # the others do without it

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query
def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).drop("row_key", "stays")


# lower case of A-Z alone, and the words of a text, in the check statements
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

ORACLE["op7_near_duplicates"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.root)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id, d.doc_id = c.root AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) c USING (doc_id)
"""


@query
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.octet_length("text").cast("long").alias("n_bytes_left"), F.md5("text").alias("text_md5"), "text")


ORACLE["op3_line_dedup"] = r"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM s),
w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w WHERE w > 0),
m AS (SELECT a.doc_id AS d, b.doc_id AS e, a.p - b.p AS shift, a.p, a.i, a.w FROM p a JOIN p b ON a.line = b.line AND (b.doc_id, b.p) < (a.doc_id, a.p)),
r AS (SELECT *, p - row_number() OVER (PARTITION BY d, e, shift ORDER BY p) AS run FROM m),
t AS (SELECT *, sum(w) OVER (PARTITION BY d, e, shift, run) AS words FROM r),
gone AS (SELECT DISTINCT d AS doc_id, i FROM t WHERE words >= 50),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT s.doc_id, len(ls)::BIGINT AS n_lines, coalesce(g.n, 0) AS n_removed, strlen(coalesce(k.text, ''))::BIGINT AS n_bytes_left,
       md5(coalesce(k.text, '')) AS text_md5, coalesce(k.text, '') AS text
FROM s LEFT JOIN k USING (doc_id) LEFT JOIN g USING (doc_id)
"""


@query
def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "n_words", F.round("similarity", 6).alias("similarity"))


ORACLE["op1_decontaminate"] = r"""
WITH t AS (SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS ws FROM documents
           UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') FROM benchmark),
s AS (SELECT kind, id, len(ws) AS n, unnest(range(1, greatest(len(ws) - 3, 2))) - 1 AS p, ws FROM t WHERE len(ws) > 0),
g AS (SELECT kind, id, n, p, array_to_string(ws[p + 1:p + 5], ' ') AS g FROM s),
a AS (SELECT DISTINCT d.id AS doc_id, i.n AS size, d.n, greatest(0, least(d.p - i.p, d.n - i.n)) AS start FROM g d JOIN g i ON d.g = i.g AND d.kind = 'd' AND i.kind = 'i'),
v AS (SELECT a.doc_id, a.size, a.start, g.g, count(*) AS c FROM a JOIN g ON g.kind = 'd' AND g.id = a.doc_id AND g.p >= a.start AND g.p <= a.start + greatest(least(a.size, a.n) - 5, 0) GROUP BY ALL),
k AS (SELECT id AS item_id, n, g, count(*) AS c FROM g WHERE kind = 'i' GROUP BY ALL),
vt AS (SELECT doc_id, size, start, sum(c) AS total FROM v GROUP BY ALL),
kt AS (SELECT item_id, sum(c) AS total FROM k GROUP BY ALL),
m AS (SELECT v.doc_id, v.size, v.start, k.item_id, sum(least(v.c, k.c)) AS low FROM v JOIN k ON v.g = k.g AND v.size = k.n GROUP BY ALL),
r AS (SELECT m.*, vt.total + kt.total - low AS high FROM m JOIN vt USING (doc_id, size, start) JOIN kt USING (item_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY low / high DESC, start) AS rn FROM r WHERE low * 100 >= 75 * high)
SELECT doc_id, item_id, start::BIGINT AS start_word, size::BIGINT AS n_words, round(low / high, 6) AS similarity FROM b WHERE rn = 1
"""


@query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, folder, "labels"), keep_text=False)


@query
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality(docs, table(spark, folder, "labels"), keep_text=False)


@query
def op9_language_scores(spark: SparkSession, folder: str) -> DataFrame:
    return language_scores(table(spark, folder, "documents"))


@query
def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(table(spark, folder, "pages").select("page_id", "url", "html"))


@query
def op5_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(table(spark, folder, "documents").select("doc_id", "text", "source")).drop("key")


@query
def op2_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_vectors(table(spark, folder, "embeddings"))


@query
def op11_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clustered(table(spark, folder, "embeddings")).drop("centroid")


def _cluster_sql(rounds: int) -> str:
    """One block of common tables for each round: vectors assigned, centroids moved."""
    apart = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [r"""k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM k QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), v) <= 16)"""]
    for i in range(rounds + 1):
        parts.append(f"""d{i} AS (SELECT k.r, c.c, {apart} AS d FROM k CROSS JOIN c{i} c),
a{i} AS MATERIALIZED (SELECT r, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < rounds:
            parts.append(f"""u{i} AS (SELECT a.c, unnest(k.v) AS x, unnest(range(64)) AS j FROM a{i} a JOIN k USING (r)),
s{i} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM u{i} GROUP BY ALL),
m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN m{i} m USING (c))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT k.vec_id, a.c::INTEGER AS cluster, a.d::BIGINT AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM k JOIN a{rounds} a USING (r) JOIN c{rounds} c USING (c)"""


ORACLE["op11_centroid_clusters"] = _cluster_sql(3)


@query
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    return repair_report(conversations, damaged(conversations))


ORACLE["op12_conversation_repair"] = r"""
WITH RECURSIVE b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
z AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::UBIGINT)),
      lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda y, i: xor(y >> 1, 3988292384::UBIGINT * (y & 1))))) % 20 AS f FROM b),
r AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(range(CASE f WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM z WHERE f <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, left(role, 1) AS i FROM r),
g AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault, lag(i) OVER (PARTITION BY conv_id ORDER BY p) AS j, count(*) OVER (PARTITION BY conv_id) AS n FROM o),
s AS (SELECT DISTINCT conv_id, n, 0 AS p, '' AS last, 0 AS cost, '' AS audit, '' AS made FROM g
  UNION ALL SELECT conv_id, n, p, last, cost, audit, made FROM (
    SELECT x.conv_id, x.n, g.p, CASE e WHEN 'D' THEN x.last WHEN 'K' THEN g.i ELSE x.nxt END AS last, x.cost + CASE e WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e <> 'D' AND g.fault = 't' THEN 3 ELSE 0 END AS cost,
      x.audit || e AS audit, x.made || CASE e WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || g.role || ':' || g.text ELSE chr(10) || CASE x.nxt WHEN 'u' THEN 'user:' ELSE 'assistant:' END || g.text END AS made
    FROM (SELECT conv_id, n, p, cost + 3 * k AS cost, audit || repeat('I', k) AS audit, CASE WHEN k = 0 THEN last ELSE substr(seq, k, 1) END AS last, substr(seq, k + 1, 1) AS nxt,
            made || CASE WHEN k = 0 THEN '' ELSE array_to_string(list_transform(string_split(left(seq, k), ''), lambda c: chr(10) || CASE c WHEN 'u' THEN 'user:' ELSE 'assistant:' END), '') END AS made
          FROM (SELECT *, CASE WHEN last = 'u' THEN 'aua' ELSE 'uau' END AS seq FROM s WHERE p < n), unnest([0, 1, 2]) AS ks(k)) x
    JOIN g ON g.conv_id IS NOT DISTINCT FROM x.conv_id AND g.p = x.p + 1, unnest(['D', 'K', 'R']) AS es(e)
    WHERE e = 'D' OR (g.fault NOT IN ('b', 'd') AND (e = 'R' OR g.i = x.nxt OR (g.i = 's' AND x.last = ''))))
  QUALIFY row_number() OVER (PARTITION BY conv_id, last ORDER BY cost, audit) = 1),
t AS (SELECT conv_id, cost + CASE last WHEN 's' THEN 6 WHEN 'u' THEN 3 ELSE 0 END AS cost, audit || CASE last WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END AS audit,
      made || CASE last WHEN 's' THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 'u' THEN chr(10) || 'assistant:' ELSE '' END AS made FROM s WHERE p = n),
w AS (SELECT conv_id, cost, audit, substr(made, 2) AS made FROM t QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'b') AS blank, count_if(fault = 'd') AS duplicate, count_if(fault = 't') AS truncated,
      count_if(j IS NOT NULL AND j || i NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT a.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
       coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(w.cost, 0)::BIGINT AS cost, coalesce(w.audit, '') AS audit, sha256(coalesce(w.made, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM a.conv_id
"""


@query
def op13_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return counted(personal_data(docs, keep_text=False))
