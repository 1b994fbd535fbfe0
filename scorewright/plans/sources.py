"""Source and sink queries (A). File forms go through a folder in the shared checkpoint space."""

from pyspark.sql import functions as F

from scorewright.plans.catalog import over, query
from scorewright.sources import archives, media, records

c = F.col


def _round_trip(fmt, schema):
    @query(f"a01_read_records_{fmt}", "SELECT n_nationkey, n_name, n_regionkey, 'a \"q\", b' || chr(9) || 'c' AS note FROM nation")
    def run(t):
        folder = records.scratch(t.spark, "records")
        records.write_records(t.nation.withColumn("note", F.lit('a "q", b\tc')), folder, fmt)
        return records.read_records(t.spark, folder, "jsonl" if fmt == "json" else fmt, schema)


for _f in ("csv", "tsv", "jsonl"):
    _round_trip(_f, "n_nationkey INT, n_name STRING, n_regionkey INT, note STRING")


@query("a02_write_records_quoted", "SELECT '\"' || p_partkey || '\",\"' || p_name || '\"' AS line FROM part UNION ALL SELECT DISTINCT '\"p_partkey\",\"p_name\"' FROM part")
def write_records_quoted(t):
    folder = records.scratch(t.spark, "quoted")
    records.write_records(t.part.select("p_partkey", "p_name"), folder, "csv")
    # every part file starts with the header
    return t.spark.read.text(folder).select(c("value").alias("line")).distinct()


@query("a03_parquet_to_tsv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def parquet_to_tsv(t):
    folder = records.scratch(t.spark, "tsv")
    records.parquet_to_tsv(t.spark, f"{t.folder}/customer.parquet", folder)
    return t.spark.read.options(header=True, sep="\t").csv(folder).select("c_custkey", "c_name", "c_mktsegment")


@query("a04_read_corpus", "SELECT text FROM documents")
def read_corpus(t):
    return records.read_corpus(t.spark, f"{t.folder}/documents.parquet", "text")


SHARDS = "n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN concat(n_name, '.tar') ELSE concat(n_name, '-{000..0', CAST(n_nationkey + 10 AS VARCHAR(9)), '}.tar') END AS pattern"


@query("a05_expand_shards", "SELECT n_nationkey AS id, n_name || '.tar' AS shard FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT n_nationkey, n_name || '-' || lpad(CAST(i AS VARCHAR), 3, '0') || '.tar' FROM nation, range(0, 100) r(i) WHERE n_nationkey % 5 > 0 AND i <= n_nationkey + 10")
def expand_shards(t):
    return media.expand_shards(t.derive("nation", SHARDS), "pattern").select("id", "shard")


FILES = "event_id % 4 AS url, event_id AS position, CASE WHEN event_id % 101 = 0 THEN 'noext' ELSE concat('d/k', CAST(CAST(floor(event_id / 20) AS BIGINT) AS VARCHAR(20)), '.', upper(event_type)) END AS fname, CAST(user_id AS VARCHAR(20)) AS data"


@query("a06_group_members", """WITH RECURSIVE f AS (SELECT event_id % 4 AS url, event_id AS pos, 'd/k' || event_id // 20 AS key, event_type AS s, CAST(user_id AS VARCHAR) AS d FROM events WHERE event_id % 101 > 0),
 g AS (SELECT *, row_number() OVER (PARTITION BY url, key ORDER BY pos) AS i FROM f),
 r(url, key, i, pos, s, d, no, seen) AS (SELECT url, key, i, pos, s, d, 0, [s] FROM g WHERE i = 1 UNION ALL SELECT g.url, g.key, g.i, g.pos, g.s, g.d, CASE WHEN list_contains(r.seen, g.s) THEN r.no + 1 ELSE r.no END, CASE WHEN list_contains(r.seen, g.s) THEN [g.s] ELSE list_append(r.seen, g.s) END FROM r JOIN g ON g.url = r.url AND g.key = r.key AND g.i = r.i + 1)
 SELECT url, key, min(pos) AS first_position, string_agg(s || '=' || d, ',' ORDER BY pos) AS members FROM r GROUP BY url, key, no""", ints="url first_position")
def group_members(t):
    out = media.group_members(t.derive("events", FILES))
    text = F.array_join(F.transform(F.map_entries("members"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select("url", "key", "first_position", text.alias("members"))


SHARDED = "concat('shard-', CAST(event_id % 16 AS VARCHAR(20)), '.tar') AS url, event_id AS position, concat('d/k', CAST(CAST(floor(event_id / 64) AS BIGINT) AS VARCHAR(20)), '.', CAST(CAST(floor(event_id / 16) AS BIGINT) % 4 AS VARCHAR(20)), '.', event_type) AS fname, CAST(user_id AS VARCHAR(20)) AS data"


@query("a06_archive_shards", over("events", SHARDED, "SELECT url, row_number() OVER (PARTITION BY url ORDER BY position) - 1 AS position, fname, data FROM d"), ints="position")
def archive_shards(t):
    """Shards are written, read back in a stream of headers, and hold what went in."""
    folder = records.scratch(t.spark, "shards")
    archives.write_shards(t.derive("events", SHARDED), folder)
    return archives.read_shards(t.spark, folder).withColumn("data", F.decode("data", "UTF-8"))


@query("a06_group_archives", over("events", SHARDED, "SELECT url, regexp_extract(fname, '^[^.]+') AS key, string_agg(regexp_extract(fname, '[.](.*)$', 1) || '=' || data, ',' ORDER BY position) AS members FROM d GROUP BY url, key"))
def group_archives(t):
    folder = records.scratch(t.spark, "shards")
    archives.write_shards(t.derive("events", SHARDED), folder)
    out = media.group_members(archives.read_shards(t.spark, folder))
    text = F.array_join(F.transform(F.map_entries("members"), lambda e: F.concat(e["key"], F.lit("="), F.decode(e["value"], "UTF-8"))), ",")
    return out.select("url", "key", text.alias("members"))


TRIPLE = "doc_id, concat('/x/', CAST(doc_id AS VARCHAR(20)), '.jpg') AS a, concat('/x/', CAST(doc_id AS VARCHAR(20)), '.caption') AS b, concat('/x/', CAST(doc_id AS VARCHAR(20)), '.shortcaption') AS s, text"


@query("a07_image_triplets", "SELECT CAST(doc_id AS VARCHAR) AS base, length(text) AS image_size, CASE WHEN doc_id % 3 = 0 THEN '' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS caption, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'short' END AS short_caption FROM documents WHERE doc_id % 5 > 0", ints="image_size")
def image_triplets(t):
    d = t.derive("documents", TRIPLE)
    file = lambda path, content: F.struct(c(path).alias("path"), content.alias("content"))
    parts = F.array(F.when(c("doc_id") % 5 > 0, file("a", c("text"))), F.when(c("doc_id") % 3 > 0, file("b", c("text"))), F.when(c("doc_id") % 2 > 0, file("s", F.lit("  short "))))
    files = d.select(F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("f")).select("f.path", "f.content")
    return media.triplets(files).select("base", F.length("image").alias("image_size"), "caption", "short_caption")


@query("a08_labelled_folders", "SELECT '/img/' || d.source || '/' || doc_id || '.JPG' AS path, d.source AS label, CASE WHEN n_name IS NULL THEN NULL ELSE 'name of ' || n_name END AS description FROM documents d LEFT JOIN nation ON d.source = 'src' || n_nationkey WHERE doc_id % 4 > 0")
def labelled_folders(t):
    kind = F.when(c("doc_id") % 4 == 0, ".txt").otherwise(".JPG")
    files = t.documents.select(F.concat(F.lit("/img/"), c("source"), F.lit("/"), c("doc_id").cast("string"), kind).alias("path"), c("text").alias("content"))
    lines = t.nation.select(F.concat(F.lit("src"), c("n_nationkey").cast("string"), F.lit(": name of "), c("n_name")).alias("value"))
    return media.labelled_files(files, media.label_lines(lines)).select("path", "label", "description")


@query("a09_read_conversations", "WITH g AS (SELECT conv_id, string_agg(text, '|' ORDER BY turn) AS body FROM conversations GROUP BY conv_id) SELECT 'img' || conv_id AS image, body FROM g WHERE conv_id % 4 > 0")
def read_conversations(t):
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("from"), m["text"].alias("value")))
    rows = t.conversations.groupBy("conv_id").agg(turns.alias("conversations")).select(F.when(c("conv_id") % 4 > 0, F.concat(F.lit("img"), c("conv_id").cast("string"))).alias("image"), "conversations")
    folder = records.scratch(t.spark, "conversations")
    records.write_records(rows, folder, "jsonl")
    read = records.read_conversations(t.spark, folder, "jsonl")
    return read.select("image", F.array_join(F.transform("conversations", lambda m: m["value"]), "|").alias("body"))


@query("a10_read_id_list", "SELECT 'tok' || event_id AS id FROM events")
def read_id_list(t):
    folder = records.scratch(t.spark, "ids")
    t.events.select(F.concat(F.lit("  logs/2024/tok"), c("event_id").cast("string"))).write.text(folder)
    return records.read_id_list(t.spark, folder)


IMAGES = "doc_id AS idx, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id + 1 AS VARCHAR(20)) ELSE concat(text, repeat('x', 65)) END AS image"


@query("a11_resolve_image_reference", over("documents", IMAGES, "SELECT a.idx, CASE WHEN length(a.image) <= 64 THEN coalesce(b.image, a.image) ELSE a.image END AS image FROM d a LEFT JOIN d b ON length(a.image) <= 64 AND CAST(b.idx AS VARCHAR) = a.image AND length(b.image) > 64"))
def resolve_image_reference(t):
    return media.resolve_image_reference(t.derive("documents", IMAGES))


@query("a12_decode_images", "SELECT doc_id AS idx, doc_id || CASE WHEN doc_id % 2 = 0 THEN '_0' ELSE '' END || '.jpg' AS image_path, text FROM documents UNION ALL SELECT doc_id, doc_id || '_1.jpg', 'second' FROM documents WHERE doc_id % 2 = 0")
def decode_images(t):
    one = F.base64(c("text").cast("binary"))
    cells = F.when(c("doc_id") % 2 == 0, F.array(one, F.base64(F.lit("second").cast("binary")))).otherwise(F.array(one))
    df = t.documents.select(c("doc_id").alias("idx"), cells.alias("images"), F.concat(c("doc_id").cast("string"), F.lit(".jpg")).alias("path"))
    return media.decode_images(df, "images", "path").select("idx", "image_path", F.decode("image", "UTF-8").alias("text"))


@query("a12_image_files", "SELECT 'src/' || doc_id || '.jpg' AS name, md5(text) AS md5, strlen(text) AS size FROM documents", ints="size")
def image_files(t):
    folder = records.scratch(t.spark, "images")
    cells = t.documents.select(c("doc_id").alias("idx"), F.array(F.base64(c("text").cast("binary"))).alias("images"), F.concat(F.lit("src/"), c("doc_id").cast("string"), F.lit(".jpg")).alias("path"))
    archives.write_files(media.decode_images(cells, "images", "path"), folder)
    files = archives.read_files(t.spark, folder)
    return files.select(F.regexp_extract("path", r"(src/[^/]+)$", 1).alias("name"), F.md5("content").alias("md5"), F.length("content").alias("size"))


@query("a13_checksum", "SELECT doc_id, md5(text) AS md5, CASE WHEN doc_id % 7 = 0 THEN 'stale' ELSE md5(text) END AS expected, doc_id % 7 > 0 AS matches FROM documents")
def checksum(t):
    expected = t.documents.select("doc_id", F.when(c("doc_id") % 7 == 0, "stale").otherwise(F.md5("text")).alias("expected"))
    return media.checksum(t.documents, "doc_id", "text", expected)


@query("a14_concat_datasets", """WITH u AS (SELECT 0 AS t, 'docs' AS "SUB_DATASET", doc_id AS original_index, lang, NULL AS text FROM documents UNION ALL SELECT 1, 'bench', item_id, NULL, text FROM benchmark)
 SELECT row_number() OVER (ORDER BY t, original_index) - 1 AS idx, "SUB_DATASET", original_index, lang, text FROM u""", ints="idx")
def concat_datasets(t):
    return media.concat_datasets({"docs": t.documents.select(c("doc_id").alias("idx"), "lang"), "bench": t.benchmark.select(c("item_id").alias("idx"), "text")})


@query("a14_split_dataset", "SELECT item_id AS idx, text FROM benchmark")
def split_dataset(t):
    every = media.concat_datasets({"docs": t.documents.select(c("doc_id").alias("idx"), "lang"), "bench": t.benchmark.select(c("item_id").alias("idx"), "text")})
    return media.split_dataset(every, "bench").select("idx", "text")


@query("a15_export_submission", "SELECT o_orderkey AS id, CASE WHEN o_custkey % 4 = 0 THEN 'open ' || o_orderstatus ELSE substr('ABC', CAST(o_custkey % 3 + 1 AS INT), 1) END AS answer FROM orders")
def export_submission(t):
    letter = F.substring(F.lit("ABC"), (c("o_custkey") % 3 + 1).cast("int"), F.lit(1))
    choice = c("o_custkey") % 4 > 0
    df = t.orders.withColumn("prediction", F.when(choice, F.concat(F.lit("It is ("), letter, F.lit(")"))).otherwise(F.concat(F.lit("open "), c("o_orderstatus")))).withColumnRenamed("o_orderkey", "id")
    options = F.create_map(*[F.lit(x) for k in "ABC" for x in (k, f"text {k}{k}")])
    return media.submission(df, "id", "prediction", options, choice)


@query("a16_explode_question_files", """SELECT conv_id * 100 + turn AS idx, 'q' || turn || '?' AS question, 'x' || turn AS A, role AS B, 'y' AS C, 'z' AS D, substr('ABCD', CAST(turn % 4 + 1 AS INT), 1) AS answer, turn % 2 = 0 AS abc_label FROM conversations WHERE conv_id IN (SELECT o_custkey FROM orders)""")
def explode_question_files(t):
    q = F.struct(F.concat(c("conv_id").cast("string"), F.lit(".png-"), c("turn").cast("string")).alias("questionId"), F.array(F.concat(F.lit("x"), c("turn").cast("string")), c("role"), F.lit("y"), F.lit("z")).alias("answerTexts"),
                 (c("turn") % 4).cast("int").alias("correctAnswer"), (c("turn") % 2 == 0).alias("abcLabel"))
    entry = F.struct(F.concat(F.lit("q"), c("turn").cast("string"), F.lit("?")).alias("key"), q.alias("value"))
    files = t.conversations.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(entry)).alias("questions")).select(F.to_json(F.struct(F.concat(c("conv_id").cast("string"), F.lit(".png")).alias("imageName"), "questions")).alias("body"))
    return media.explode_question_files(files, "body", t.orders.select(c("o_custkey").alias("id")).distinct())
