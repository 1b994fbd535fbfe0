"""Results against brute force, the public tokenizer, held-out labels and the check statements."""

import collections
import math
import random
import re
import time
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpus_pipeline import STAGES
from scorewright.llm import language_model
from scorewright.llm.html_text import main_text, min_cut
from scorewright.llm.mixing import pivot, targets
from scorewright.llm.near_duplicates import near_duplicates
from scorewright.llm.queries import ORACLE, QUERIES
from scorewright.llm.tables import saved, table
from scorewright.llm.token_counts import Counter

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall())


def test_merging_equals_the_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, tokenizer, rng = Counter(path, entries=50), Tokenizer.from_file(path), random.Random(1)
    letters = list("abcdefgh  '.,12\n\n\t\r") + ["é", "日", "🙂", "　", "\x1c", "\x85", "​", "'s", "<|endoftext|>", "THE "]
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randrange(50)))
        assert counter.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), repr(text)


def test_token_counts_of_the_table(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in QUERIES["op8_token_counts"](spark, SMALL).collect():
        n = len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_language_scores(spark, texts):
    train = collections.Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update([*words(t), "\n"])
    total, distinct = sum(train.values()), len(train)
    out = QUERIES["op9_language_scores"](spark, SMALL).collect()
    assert len(out) == len(texts)
    for r in out:
        tokens = [*words(texts[r.doc_id]), "\n"]
        base = sum(math.log10((train[t] + 1) / (total + distinct + 1)) for t in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(train[t] > 0 for t in tokens), total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("name, label, fold", [("op4_toxicity", "toxic", lambda c: c % 5 == 0), ("op6_quality", "quality", lambda c: c % 3 == 1)])
def test_held_out_accuracy(spark, name, label, fold):
    known = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{MIDDLE}/labels.parquet'").fetchall())
    out = QUERIES[name](spark, MIDDLE).collect()
    assert all(r.held_out == fold(zlib.crc32(str(r.doc_id).encode())) for r in out)
    held = [(r.predicted, known[r.doc_id]) for r in out if r.held_out and r.doc_id in known]
    rate = lambda y: sum(p == y for p, t in held if t == y) / sum(t == y for _, t in held)
    assert rate(0) > 0.85 and rate(1) > 0.7 and sum(p == t for p, t in held) / len(held) > 0.93


def test_nearest_vectors(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{MIDDLE}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = collections.defaultdict(list)
    for r in QUERIES["op2_nearest_vectors"](spark, MIDDLE).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        best = [j for j in np.lexsort((ids, d)) if j != i][:10]
        got = out[ids[i]]
        assert len(got) == 10 and got == sorted(got, key=lambda v: (v[1], v[0]))
        assert all(s == pytest.approx(d[v], abs=1e-12) for v, s in got)
        hits += len({v for v, _ in got} & set(ids[best]))
    assert hits / sum(map(len, out.values())) >= 0.9


def test_near_copies_that_only_a_base_links(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = [(1000, " ".join(base))]
    for i in range(300):
        copy = list(base)
        for _ in range(rng.randrange(1, 4)):
            copy[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    rows += [(2000 + i, " ".join(["common"] * 5 + [f"own{i}_{j}" for j in range(40)])) for i in range(200)]
    sets = {i: {" ".join(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in sets}


def test_targets_and_pivoting():
    assert targets([100, 100, 100]) == [187.5, 75.0, 37.5]
    assert targets([10, 1000, 0]) == [30.0, 980.0, 0.0]
    rng = np.random.default_rng(2)
    size, part = rng.integers(1, 500, 400).astype(float), np.full(400, 0.3)
    sums = []
    for seed in range(40):
        out = pivot(size, part, [seed], False)
        assert ((out == 0) | (out == 1)).sum() >= 399 and (out * size).sum() == pytest.approx((part * size).sum())
        sums.append(pivot(size, part, [seed], True))
    assert abs(np.mean(sums) - 0.3) < 0.03


def test_minimum_cut_against_all_labellings():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randrange(1, 8)
        gains = [rng.uniform(-3, 3) for _ in range(n)]
        edges = {(i, j): rng.uniform(0, 2) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        cost = lambda keep: sum(-g if k else g for g, k in zip(gains, keep) if (g < 0) == k) + sum(c for (i, j), c in edges.items() if keep[i] != keep[j])
        every = [[bool(m >> i & 1) for i in range(n)] for m in range(2**n)]
        assert cost(min_cut(gains, edges)) == pytest.approx(min(map(cost, every)))


def test_pages():
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1><nav><a href=x>Home</a></nav></header><div class="cookie-notice">We use cookies on this site.</div>
    <div id="main"><h1>A headline &amp; more</h1><p>First long paragraph of the story, which goes on for a while and says many things.</p><p>Short.</p><div class="ad">Buy now</div>
    <p>Another paragraph follows here with <a href=z>a link</a> and plenty of further words to read.<script>var a="<p>x</p>"</script></p></div>
    <aside><ul><li><a href=1>Story one</a><li><a href=2>Story two</a></ul></aside><div id="comments"><p>Great article, I really enjoyed reading this, thank you so much.</p></div>
    <form><label>Email</label></form><footer>&copy; 2024 Site</footer></body></html>"""
    assert main_text(page).split("\n") == ["A headline & more", "First long paragraph of the story, which goes on for a while and says many things.", "Short.",
                                           "Another paragraph follows here with a link and plenty of further words to read."]


def test_stages_against_statements(spark, tmp_path):
    """Each stage on what the one before it kept, compared with SQL over the same rows."""
    docs = table(spark, SMALL, "documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SMALL}/benchmark.parquet'")
    sizes = []
    for k, (name, stage) in enumerate(STAGES):
        docs.write.parquet(f"{tmp_path}/{k}")
        con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/{k}/*.parquet'")
        kept = saved(stage(spark, docs, SMALL))
        got = {r.doc_id: r.text for r in kept.collect()}
        if k == 1:
            want = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, text FROM ({ORACLE['op3_line_dedup']}) WHERE n_removed = 0 OR trim(text) <> ''").fetchall()}
        elif k == 2:
            want = dict(con.execute(f"SELECT doc_id, text FROM ({ORACLE['op7_near_duplicates']}) JOIN documents USING (doc_id) WHERE kept").fetchall())
        elif k == 3:
            want = dict(con.execute(f"SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({ORACLE['op1_decontaminate']}))").fetchall())
        else:
            want = {i: t for i, t in con.execute("SELECT doc_id, text FROM documents").fetchall() if i in got}
        assert got == want, name
        sizes.append((docs.count(), len(got)))
        docs = kept
    assert all(a >= b > 0 for a, b in sizes)


def test_language_scores_do_not_depend_on_the_filter_bound(spark, monkeypatch):
    """A filter above the bound is probed by segments: no n-gram is dropped, and scores are those of the broadcast filter."""
    get = lambda: {r.doc_id: (r.n_known, r.base_score, r.score) for r in QUERIES["op9_language_scores"](spark, SMALL).collect()}
    want = get()
    monkeypatch.setattr(language_model, "MAX_FILTER_BITS", 1 << 16)
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 1 << 17)
    got = get()
    assert got.keys() == want.keys()
    for i, (known, base, score) in want.items():
        assert got[i][0] == known and got[i][1:] == pytest.approx((base, score), rel=1e-9)


def test_bigram_weights_come_from_all_training_texts(spark):
    """Every training text counts, as often as it occurs, and a level of the context without observations takes the weight of the nearest."""
    code = lambda context, pair, word: int(language_model._code(context, pair, word))
    rows = [(i, False, 1, [code(5, 5, 2)], [1]) for i in range(100)] + [(100, False, 500, [code(5, 0, 4)], [1]), (101, True, 1, [code(9, 0, 4)], [9])]
    leveled = spark.createDataFrame(rows, "id long, held_out boolean, copies long, codes array<int>, times array<int>")
    levels, share, single = language_model._parts(np.array([r[3][0] for r in rows[:101]]), 1000, 100, without=1)
    times = np.array([r[2] for r in rows[:101]])
    choices = language_model._WEIGHTS
    want = choices[np.argmax([(times * np.log10(w * share + (1 - w) * single)).sum() for w in choices])]
    weights = language_model._tuned(leveled, 1000, 100)
    assert weights[0] == 0 and set(weights[1:]) == {want} and choices[0] < want < choices[-1]


def test_pages_beyond_the_tuned_ones():
    first, second = "First long paragraph of the story, which goes on for a while and says many things.", "Another paragraph follows here with plenty of further words to read."
    story = f"<p>{first}</p><p>{second}</p>"
    both = [first, second]
    for page in (f"<body class='has-comments'><article>{story}</article></body>", f"<body><article id='reply-12'>{story}</article></body>", f"<body class='no-replies comment'><main>{story}</main></body>"):
        assert main_text(page).split("\n") == both
    assert main_text(f"<body><div id=comments><article class=comment>{story}</article></div></body>") == ""
    for name in ("button", "select", "svg", "object", "canvas", "audio", "video"):
        assert main_text(f"<body><article><p>{first}</p><div><{name} class=x>gone</div><p>{second}</p></article></body>").split("\n") == both
        assert main_text(f"<body><article><p>{first}</p><div><{name}><div>gone</div><{name}>gone</{name}>gone</{name}></div><p>{second}</p></article></body>").split("\n") == both
    formula = "<math><semantics><mrow><mi>a</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding='application/x-tex'>a = 2</annotation></semantics></math>"
    assert main_text(f"<article><p>{first} So {formula} holds here.</p></article>") == f"{first} So a=2 holds here."


def test_grams_of_a_block_travel_packed(spark, monkeypatch):
    """One row per block and segment goes to the filter and comes back, whatever the number of distinct grams; repeated rows change nothing."""
    rows = [(i, " ".join(f"w{(i * 37 + k * k) % 4_000}" for k in range(300))) for i in range(60)] + [(60, "again and again " * 40)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    get = lambda: sorted((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in language_model.language_scores(docs).collect())
    want = get()
    monkeypatch.setattr(language_model, "MAX_FILTER_BITS", 1)
    kept = []
    saved = language_model.saved
    monkeypatch.setattr(language_model, "saved", lambda df: kept.append(saved(df)) or kept[-1])
    for size in (1 << 14, 1 << 20):  # with the repeated rows above the size of a block and below
        monkeypatch.setattr(language_model, "BLOCK_BYTES", size)
        kept.clear()
        assert get() == want
        found = [df for df in kept if "levels" in df.columns]
        assert len(found) == 1
        n = found[0].select("block").distinct().count()
        assert n >= 1 and found[0].count() <= n * language_model.LEAST_SEGMENTS


def test_saved_tables_leave_no_shuffle_files(spark, tmp_path):
    """What a saved table was shuffled by is gone when it is written, and the caller's setting is back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    root = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    held = lambda: {p.name for p in root.rglob("shuffle_*.data")}
    old = held()
    out = saved(spark.range(20_000).repartition(4, "id"))
    deadline = time.time() + 20
    while held() - old and time.time() < deadline:
        time.sleep(0.2)
    assert not held() - old and out.count() == 20_000 and spark.conf.get(name) == before
