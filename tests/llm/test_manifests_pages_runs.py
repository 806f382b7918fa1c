"""Merkle manifests, main texts of pages and runs of words against brute force; toxicity scores and language samples of odd ids."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rollscan.llm import htmltext, langid, merkle, mixing, recompression, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- manifests


def leaf_of(r, text):
    parts = (r.doc_id, r.source, r.lang, r.n_chars, text)
    return sha("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def tree(nodes):
    """The root of nodes, and each node's siblings as (before, after), lowest level first."""
    paths, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for k in range(0, len(nodes), 3):
            run = nodes[k : k + 3]
            for j in range(len(run)):
                for i in below[k + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
        below = [sum(below[k : k + 3], []) for k in range(0, len(nodes), 3)]
        nodes = [sha("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]
    return nodes[0], paths


def expected_proofs(rows, change):
    groups = {}
    for r in rows:
        groups.setdefault(r.source, []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text)))
    trees = [tree([leaf_of(r, r.text) for r in groups[s]]) for s in order]
    root, above = tree([t[0] for t in trees])
    out = []
    for s, (subroot, paths), upper in zip(order, trees, above):
        for r, path in zip(groups[s], paths):
            node, steps = leaf_of(r, change(r)), path + upper
            proof = sha("".join(a + b for a, b in steps))
            for a, b in steps:
                node = sha(a + node + b)
            out.append((r.doc_id, leaf_of(r, r.text), subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


def tampered(r):
    return None if r.text is None else r.text.replace("\n", "") if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 else r.text


def changed():
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


@pytest.mark.parametrize("sizes", [[1], [800, 5, 2, 1, 730, 27]])
def test_proofs_are_those_of_plain_trees(spark, docs_of, sizes):
    rows, i = [], 0
    for s, n in enumerate(sizes):
        for _ in range(n):
            rows.append((i * 7 % 1_000_003, f"text\n{i}é", None if s == 1 else f"s{s}"))
            i += 1
    df = docs_of(*rows).repartition(5)
    got = sorted(map(tuple, merkle.proofs(df, changed()).collect()), key=repr)
    assert got == expected_proofs(df.collect(), tampered)
    assert any(not r[-1] for r in got) or len(got) == 1


def test_manifest_of_odd_tables(odd, empty):
    got = sorted(map(tuple, merkle.proofs(odd, changed()).collect()), key=repr)
    assert got == expected_proofs(odd.select("doc_id", "source", "lang", "n_chars", "text").collect(), tampered)
    assert merkle.proofs(empty).count() == 0
    assert merkle.manifest(odd).filter(F.col("leaf") != F.col("now")).count() == 0


def test_repeated_rows_are_leaves_each(docs_of):
    df = docs_of(*[(5, "again", "a")] * 40, (6, "b", "a"))
    rows = merkle.proofs(df).collect()
    assert len(rows) == 41 and all(r.verified for r in rows) and len({r.root for r in rows}) == 1
    assert rows[0].root == expected_proofs(df.collect(), lambda r: r.text)[0][3]


# --- pages


def test_pages_of_the_tables_keep_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        body = re.search("(?s)<article>(.*)</article>", r.html)[1]
        lines = [" ".join(html.unescape(re.sub("<[^>]*>", " ", part)).split()) for part in re.split("</?(?:h1|p)>", body)]
        want[r.page_id] = "\n".join(line for line in lines if line)
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.extract(pages).collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}


WORDS = "lorem ipsum dolor sit amet " * 8
PARTS = {
    "<p>a &lt; b &amp;amp; c<br>d&nbsp;e</p>": "a < b &amp; c d e",
    '<nav><a href="x">menu</a></nav><div id="topAdBanner">buy</div><article><h1>Title</h1><p>One.</p></article><footer>f</footer>': "Title\nOne.",
    f"<div class='menu'><a>x</a></div><div><h2>H</h2><p>{WORDS}</p><p>S.</p></div><div class='sidebar'><p>{WORDS}</p></div>": f"H\n{WORDS.strip()}\nS.",
    f"<a href=1>one</a><p>{WORDS}</p><ul><li><a href=2>two</a><li><a href=3>three</a></ul><ul><li><a href=2>two</a><li><a href=3>three</a></ul>": WORDS.strip(),
    '<article><p>one</p><div class="share">s<div>t</div>u</div><aside>q</aside><p>two</p><section id="comments"><article>c</article></section></article>': "one\ntwo",
    "<form><main>text in a form<input value=x></main></form>": "text in a form",
    '<article><script>if (a < b) { "</p>" }</script><style>p{}</style><!-- <p>no</p> --><p title="a>b">yes</p></article>': "yes",
    "<article>loose <b>bold<p>next</article>after": "loose bold\nnext",
    '<article><p class="lead-heading" hidden>h</p><header>Head</header><p>body</p></article>': "Head\nbody",
    "": "", "plain": "plain", "a<": "a<", "a <3 b": "a <3 b", "<!-- open": "", "<script>x": "", '<p title="a>b</p><p>c</p>': "b\nc", "<article></article>": "", "&#0;&bogus; &copy": "�&bogus; ©",
}


def test_lines_between_surge_and_dive():
    for page, text in PARTS.items():
        assert htmltext.main_text(page) == text, page
    # a short text apart from the long one is dropped, one beside it is kept
    far = f"<p>{WORDS}</p>" + "<nav>n</nav><div class=ad>x</div>" * 2 + "<p>far</p>"
    assert htmltext.main_text(far) == WORDS.strip()
    assert htmltext.main_text(f"<p>{WORDS}</p><nav>n</nav><p>near</p>") == WORDS.strip() + "\nnear"
    assert htmltext.main_text("<nav>n</nav>" * 4 + "<p>all there is</p>") == "all there is"


def test_pages_of_odd_tables(spark):
    schema = "page_id long, url string, html string, text int, n_chars string"
    rows = [(1, None, None, 1, "x"), (2, "u", "", 1, "x"), (None, "u", "<p>id</p>", 1, "x"), (3, "u", "<p>" + "w " * 400_000 + "</p>", 1, "x"), (4, "v", "<p>same</p>", 1, "x"), (4, "v", "<p>same</p>", 1, "x"), (5, "u", "<div class=ad>" * 20_000 + "x", 1, "x"), (6, "u", '<a "' * 50_000 + ">" * 5000, 1, "x")]
    got = htmltext.extract(spark.createDataFrame(rows, schema)).collect()
    assert Counter((r.page_id, r.n_chars) for r in got if r.page_id not in (5, 6)) == Counter({(1, 0): 1, (2, 0): 1, (None, 2): 1, (3, 799_999): 1, (4, 4): 2})
    assert htmltext.extract(spark.createDataFrame([], schema)).count() == 0


# --- runs


def plain_runs(w):
    found = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(6, 4 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in found.items())


def plain_row(doc_id, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *(best + (1000 * best[1] // best[2],) if best else (None,) * 4), sha(listed), sha(kept))


def test_runs_are_those_found_place_by_place():
    rng = random.Random(4)
    for _ in range(150):
        given = []
        for _ in range(rng.randint(1, 5)):
            w = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.choice([0, 1, 5, 6, 7, 30, 120]))]
            for _ in range(rng.randint(0, 3)):
                if len(w) > 8:
                    a, p = rng.randrange(len(w)), rng.randint(1, 9)
                    for i in range(a, min(len(w), a + rng.randint(4, 60))):
                        w[i] = w[a + (i - a) % p]
            given.append(" ".join(w))
        codes, counts, _ = recompression.words_of(pa.array(given))
        for text, runs in zip(given, recompression.runs_by_text(codes, counts)):
            assert [tuple(r) for r in runs.tolist()] == plain_runs(text.split()), text


def test_extensions_are_those_of_direct_comparison():
    rng = np.random.default_rng(3)
    for _ in range(30):
        s = np.concatenate(([50], rng.integers(0, 2, 80) if rng.random() < 0.5 else np.tile(rng.integers(0, 3, 5), 16), [51])).astype(np.int32)
        levels = recompression.grammar(s)
        x, y = np.array([(i, j) for i in range(len(s)) for j in range(i + 1, len(s))]).T

        def same(i, j):
            k = 0
            while j + k < len(s) and s[i + k] == s[j + k]:
                k += 1
            return k

        assert recompression.extension(levels, x, y).tolist() == [same(i, j) for i, j in zip(x, y)]
        # sizes of symbols add up on every level, and equal symbols hold equal words
        assert all(level.words.sum() == len(s) for level in levels) and len(levels[-1].symbols) == 1


def test_rows_of_runs_on_odd_tables(docs_of, odd, empty):
    rng = random.Random(9)
    more = [(i, " ".join(rng.choice(["x", "y", "É ", "z\v"]) for _ in range(rng.randint(0, 40))), "s") for i in range(120)]
    for df in (odd, docs_of(*more, (None, "a b " * 9, "s"), (3, "a\tb\r\na  b " * 5, "s"))):
        want = Counter(plain_row(r.doc_id, r.text) for r in df.collect())
        assert Counter(map(tuple, recompression.document_runs(df, plant=True).collect())) == want
    assert recompression.document_runs(empty).count() == 0


# --- mixing, toxicity and language


def test_blocks_are_permuted_anew_for_each_source_and_pass(spark):
    sizes = [1, 2, 3, 5, 64, 1000, 4095, 5000]
    rows = [(r, n, s) for r, n in enumerate(sizes) for s in range(2 * n)]
    df = spark.createDataFrame(rows, "rank long, blocks long, slot long").withColumn("block", mixing.permuted(1))
    by = {}
    for r in df.orderBy("rank", "slot").collect():
        by.setdefault((r["rank"], r.slot // r.blocks), []).append(r.block)
    for (r, _), blocks in by.items():
        assert sorted(blocks) == list(range(sizes[r]))
    big, again = np.array(by[7, 0]), np.array(by[7, 1])
    # neither a step nor a shift leads from slot to block, or from pass to pass
    assert max(Counter((np.diff(big) % 5000).tolist()).values()) < 12 and max(Counter(((again - big) % 5000).tolist()).values()) < 12
    assert abs(np.corrcoef(np.arange(5000), big)[0, 1]) < 0.06


def test_tokens_that_cannot_have_strength_are_left_out_alone():
    chars = toxicity.smoothed(toxicity.trigram_counts(["you are an idiot and a moron, stupid fools say such silly ass things"] * 50).astype(float))
    counts = {"stupid$": (50, 1), "idiot$": (50, 1), "ass$": (50, 1), "fool": (50, 1), "moron$": (50, 1)}
    worth = toxicity.Worth(toxicity.Model(chars, counts, (60, 600), np.zeros(7), np.zeros(6), np.ones(6)))
    rng, tokens = random.Random(8), ["stupid", "stuupid", "s7upid", "(stupid!!", "aass", "ass", "@$$", "fooools", "foolish", "iidiot", "1diot", "mmmoron"]
    tokens += ["".join(rng.choice("stupidomrnafl1@$.!") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    assert all(worth.possible(t) or not worth(toxicity.restored(t, chars)) for t in tokens)
    assert all(worth(toxicity.restored(t, chars)) for t in ("stuupid", "s7upid", "fooools", "mmmoron")) and not worth.possible("river")


def test_scores_are_those_of_the_features_learned(spark):
    """Every distinct restored word counts once, however often and in whatever spelling it stands."""
    rng = random.Random(5)
    plain = ["people", "table", "river", "green", "walking", "sometimes", "water", "paper", "morning", "letter"]
    bad = ["stupid", "idiot", "moron"]
    rows = [(i, " ".join(rng.choices(plain, k=rng.randint(1, 30)) + rng.choices(bad if i % 4 == 0 else plain, k=3)), "en", "s", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels, F.lit(False))
    given = ["stupid stup1d s7upid stupiid st*pid people table", "stupid people table", "the i d i o t there", "idiot the there", "1d10t i d i o t idiot id io t", "Stupid, STUPID! $tupid!!! water", "people people table", "", None, "m o r o n moron m0r0n"]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score_documents(df, model).collect()}
    weight = {f: toxicity.strength(p, q, model.sizes) for f, (p, q) in model.counts.items()}
    assert {"stupid$", "idiot$", "moron$"} <= set(weight)
    for i, text in enumerate(given):
        text = (text or "").lower()
        words = {toxicity.restored(t, model.chars) for t in text.split()}
        for m in toxicity._SPACED.finditer(text):
            words.update(toxicity.decode(" ".join(m[0].split()), model.chars, True).split())
        hits = [max([weight[f] for f in toxicity.features(w) if f in weight], default=0.0) for w in words]
        hits = [h for h in hits if h > 0]
        if i in (0, 1, 5):
            assert len(hits) == 1
        if i in (2, 3, 4):
            assert len(hits) == 1 and hits[0] == weight["idiot$"]
        n, total = len(text.split()), sum(hits)
        x = [np.log1p(total), max(hits, default=0.0), np.log1p(len(hits)), min(1.0, 20 * len(hits) / max(1, n)), np.log1p(total) * np.log1p(n), np.log1p(n)]
        z = model.weights[0] + ((np.array(x) - model.centre) / model.spread) @ model.weights[1:]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-12)
    assert got[0] > got[6] and got[1] > got[6]


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7, lambda i: i % 2, lambda i: i])
def test_languages_are_learned_whatever_the_ids(docs_of, ids):
    rng = random.Random(6)
    rows = [(ids(i), " ".join(rng.choices(["der", "die", "und", "nicht", "auch"] if i % 2 else ["the", "and", "of", "not", "that"], k=14)), "de" if i % 2 else "en") for i in range(400)]
    df = docs_of(*rows).withColumn("lang", F.col("source"))
    sizes = {r.lang: r["count"] for r in langid.sampled(df.select("doc_id", "lang", "text"), 20).groupBy("lang").count().collect()}
    assert sizes == {"de": 20, "en": 20}
    model = langid.fit(df, F.lit(True), per_lang=20)
    got = Counter(r.lang_pred for r in langid.predict(df, model).collect())
    assert model.langs == ["de", "en"] and got == {"de": 200, "en": 200}


def test_a_language_of_one_repeated_row_is_learned(docs_of):
    df = docs_of(*[(1, "der die und nicht auch", "de")] * 300, *[(i, f"the and of not that {i}", "en") for i in range(300)]).withColumn("lang", F.col("source"))
    model = langid.fit(df, F.lit(True), per_lang=20)
    assert model.langs == ["de", "en"]
