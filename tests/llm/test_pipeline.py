"""The pipeline's stages, each on its predecessor's rows, against what they should have done."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rollscan.llm import mixing, packing, toxicity
from rollscan.llm.common import held_out, stage

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def linked_groups(texts):
    """Component (least number) of each text by comparing all sets that share a shingle."""
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(sets))]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {}
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF), name)
        rows[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    toxic, exact, near, mixed, packed = rows.values()
    every = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(every, spark.read.parquet(f"{SF}/labels.parquet"), held_out(5, 0))
    clean = {r.doc_id for r in toxicity.score_documents(every.select("doc_id", "text"), model).filter("score < 0.5").collect()}
    assert {r.doc_id for r in toxic} == clean and 0 < len(toxic) < every.count()
    last = {}
    for r in toxic:
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert {(r.doc_id, r.text) for r in exact} == {(i, t) for t, i in last.items()}
    ordered = sorted(exact, key=lambda r: r.doc_id)
    assert sorted(r.doc_id for r in near) == sorted({ordered[i].doc_id for i in linked_groups([r.text for r in ordered])})
    assert len(near) < len(exact)
    words = {r.doc_id: len(WORD.findall(r.text)) for r in near}
    took = Counter()
    for r in mixed:
        took[r.doc_id] += len(WORD.findall(r.text))
    assert dict(took) == {r.doc_id: r.taken for r in mixing.taken(spark.createDataFrame(near, every.schema)).collect() if r.taken}
    assert abs(sum(took.values()) / sum(words.values()) - 1) < 0.05
    encoder = Tokenizer.from_file(packing.default_tokenizer())
    tokens = Counter()
    for r in mixed:
        tokens[r.doc_id] += len(encoder.encode(r.text, add_special_tokens=False).ids) + 1
    lengths = Counter()
    for r in packed:
        lengths[r.doc_id] += r.length
    assert lengths == tokens
    assert len({r.sequence_id for r in packed}) < 1.05 * sum(r.length for r in packed) / 1024 + 1


CLASHING = ("block", "w0", "words", "copy", "copies", "parts", "twin", "row", "rid", "key", "found", "score", "toxicity", "rank", "size", "new", "possible", "listed", "sha256", "dropped", "mark", "a.b")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, odd, empty, name):
    step = dict(corpus_pipeline.STAGES)[name]
    df = odd.withColumns({c: F.lit(c) for c in CLASHING})
    got = stage(step(spark, df, SF), "odd")
    rows = got.collect()
    assert step(spark, empty, SF).count() == 0
    if name == "best_fit_packing":
        assert len({(r.doc_id, r.piece) for r in rows}) >= 9 and sum(r.piece == 0 for r in rows) == df.count()
        return
    assert got.columns == df.columns and all(r[c] == c for r in rows for c in CLASHING)
    kept = Counter((r.doc_id, r.text) for r in rows)
    every = Counter((r.doc_id, r.text) for r in df.collect())
    if name == "toxicity":
        assert set(kept) <= set(every) and all(n == every[k] for k, n in kept.items())
    if name == "exact_dedup":
        assert sorted(kept, key=str) == sorted([(2, ""), (3, "  \n\t "), (4, "one"), (6, "the same text of six words"), (None, "the id is not there at all"), *[k for k in every if k[0] in (7, 8)]], key=str)
        assert set(kept.values()) == {1}
    if name == "ngram_jaccard_join":
        assert kept == every - Counter({k: n for k, n in every.items() if k[0] == 6})
    if name == "source_mix":
        assert {k[0] for k in kept} <= {4, 5, 6, 7, 8, None} and all(r.n_chars == len(r.text) for r in rows)


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert set(got.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} and got.count()


def test_repeated_rows_leave_one(spark):
    rows = [(1, "a b", "en", "x", 3)] * 5 + [(1, "a b", "en", "w", 3), (0, "a b", "en", "x", 3), (None, "a b", "en", "x", 3)]
    rows += [(None, "c d", "en", "x", 3)] * 4 + [(2, "e f", "en", "x", 3), (2, "g h", "en", "x", 3)] + [(3, None, "en", "x", 0), (3, "", "en", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    want = {(1, "a b", "w"), (None, "c d", "x"), (2, "e f", "x"), (2, "g h", "x"), (3, None, "x")}
    got = corpus_pipeline.drop_exact_copies(spark, docs, SF).collect()
    assert len(got) == len(want) and {(r.doc_id, r.text, r.source) for r in got} == want
    once = corpus_pipeline.drop_exact_copies(spark, docs.filter("source = 'x'").distinct(), SF).collect()
    assert {(r.doc_id, r.text) for r in once} >= {(1, "a b"), (None, "c d"), (2, "e f"), (2, "g h")}
