"""Each corpus operator against a brute-force version, an exact round trip or held-out labels, and on odd and empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rollscan.llm import bloom, exactdedup, fingerprint, langid, mixing, ngramjoin, packing, quality, toxicity, urlfilter, warc
from rollscan.llm.common import cut_keys, held_out
from rollscan.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


# --- mixing


def test_mix_meets_targets_and_caps(spark):
    rows = mixing.taken(documents(spark)).collect()
    by = defaultdict(list)
    for r in rows:
        assert r.size == len(WORD.findall(texts(spark)[r.doc_id] or ""))
        assert 0 <= r.taken <= 3 * r.size
        by[r.source].append(r)
    assert sum({s: g[0].target for s, g in by.items()}.values()) == pytest.approx(sum(r.size for r in rows))
    for g in by.values():
        assert sum(r.size for r in g) == g[0].source_size
        assert sum(r.taken for r in g) == pytest.approx(g[0].target, abs=max(130, 0.02 * g[0].target))
    again = {(r.doc_id, r.taken) for r in mixing.taken(documents(spark).repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


_texts = {}


def texts(spark):
    if not _texts:
        _texts.update((r.doc_id, r.text) for r in documents(spark).collect())
    return _texts


def test_mix_shards_and_documents(spark):
    docs = documents(spark)
    placed, pieces, slots = mixing.mix(mixing.measured(docs, F.monotonically_increasing_id()), shard_slots=200)
    s = slots.toPandas()
    assert s.groupby(["rank", "block"]).takes.sum().max() <= 3
    # each source has the slots of its target, and its blocks are taken as often as each other or once more
    words = placed.groupBy("rank").agg(F.sum("size").alias("n"), F.max("target").alias("target")).collect()
    for r in words:
        blocks = -(-r.n // 64)
        mine = s[s["rank"] == r["rank"]]
        assert mine.takes.sum() == min(3 * blocks, int(r.target * blocks / r.n + 0.5))
        each = mine.groupby("block").takes.sum()
        assert each.max() - (each.min() if len(each) == blocks else 0) <= 1
    # shards draw their counts: they vary as multinomial ones do, and add up
    counts = s.pivot_table(index="shard", columns="rank", values="takes", aggfunc="sum", fill_value=0)
    share = counts.sum() / counts.to_numpy().sum()
    assert len(counts) == -(-int(s.takes.sum()) // 200)
    expected = counts.sum() / len(counts)
    chi = ((counts - expected) ** 2 / expected).to_numpy().sum()
    freedom = (len(counts) - 1) * len(share)
    assert 0.5 * freedom < chi < 2 * freedom
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        assert r.n_chars == len(r.text)
        words[r.doc_id] += len(WORD.findall(r.text))
    rows = mixing.taken(docs).collect()
    assert dict(words) == {r.doc_id: r.taken for r in rows if r.taken}
    assert all((r.shards > 0) == (r.taken > 0) for r in rows)


def test_mixed_texts_are_the_words_taken(docs_of):
    df = docs_of(*[(i, "  ".join(f"{i}w{k}" for k in range(20 + 31 * i)) + " \n", "ab"[i % 2]) for i in range(12)])
    placed, pieces, slots = mixing.mix(mixing.measured(df, F.col("doc_id")))
    times = {(r["rank"], r.block): r.n for r in slots.groupBy("rank", "block").agg(F.sum("takes").alias("n")).collect()}
    want = Counter()
    texts_of = {r.doc_id: r.text for r in df.collect()}
    parts = defaultdict(list)
    for r in pieces.collect():
        parts[r.rid].append((r.lo, r.hi, times.get((r["rank"], r.block), 0)))
    for i, held in parts.items():
        cut = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", texts_of[i])
        for k in (1, 2, 3):
            some = [w for lo, hi, n in sorted(held) if n >= k for w in cut[lo:hi]]
            if some:
                want[i, texts_of[i] if len(some) == len(cut) else "".join(some)] += 1
    assert Counter((r.doc_id, r.text) for r in mixing.mixed_documents(df).collect()) == want


def test_mix_of_odd_tables(odd, empty):
    rows = mixing.taken(odd).collect()
    assert len(rows) == odd.count() and all(r.taken <= 3 * r.size for r in rows)
    assert {r.size for r in rows if r.doc_id in (1, 2, 3)} == {0}
    mixing.mixed_documents(odd).collect()
    assert mixing.taken(empty).count() == mixing.mixed_documents(empty).count() == 0


def test_mixed_documents_of_shared_and_missing_ids(docs_of):
    blank = [None, "", " \n"]
    worded = lambda i, j: " ".join(f"{i}w{j}x{k}" for k in range(10 + 37 * j))
    rows = [(i, blank[j // 2] if j < 6 else worded(i, j), "ab"[j % 2]) for i in (None, 4, 9) for j in range(12)]
    df = docs_of(*rows).repartition(3)
    want, got = Counter(), Counter()
    for r in mixing.taken(df).collect():
        if r.taken:
            want[r.doc_id, r.source] += r.taken
    have = defaultdict(set)
    for i, t, s in rows:
        have[i, s].add(t)
    for r in mixing.mixed_documents(df).collect():
        got[r.doc_id, r.source] += len(WORD.findall(r.text))
        assert any(set(WORD.findall(r.text)) <= set(WORD.findall(t or "")) for t in have[r.doc_id, r.source])
    assert got == want and len(want) >= 4


def test_missing_ids_keep_their_own_plan(docs_of):
    rows = [(None, "", "a"), (None, " ".join(f"s{k}" for k in range(10)), "a"), (None, " ".join(f"l{k}" for k in range(100)), "a")]
    df = docs_of(*rows)
    taken = Counter({r["size"]: r.taken for r in mixing.taken(df).collect() if r.taken})
    got = Counter()
    for r in mixing.mixed_documents(df).collect():
        got[10 if r.text.strip().startswith("s") else 100] += len(WORD.findall(r.text))
    assert got == taken and set(got) == {10, 100}


# --- url filter


def test_url_verdicts(spark):
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/de/", "block"), ("com", "/de/", "allow")], "host string, path string, action string")
    urls = {"http://A.Example.ORG/es/x?q": ("org/", "x"), "https://example.org/es/": ("example.org/es/", "block"), "http://x.org/a": ("org/", "allow"), "http://notexample.org/es/1": ("org/", "allow"), "http://x.com/de/": ("com/de/", "block"), "http://x.org": (None, "allow"), "x.org/a": (None, "allow"), None: (None, "allow"), "ftp://org/": ("org/", "allow"), "http://a.org?/": (None, "allow")}
    urls["http://A.Example.ORG/es/x?q"] = ("example.org/es/", "block")
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.url: (r.rule, r.verdict) for r in urlfilter.url_verdicts(df.unionByName(df), rules).collect()}
    assert got == urls
    assert urlfilter.url_verdicts(df.unionByName(df), rules).count() == 2 * len(urls)
    long = spark.createDataFrame([(1, "http://x.org/" + "a/" * 200_000, "r"), (2, "http://" + "a." * 50_000 + "org/x", "r"), (3, "://" + "y" * 300_000, "r")], df.schema)
    assert {(r.page_id, r.rule, r.verdict) for r in urlfilter.url_verdicts(long, rules).collect()} == {(1, "org/", "allow"), (2, "org/", "allow"), (3, None, "allow")}
    assert {r.verdict for r in urlfilter.url_verdicts(df, rules.limit(0), default="block").collect()} == {"block"}
    assert urlfilter.url_verdicts(df.limit(0), rules).count() == 0


def test_filters_too_large_to_broadcast_give_the_same(spark, docs_of, monkeypatch):
    df = docs_of(*[(i, f"t{i}", "s") for i in range(300)]).withColumns({c: F.lit(c) for c in ("block", "w0", "row", "key", "found", "possible", "listed")})
    listed = spark.createDataFrame([(f"t{i}", i) for i in range(0, 300, 7)], "name string, at long")
    want = {f"t{i}" for i in range(0, 300, 7)}
    for limit in (bloom.BROADCAST_BLOCKS, 0):
        monkeypatch.setattr(bloom, "BROADCAST_BLOCKS", limit)
        for keep in (True, False):
            got = bloom.semi(df, F.col("text"), listed, "name", keep)
            assert got.columns == df.columns and {r.text for r in got.collect()} == (want if keep else {f"t{i}" for i in range(300)} - want)
        found = {r.row.text: r.found and r.found.at for r in bloom.marked(df, F.col("text"), listed, "name").collect()}
        assert found == {f"t{i}": i if i % 7 == 0 else None for i in range(300)}
        passed = {r.key for r in bloom.probe(df, F.col("text"), bloom.build(listed, "name", 43)).filter("possible").collect()}
        assert want <= passed and len(passed) < 60
    assert bloom.blocks_for(10**9) == 62_500_000


# --- toxicity


def test_obfuscated_words_are_restored():
    counts = toxicity.trigram_counts(["you are an idiot and a moron, stupid people say such worthless things to the idiot moron"] * 200)
    model = toxicity.smoothed(counts.astype(float))
    for token, word in {"1d10t": "idiot", "m0r0n": "moron", "i.d.i.o.t": "idiot", "idiiiiot": "idiot", "st*pid": "stupid", "$tupid!!!": "stupid", "idiot###": "idiot", "people": "people"}.items():
        assert toxicity.restored(token, model) == word
    assert "idiot" in toxicity.words_of("you i d i o t there", model, {})[0]


def test_words_without_letters_doubled_or_in_chunks_are_restored():
    counts = toxicity.trigram_counts(["you are an idiot and a moron, stupid people say such silly ass things to the idiot moron"] * 200)
    model = toxicity.smoothed(counts.astype(float))
    for token, word in {"@$$": "ass", "455": "ass", "iddiot": "idiot", "stuupid": "stupid", "silly": "silly", "---": ""}.items():
        assert toxicity.restored(token, model) == word
    for text in ("you id io t there", "say a s s you", "the i  d  i  o  t there", "the i\nd\ni\no\nt there", "the i\u00a0d\u00a0i\u00a0o\u00a0t there"):
        assert {"idiot", "ass"} & toxicity.words_of(text, model, {})[0], text
    assert not {"idiot", "ass"} & toxicity.words_of("you are to an so be it", model, {})[0]


def test_decoding_finds_the_likeliest_of_all_readings():
    counts = toxicity.trigram_counts(["the idiot said a moron stole the silly boat, see all of it to bits"] * 50)
    model = toxicity.smoothed(counts.astype(float))

    def worth(path):
        total, symbols = -sum(cost for _, cost in path), [0, 0]
        for ch in "".join(text for text, _ in path):
            s = 0 if ch == " " else toxicity.INDEX.get(ch, toxicity.OTHER)
            if s or symbols[-1]:
                total += float(model[symbols[-2] if symbols[-1] else 0, symbols[-1], s])
            symbols = [*symbols, s] if s else [0, 0]
        return total + (float(model[symbols[-2], symbols[-1], 0]) if symbols[-1] else 0.0)

    for token, spaced in [("1d10t", False), ("m0r0n", False), ("s1lly", False), ("iddi0t", False), ("b@@t", False), ("$!lly", False), ("st*le", False), ("i d 1 o t", True), ("a s i t", True), ("455", False)]:
        paths = list(itertools.product(*toxicity.lattice(token, spaced)))
        best = max(map(worth, paths))
        found = toxicity.decode(token, model, spaced)
        assert any("".join(t for t, _ in p) == found and worth(p) == pytest.approx(best, abs=1e-6) for p in paths), token


def test_trigram_counts_and_strengths_are_plain_ones():
    text = ["Ab, cé! ab", "", "x"]
    want = Counter()
    for t in text:
        before = [0, 0]
        for ch in f"{t}\n".lower():
            s = toxicity.INDEX.get(ch, toxicity.OTHER if ch.isalpha() else 0)
            if s or before[1]:
                want[(before[0] if before[1] else 0) << 12 | before[1] << 6 | s] += 1
            before = [before[1], s]
    got = toxicity.trigram_counts(text)
    assert {i: int(got[i]) for i in np.flatnonzero(got)} == want
    # the evidence is the G statistic of the 2 x 2 table
    pos, neg, n1, n0 = 30, 2, 50, 60
    table, total = np.array([[pos, neg], [n1 - pos, n0 - neg]], float), n1 + n0
    g = 2 * (table * np.log(table * total / np.outer(table.sum(1), table.sum(0)))).sum()
    assert g > 16 and toxicity.strength(pos, neg, (n1, n0)) == pytest.approx(np.log(30.5 / 51) - np.log(2.5 / 61))
    assert toxicity.strength(3, 2, (n1, n0)) == 0


def test_toxicity_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(docs, labels, held_out(5, 0))
    rows = toxicity.score_documents(docs.select("doc_id", "text", held_out(5, 0).alias("h")), model).join(labels, "doc_id").filter("h").collect()
    assert np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in rows]) > 0.9


def test_toxicity_of_odd_tables(odd, empty, spark):
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, labels, F.lit(False))
    rows = toxicity.score_documents(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    none = toxicity.fit(empty, labels.limit(0), F.lit(False))
    assert toxicity.score_documents(empty, none).count() == 0


# --- quality


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_documents(docs, labels, held_out(3, 1)).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_statistics_are_those_of_plain_loops():
    rng = random.Random(5)
    given = ["", "  \n", None, "One word", "a a a b", "Ünïcode straße, 12% | $5 (it's) !!\n" + "the same long line of words here\n" * 3 + "x"]
    given += ["".join(rng.choice("abAB 12.!|$\n é") for _ in range(rng.randrange(400))) for _ in range(30)]
    got = quality.statistics(pa.array(given, pa.large_string()))
    for row, text in zip(got, given):
        data = (text or "").encode()
        words = [w.encode() for w in WORD.findall((text or "").translate(LOWER))]
        n, lines = len(words), data.count(b"\n") + 1
        letters = max(1, sum(b not in b" \t\n\v\f\r" for b in data))
        share = lambda chars: sum(b in chars for b in data) / letters  # noqa: B023, E731
        rows = [r for r in data.split(b"\n") if len(r) > 20]
        want = {
            "n_words": np.log1p(n), "word_len": letters / max(1, n), "upper": share(bytes(range(65, 91))), "digit": share(b"0123456789"),
            "symbol": share(b"#$%&*+/<=>@\\^_`~{}[]"), "pipe": share(b"|"), "punct": share(b".,;:?\"'()-"), "wide": share(bytes(range(128, 256))),
            "repeat_next": sum(a == b for a, b in zip(words, words[1:])) / (n - 1) if n > 1 else 0, "distinct": len(set(words)) / n if n else 0,
            "top_word": max(Counter(words).values()) / n if n else 0, "line_words": np.log1p(n / lines),
            "lines_repeat": 1 - len(set(rows)) / len(rows) if n and rows else 0, "bangs": share(b"!"),
        }
        assert dict(zip(quality.STATS, row)) == pytest.approx(want)


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(3)
    z, w = (rng.random((300, 12)) < 0.4).astype(float), np.ones(300)
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * z[:, 0] - 2 * z[:, 1] - 0.3)))).astype(float)
    penalty = 0.01
    bias, b = quality.lasso(z, y, w, penalty, rounds=5000)
    slope = z.T @ (1 / (1 + np.exp(-(bias + z @ b))) - y) / 300
    assert 2 <= (b != 0).sum() < 12
    assert slope[b != 0] == pytest.approx(-penalty * np.sign(b[b != 0]), abs=1e-5) and (np.abs(slope[b == 0]) <= penalty + 1e-5).all()


def test_rules_compile_to_the_same_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, len(quality.STATS)))
    y = ((x[:, 2] > 0.5) & (x[:, 9] <= 0.7)).astype(float)
    rules = quality.fit(x, y)
    assert 0 < len(rules.rules) < 200
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in quality.STATS))
    got = np.array([r[0] for r in df.select(rules.column()).collect()])
    total = np.full(len(x), rules.bias)
    for tests, weight in rules.rules:
        total += weight * np.all([(x[:, quality.STATS.index(n)] <= b) if most else (x[:, quality.STATS.index(n)] > b) for n, most, b in tests], axis=0)
    assert got == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((got >= 0.5) == (y == 1)).mean() > 0.95


def test_quality_of_odd_tables(odd, empty, spark):
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score_documents(odd, labels, held_out(3, 1)).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.score_documents(odd, labels.limit(0), held_out(3, 1)).collect()} == {0.5}
    assert quality.score_documents(empty, labels, held_out(3, 1)).count() == 0


# --- WARC


def test_archives_round_trip(spark, tmp_path):
    big, small = "é" * 80, "tiny"
    rows = [(5, "http://a b/", big), (2, None, big), (9, "u", big), (3, "u", small), (4, "u", small), (None, "u", big), (7, "u", None), (7, "u", None), (-(2**62), "u", "x" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("shard", F.lit(1))
    got = sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages, shard_bytes=2000, roll_bytes=300).collect())
    assert got == [(False, -(2**62), 5000, "response", None), (False, 2, 160, "response", None), (False, 3, 4, "response", None), (False, 4, 4, "response", None), (False, 5, 160, "revisit", 2), (False, 7, 0, "response", None), (False, 7, 0, "response", None), (False, 9, 160, "revisit", 2), (True, 0, 160, "revisit", 2)]
    files = lambda sub, df: {r.file.rsplit("/", 1)[1]: r.sha256 for r in warc.write_archives(df, f"file://{tmp_path}/{sub}", 2000, 300).collect()}
    one = files("a", pages)
    assert len(one) > 2 and one == files("b", pages.repartition(5))
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == sorted(one)
    assert warc.round_trip(pages.limit(0)).count() == 0
    # a page_id that fills several shards, and very long payloads
    same = spark.createDataFrame([(1 if i % 2 else None, "u", f"{i:04d}" * 200) for i in range(60)] + [(9, "u", "z" * 3_000_000)], "page_id long, url string, html string")
    manifest = warc.write_archives(same, f"file://{tmp_path}/c", 4000, 2000)
    assert manifest.select("shard").distinct().count() > 12
    assert warc.round_trip(same, shard_bytes=4000, roll_bytes=2000).filter("record_type = 'response'").count() == 61


def test_damaged_archives_are_refused(spark, tmp_path):
    root = f"file://{tmp_path}/w"
    manifest = warc.write_archives(spark.createDataFrame([(1, "u", "x" * 200)], "page_id long, url string, html string"), root)
    path = manifest.first().file
    data = bytearray(open(path, "rb").read())
    data[40] ^= 1
    open(path, "wb").write(bytes(data))
    with pytest.raises(Exception, match="not the file"):
        warc.read_archives(manifest, root).collect()


# --- fingerprints


def test_fingerprints_estimate_similarity(spark):
    rows = fingerprint.fingerprint_documents(documents(spark)).collect()
    t, ids = texts(spark), sorted(texts(spark), reverse=True)
    follows = dict(zip(ids, ids[1:] + ids[:1]))
    errors, prints = [], {}
    for r in rows:
        text, after = t[r.doc_id] or "", t[follows[r.doc_id]] or ""
        new = fingerprint.edited(text, after)
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        for near, other in ((r.near_edited, new), (r.near_next, after)):
            a, b = shingles(text), shingles(other)
            errors.append(near - (len(a & b) / len(a | b) if a | b else 1))
    assert len(rows) == len(t) and np.abs(errors).mean() < 0.03 and abs(np.mean(errors)) < 0.01


@pytest.mark.parametrize("ids", ["apart", "shared", "missing"])
def test_fingerprints_meet_the_next_across_ranges(docs_of, ids):
    name = {"apart": lambda i: 7 * i - 500, "shared": lambda i: i // 40, "missing": lambda i: None if i % 3 else i}[ids]
    df = docs_of(*[(name(i), f"{i % 90} " * (3 + i % 11), "s") for i in range(150)]).repartition(4)
    rows = [(r.doc_id, r.text, r.mark) for r in df.select("doc_id", "text", F.xxhash64("text").alias("mark")).collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    want = Counter()
    for (i, t, _), (_, after, _) in zip(rows, rows[1:] + rows[:1]):
        want[i, len(t), hashlib.sha256(fingerprint.edited(t, after).encode()).hexdigest()] += 1
    for size in (200, 1 << 20):
        got = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprint.fingerprint_documents(df, size).collect())
        assert got == want


def test_cuts_split_tables_evenly(spark):
    rng = np.random.default_rng(6)
    rows = [(None if i % 4 == 0 else int(rng.integers(-5, 5)) if i % 2 else int(rng.integers(-(2**60), 2**60)), int(rng.integers(-(2**62), 2**62)), int(rng.integers(1, 50))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, mark long, size long")
    cuts = cut_keys(df, F.col("id"), F.col("mark"), F.col("size"), 1500)
    again = cut_keys(df.repartition(7), F.col("id"), F.col("mark"), F.col("size"), 1500)
    assert len(cuts) == (sum(r[2] for r in rows) - 1) // 1500 and (cuts.ids == again.ids).all() and (cuts.marks == again.marks).all()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    edges = sorted((i >= len(cuts) - cuts.missing, int(a), int(b)) for i, (a, b) in enumerate(zip(cuts.ids, cuts.marks)))
    held = Counter()
    for r in df.withColumn("part", cuts.column(F.col("id"), F.col("mark"))).collect():
        assert r.part == sum(e <= key((r.id, r.mark)) for e in edges)
        held[r.part] += r["size"]
    assert len(held) == len(cuts) + 1 and max(held.values()) < 1600


def test_fingerprints_of_odd_tables(odd, empty, docs_of):
    rows = fingerprint.fingerprint_documents(odd).collect()
    assert len(rows) == odd.count()
    assert {r.fingerprint for r in rows if r.doc_id in (1, 2, 3)} == {""}
    assert fingerprint.fingerprint_documents(empty).count() == 0
    alone = fingerprint.fingerprint_documents(docs_of("a b c d e f g h")).first()
    assert alone.near_next == 1


# --- exact dedup


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(spark, keep):
    rng = random.Random(1)
    rows = [(i, f"text {rng.randrange(40)}" if i % 3 else "hot", "s") for i in rng.sample(range(10_000), 600)]
    df = spark.createDataFrame([(i, x, "en", s, 0) for i, x, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(9)
    groups = defaultdict(list)
    for i, x, _ in rows:
        groups[x].append(i)
    pick = max if keep == "largest" else min
    want = {(i, pick(groups[x]), len(groups[x]), i == pick(groups[x]), hashlib.sha256(x.encode()).hexdigest()) for i, x, _ in rows}
    assert {tuple(r) for r in exactdedup.exact_dedup(df, keep).collect()} == want


def test_exact_dedup_of_odd_tables(odd, empty):
    rows = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exactdedup.exact_dedup(odd).collect()}
    assert {(1, 2, 2, False), (2, 2, 2, True), (5, 6, 3, False), (6, 6, 3, True), (3, 3, 1, True), (None, None, 1, True)} <= rows
    assert exactdedup.exact_dedup(empty).count() == 0


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup_over_many_batches(spark, docs_of, keep):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = docs_of(*[(None if i % 5 == 0 else i, f"t{i % 13}" if i % 2 else "hot", "s") for i in range(400)]).repartition(3)
        rows = exactdedup.exact_dedup(df, keep).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pick = max if keep == "largest" else min
    text = lambda i: f"t{i % 13}" if i % 2 else "hot"
    named = defaultdict(list)
    for i in range(400):
        if i % 5:
            named[text(i)].append(i)
    sizes = Counter(text(i) for i in range(400))
    digest = {hashlib.sha256(t.encode()).hexdigest(): t for t in sizes}
    assert len(rows) == 400
    for r in rows:
        t = digest[r.text_sha256]
        assert (r.keep_id, r.group_size) == (pick(named[t]), sizes[t]) and r.kept == (r.doc_id == r.keep_id)


def test_runs_are_exchanged_by_bits_of_the_place(spark, docs_of):
    df = docs_of(*[(i % 50 if i % 7 else None, f"text {i % 90}", "s") for i in range(900)]).repartition(11)
    rows = exactdedup.digests(df)
    assert exactdedup.rounds_of(32, 2) == [(0, 2), (2, 2), (4, 1)] and exactdedup.places_for(9) == 16
    place_of = lambda d: int.from_bytes(d[:4], "big") >> 27
    one = F.lit(1).cast("long")
    runs = rows.select(F.pmod(F.spark_partition_id(), F.lit(32)).alias("place"), *exactdedup.KEY, F.col("doc_id").alias("keep_id"), one.alias("n"), one.alias("ties"))
    moved = []
    for r, bits in enumerate([*exactdedup.rounds_of(32, 2), None]):
        runs = (runs.repartitionById(32, "place") if r else runs).sortWithinPartitions(*exactdedup.KEY).mapInArrow(exactdedup.merging(32, bits, True), exactdedup.RUN)
        held = runs.select("place", "digest", "n", F.spark_partition_id().alias("at")).collect()
        assert sum(h.n for h in held) == 900
        settled = 5 if bits is None else bits[0] + bits[1]
        assert all(h.place >> (5 - settled) == place_of(h.digest) >> (5 - settled) for h in held)
        if r:  # a run never leaves the places that differ in the bits settled so far, and holds a text once
            assert len({(h.at, h.digest) for h in held}) == len(held)
        moved.append(len(held))
    assert moved == sorted(moved, reverse=True) and moved[-1] == 90
    got = {(r.keep_id, r.group_size, r.ties) for r in exactdedup.merge_runs(rows, places=32).collect()}
    want = set()
    for k in range(90):
        ids = [i % 50 if i % 7 else None for i in range(900) if i % 90 == k]
        best = max((i for i in ids if i is not None), default=None)
        want.add((best, 10, ids.count(best)))
    assert got == want


# --- n-gram Jaccard join


def components(sets):
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            n = len(x & y)
            if n and 100 * n >= 75 * (len(x) + len(y) - n):
                u, w = root(ids[a]), root(ids[b])
                up[max(u, w)] = min(u, w)
    return {i: root(i) for i in ids}


def near_copies(n, seed):
    """A family of edits of one text, chains of edits, and texts that share a passage."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.sample(words, 60)
    base = rng.choices(words, k=200)
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.4:
            t = list(base)
            for _ in range(rng.randrange(0, 8)):
                t[rng.randrange(len(t))] = rng.choice(words)
        elif kind < 0.7 and out:
            t = out[-1].split()
            t = t[rng.randrange(0, 20) :] + rng.choices(words, k=rng.randrange(0, 20))
        else:
            t = rng.choices(words, k=rng.randrange(3, 90)) + passage
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("tree", [1024, 8])
def test_join_finds_every_link(docs_of, monkeypatch, tree):
    monkeypatch.setattr(ngramjoin, "TREE", tree)
    t = near_copies(260, tree)
    sets = {i: shingles(x) for i, x in enumerate(t)}
    want = components(sets)
    assert len(set(want.values())) < len(want) - 50
    rows = ngramjoin.near_duplicates(docs_of(*t)).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert {r.doc_id: r.n_shingles for r in rows} == {i: len(s) for i, s in sets.items()}


def test_join_on_the_given_documents(spark):
    want = components({i: shingles(x) for i, x in texts(spark).items()})
    assert {r.doc_id: r.component_id for r in ngramjoin.near_duplicates(documents(spark)).collect()} == want


def test_tree_bound_loses_no_pair():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(base, rng.integers(120, 400), False), rng.integers(0, 2**63, rng.integers(0, 40)).astype(np.uint64)))) for _ in range(60)]

    class Every(ngramjoin.Forest):
        def join(self, i, j):
            return True

    tree = ngramjoin.Tree(np.array(list(map(len, sets))), [ngramjoin.point(s) for s in sets])
    through = {frozenset(p) for p in tree.pairs(75, Every(len(sets)))}
    links = {frozenset((i, j)) for i in range(60) for j in range(i) if ngramjoin.linked(sets[i], sets[j], 75)}
    assert links and links <= through


def test_join_of_odd_tables(odd, empty):
    rows = ngramjoin.near_duplicates(odd).collect()
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == odd.count()
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 2, 5), (6, 2, 5), (7, 1, 7), (8, 1, 8)} <= got
    assert ngramjoin.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("ids", ["null", "shared", "mixed"])
def test_join_without_names(docs_of, ids):
    t = near_copies(120, 3)
    want = components({i: shingles(x) for i, x in enumerate(t)})
    name = {"null": lambda i: None, "shared": lambda i: i // 40, "mixed": lambda i: [None, i, 7][i % 3]}[ids]
    df = docs_of(*[(name(i), x, "s") for i, x in enumerate(t)])
    of = defaultdict(set)  # texts of each group
    marks = {r.mark: r.text for r in df.select("text", F.xxhash64("text").alias("mark")).collect()}
    rows = ngramjoin.grouped(df).collect()
    assert len(rows) == len(t)
    for r in rows:
        of[r.group if r.group is not None else ("alone", r.mark)].add(marks[r.mark])
    by = defaultdict(set)
    for i, x in enumerate(t):
        by[want[i]].add(x)
    assert sorted(map(sorted, of.values())) == sorted(map(sorted, by.values()))
    least = {x: min((name(i) for i in want if want[i] == c and name(i) is not None), default=None) for c in by for x in by[c]}
    text_of = {(r.doc_id, r.mark): marks[r.mark] for r in rows}
    assert all(r.group is None or r.component == least[text_of[r.doc_id, r.mark]] for r in rows)
    left = corpus_pipeline.drop_near_copies(df.sparkSession, df, "").collect()
    group_of = {x: c for c in by for x in by[c]}
    assert sorted(group_of[r.text] for r in left) == sorted(by)
    assert all(r.doc_id == least[r.text] for r in left)


# --- language


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", held_out(4, 2))
    rows = langid.predict(docs, langid.fit(docs, ~held_out(4, 2))).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_language_model_is_that_of_its_rows(spark, docs_of):
    """Counts, frequencies and vectors against plain loops; the sample does not depend on how rows are dealt."""
    given = ["The cat, the Hat!", "ñandú über", "", "a", "123 45", "x" * 50_000]
    fold = lambda t: [b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in t.encode()]
    mask = (1 << 32) - 1

    def counts(text):
        x, out = fold(text), Counter()
        for i in range(len(x) - 1) if len(x) > 1 else []:
            if x[i] == x[i + 1] == 32:
                continue
            two = x[i] << 8 | x[i + 1]
            out[(two * 0xC2B2AE35 & mask) >> 20] += 1
            if i + 2 < len(x):
                three = (two * 0x9E3779B1 & mask) ^ (x[i + 2] * 0x85EBCA6B & mask)
                out[(three * 0x27D4EB2F & mask) >> 20] += 1
        return out

    got = langid.gram_counts(pa.array(given, pa.large_string()))
    for row, text in zip(got, given):
        assert {i: int(row[i]) for i in np.flatnonzero(row)} == counts(text)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["der", "die", "und", "nicht"] if i % 2 else ["the", "and", "of", "not"], k=12)), "s") for i in range(400)]
    df = docs_of(*rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "de").otherwise("en"))
    df_counts, n = langid.document_frequencies(df)
    want = Counter(i for _, t, _ in rows for i in counts(t))
    assert n == 400 and {i: int(df_counts[i]) for i in np.flatnonzero(df_counts)} == want
    a, b = (langid.fit(d, F.lit(True), per_lang=60) for d in (df.repartition(1), df.repartition(7)))
    assert a.langs == b.langs == ["de", "en"] and (a.centroids == b.centroids).all() and (a.floor == b.floor).all()
    assert langid.sampled(df.select("doc_id", "lang", "text"), 60).groupBy("lang").count().filter("count <> 60").count() == 0
    # the nearest centroid of a plain computation
    idf = np.array([np.log(401 / (1 + want[i])) + 1 for i in range(langid.DIMS)])
    for r in langid.predict(df.limit(40), a).collect():
        v = np.zeros(langid.DIMS)
        for i, c in counts(rows[r.doc_id][1]).items():
            v[i] = np.log1p(c) * idf[i]
        best = (a.centroids @ v) / np.linalg.norm(v)
        assert r.lang_pred == a.langs[a.owner[best.argmax()]]


def test_language_of_odd_tables(odd, empty):
    rows = langid.predict(odd, langid.fit(odd, F.lit(True))).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    assert langid.predict(empty, langid.fit(empty, F.lit(True))).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(empty, F.lit(True))).collect()} == {"und"}


# --- packing


def test_encoder_equals_the_tokenizer(spark):
    path = packing.default_tokenizer()
    encoder = Encoder(path, limit=5000)
    odd_ones = ["", " ", "  a", "a  b \n c\n\n d ", "a\n", "\n\n x", "x  ", "é1 2a__b  !!", None, "don't 's 'll", "a b  c\t\ty", "１２ 中文 🎉🎉 <|endoftext|> x", "hello <|endoftext|> x", "<|endoftext|><|endoftext|>", "a <|endoftext", "'"]
    every = odd_ones + list(texts(spark).values())
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in every], add_special_tokens=False)]
    assert want[12] == [31373, 220, 50256, 2124]
    assert [x.tolist() for k in range(0, len(every), 40) for x in encoder.encode(every[k : k + 40])] == want


def check_packing(df, capacity):
    path = packing.default_tokenizer()
    p = packing.pack(df, path, capacity).toPandas()
    tokenizer = Tokenizer.from_file(path)
    ids = defaultdict(list)
    for r in df.collect():
        ids[r.doc_id].append(np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4"))
    p = p.sort_values(["sequence_id", "offset"])
    assert (p.offset == p.groupby("sequence_id").length.cumsum() - p.length).all()
    assert p.groupby("sequence_id").length.sum().max() <= capacity
    assert p.length.sum() == sum(len(x) for v in ids.values() for x in v)
    for r in p.itertuples():
        whole = ids[None if r.doc_id != r.doc_id else r.doc_id]
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in whole)
        assert r.piece == 0 or r.length == capacity
    return p


def test_packing_is_tight_and_exact(spark):
    p = check_packing(documents(spark), 1024)
    assert p.sequence_id.nunique() <= 1.02 * p.length.sum() / 1024 + 1


def test_packing_patterns_are_all_of_a_few_documents():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 3, 61)
    counts[0] = 0
    have = [int(a) for a in np.flatnonzero(counts)]
    want = {(a,) for a in have if a == 60} | {(a, b) for a in have for b in have if a >= b and a + b == 60}
    want |= {(a, b, c) for a in have for b in have for c in have if a >= b >= c and a + b + c == 60}
    want |= {tuple(sorted([a] * k + [60 - k * a] * (60 > k * a), reverse=True)) for a in have for k in range(3, 61) if k * a <= 60 and (k * a == 60 or 60 - k * a in have)}
    got = [tuple(sorted([a for a, k in zip(r, t) for _ in range(k)], reverse=True)) for r, t in zip(*(x.tolist() for x in packing.patterns(counts)))]
    assert set(got) == want


def test_packing_plans_use_up_their_histogram():
    rng = np.random.default_rng(0)
    short = np.zeros(129, int)
    short[[5, 9, 14]] = 4000, 900, 700
    for shape in (rng.integers(0, 50, 129), np.eye(129, dtype=int)[128] * 7, np.eye(129, dtype=int)[100] * 3, np.zeros(129, int), short):
        shape[0] = 0
        used = np.zeros(129, int)
        for pattern, n in packing.plan(shape):
            assert sum(pattern) <= 128
            for a in pattern:
                used[a] += n
        assert (used == shape).all()
    filled = sum(n for _, n in packing.plan(short))
    assert filled <= 1.03 * (short * np.arange(129)).sum() / 128 + 1


def test_packing_of_odd_tables(odd, empty):
    check_packing(odd, 64)
    assert packing.pack(empty, packing.default_tokenizer()).count() == 0
