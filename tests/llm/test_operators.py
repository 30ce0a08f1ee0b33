"""Every operator against plain Python, over texts with all odd cases, and over empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from schedlake.llm import (decontamination, jaccard, licenses, ngram_lm, packing, pii, quality, queries, suffix_dedup,
                           suffixes, superstrings, token_files, tokens, url_filter)
from schedlake.llm.elias_fano import EliasFano
from schedlake.llm.shared import written


@pytest.fixture(scope="module")
def docs(spark):
    return written(brute.documents(spark), "docs")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


ITEMS = [(1, "alpha beta"), (2, None), (3, ""), (4, "!?"), (None, "gamma"), (5, "Word word WORD word word word word word word word word word word word"),
         (6, "ok"), (6, "ok"), (7, "one two"), (8, "λάμδα 日本")]


@pytest.mark.parametrize("block", [1 << 20, 150])
def test_decontamination(spark, docs, empty, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontamination.decontaminate(docs, items, block_bytes=block)
    assert got.columns == ["row", "n_words", "n_hit", "items", "spans"]
    same([(r["row"]["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got.collect()],
         [(i, *n[:2], tuple(n[2])) for i, t in plain(docs) for n in [brute.contamination(t, ITEMS)]])
    for r in got.where("n_hit > 0").collect():
        text = r["row"]["text"]
        word = re.compile(decontamination.WORD)
        assert sum(len(word.findall(text[s["start"]:s["end"]].translate(brute.LOWER))) for s in r["spans"]) == r["n_hit"]
    assert decontamination.decontaminate(empty, items).count() == 0
    assert decontamination.decontaminate(docs, items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


URLS = ["http://A.Example.org/es/x", "https://example.org/en/12?x#y", "http://example.org/en/2", "x.org/es/", "http://badexample.org/es/1",
        "a://b.com/fr/", "a://b.com/de/q", "a://com/de", None, "", "://", "http://host.net", "http://.org/", "http://org", "http://org?x=/es/"]
RULES = [url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", "Example.org", "/en/1"),
         url_filter.Rule("allow", "example.org", "/en/1"), url_filter.Rule("allow", "com", "/fr/"), url_filter.Rule("block", "com", "/de/"),
         url_filter.Rule("block", "com", "")]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.translate(brute.LOWER)
    fits = [(r.host.count("."), len(r.path), r.verdict == "block", r.host.lower() + r.path, r.verdict) for r in RULES
            if (host == r.host.lower() or host.endswith("." + r.host.lower())) and path.startswith(r.path)]
    return host, path, *(max(fits)[3:] if fits else (None, "allow"))


@pytest.mark.parametrize("block", [1 << 20, 1])
def test_url_filter(spark, block):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(3, URLS[3], "h")], "page_id long, url string, host string")
    got = url_filter.judge(pages, RULES, block_bytes=block)
    same(got.collect(), [(i, *judged(u)) for i, u in [*enumerate(URLS), (3, URLS[3])]])
    assert {r["verdict"] for r in url_filter.judge(pages, [], default="block").collect()} == {"block"}
    assert url_filter.judge(pages.limit(0), RULES).count() == 0
    with pytest.raises(ValueError):
        url_filter.judge(pages, [url_filter.Rule("maybe", "org", "/")])


def test_quality_signals(docs, empty):
    got = quality.quality(docs)
    same([(r["doc_id"], *(r[s] for s in quality.SIGNALS)) for r in got.collect()], [(i, *brute.signals(t)) for i, t in plain(docs)])
    for r in got.collect():
        n, _, _, _, repeated = (r[s] for s in quality.SIGNALS)
        assert r["base_failed"] == (n < 20 or 100 * repeated > 30 * n)
        assert r["kept"] == (not r["base_failed"] and not r["host_failed"])
    assert quality.quality(empty).count() == 0
    assert quality.keep_good(empty).count() == 0


def test_host_verdicts(spark):
    good = "plain words in a row that say many different things about nothing at all so that every rule is met here "
    rows = [(i, good + str(i), "fine") for i in range(30)] + [(100 + i, "bad", "junk") for i in range(300)]
    rows += [(500, good + "x", "junk"), (501, good + "y", None), (502, "bad", "fine")]
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[500]["host_failed"] and not got[500]["kept"]
    assert got[501]["kept"] and got[0]["kept"] and not got[502]["kept"]
    kept = quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    alpha, beta = quality.beta_prior(1000, 10, 100, 10.0)
    assert alpha / (alpha + beta) == pytest.approx(0.1)
    assert quality.beta_prior(0, 0, 0, 0.0) == (1.0, 1.0)


def dice(a, b):
    a, b = set(a), set(b)
    return 2 * len(a & b) / (len(a) + len(b))


@pytest.mark.parametrize("block", [20_000, 5])
def test_licenses(spark, monkeypatch, block):
    monkeypatch.setattr(licenses, "BLOCK_BIGRAMS", block)
    rows = [(1, "Intro here. Licensed under the Apache License, Version 2.0. More."), (2, None), (3, ""), (4, "released under the mit license!\nx"),
            (5, "Released under an MIT license"), (6, "word " * 5000), (7, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, license string, found string")
    got = {r["doc_id"]: r for r in licenses.licenses(docs).collect()}
    for i, text in rows:
        parts = {text or ""} | set((text or "").split("\n")) | set(re.sub(r"([.!?])[ \t]+", r"\1\n", text or "").split("\n"))
        parts = {re.sub(licenses.NOT_WORD, " ", p.translate(brute.LOWER)).strip(" ") for p in parts}
        found = []
        for p in parts:
            w = p.split(" ")
            g = [f"{a} {b}" for a, b in zip(w, w[1:])]
            found += [(d, n) for n, t in licenses.NOTICES if g and (d := dice(g, licenses.template_bigrams(t))) >= licenses.LEAST]
        assert got[i]["n_matches"] == len(found), i
        assert got[i]["licenses"] == ",".join(sorted({n for _, n in found}))
        assert (got[i]["dice"], got[i]["license"]) == (min((-d, n) for d, n in found)[0] * -1, min((-d, n) for d, n in found)[1]) if found else (None, None)
    assert licenses.licenses(docs.limit(0)).count() == 0
    assert licenses.licenses(docs, templates=[]).agg(F.sum("n_matches")).first()[0] == 0


def test_licenses_inside_texts(spark):
    import textwrap

    texts = dict(licenses.full_texts())
    headers = dict(licenses.HEADERS)
    around = "Some words about the weather before it.\n{}\nAnd others that follow in the same file"
    rows = [("MIT", texts["MIT"].split("\n\n")[0]), ("BSD-3-Clause", texts["BSD-3-Clause"]), ("GPL-3.0", headers["GPL-3.0"]),
            ("Apache-2.0", headers["Apache-2.0"]), ("AGPL-3.0", headers["AGPL-3.0"]), ("GPL-2.0", texts["GPL-2.0"]),
            ("MIT", texts["MIT"]), ("CC-BY-4.0", dict(licenses.NOTICES)["CC-BY-4.0"])]
    made = [(i, around.format("\n".join("# " + x for x in textwrap.wrap(t, 50)))) for i, (_, t) in enumerate(rows)]
    docs = spark.createDataFrame(made + [(99, around)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.licenses(docs).collect()}
    for i, (name, _) in enumerate(rows):
        assert (got[i]["license"], got[i]["dice"] > 0.95) == (name, True), (got[i], name)
    assert got[99]["n_matches"] == 0


@pytest.mark.parametrize("members,leaf,pivots", [(4096, 192, 16), (2, 2, 2)])
@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard_join(spark, docs, empty, monkeypatch, members, leaf, pivots, n, percent):
    monkeypatch.setattr(jaccard, "TASK_MEMBERS", members)
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    rows = plain(docs)
    sets = {k: brute.shingles(t, n) for k, (_, t) in enumerate(rows)}
    group = brute.components(sets, percent)
    least = {}
    for k, g in group.items():
        least.setdefault(g, []).append(rows[k][0])
    least = {g: min((i for i in v if i is not None), default=None) for g, v in least.items()}
    same(jaccard.similar(docs, n=n, percent=percent).collect(),
         [(i, len(sets[k]), least[group[k]] if sets[k] else i) for k, (i, _) in enumerate(rows)])
    kept = jaccard.one_of_each(docs, n=n, percent=percent)
    assert kept.columns == docs.columns
    assert kept.count() == len({group[k] for k in group if sets[k]}) + sum(not s for s in sets.values())
    assert jaccard.similar(empty).count() == 0


def test_jaccard_regions_lose_no_link():
    rng = np.random.default_rng(5)
    base = rng.choice(10 ** 6, 100, replace=False)
    sets = []
    for k in range(700):  # one family whose members lie around the threshold
        s = base.copy()
        s[rng.choice(100, rng.integers(0, 25), replace=False)] = rng.integers(10 ** 6, 10 ** 9, 1)
        sets.append(np.unique(s))
    space = jaccard.Space(sets)
    space.join(np.arange(len(sets)), 85)
    want = brute.components({i: frozenset(s.tolist()) for i, s in enumerate(sets)}, 85)
    assert len(set(want.values())) > 3
    assert Counter(Counter(space.root.tolist()).values()) == Counter(Counter(want.values()).values())


PERSONAL = [None, "", "a@b.c_d@e.f x@y", "x@y.z", "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112 4111111111111111x",
            "+33 1 23 45 67 89 and +1", "é🙂a@b.co +49 (30) 1234567", "1 " * 3000, "a." * 3000 + "@", "call bob (at) example.org",
            "9" * 9000, "4111111111111111@x.de 1.1.1.1@x.y", "x" * 3000 + " a@b.de"]


def test_personal_data(spark, docs, empty):
    rows = [(i, t) for i, t in enumerate(PERSONAL)] + [(3, PERSONAL[3])]
    table = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = pii.find(table).select("row.doc_id", "row.text", "spans", pii.redacted(F.coalesce("row.text", F.lit("")), F.col("spans")).alias("clean")).collect()
    assert len(got) == table.count()
    for r in got:
        base = [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in r["spans"] if s["base"]]
        assert base == brute.base_spans(r["text"])
        assert not [s for s in brute.base_spans(r["clean"]) if s[0] in ("email", "ip")] or not base
    same(pii.find_in(table).select("doc_id", pii.written_out(F.col("spans"))).collect(),
         [(r["doc_id"], ",".join(f"{pii.KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in r["spans"])) for r in got])
    assert pii.find_in(empty).count() == 0


def test_personal_data_counts(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(PERSONAL)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in enumerate(PERSONAL):
        base = brute.base_spans(t)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        want.append((i, *[sum(s[0] == k for s in base) for k in pii.KINDS], digest))
    same([tuple(r)[:6] for r in queries.QUERIES["op6_personal_data"](spark, str(tmp_path)).collect()], want)


def test_addresses_with_zero_parts(spark):
    texts = ["10.0.0.1", "from 0.0.0.0 to 192.168.00.1", "255.0.256.1", "000.00.0.0", "0.0.0 1.0.0.256", "0" * 4000 + ".0.0.0", "8.8.8.8"]
    got = pii.find_in(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        base = [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in r["spans"] if s["base"]]
        assert base == brute.base_spans(texts[r["doc_id"]])
    assert sum(s["kind"] == pii.KINDS.index("ip") for r in got for s in r["spans"] if s["base"]) == 6


def test_reliabilities_follow_the_votes():
    good, bad = (0, True, 1, 1, 1, 0, 1, 0), (3, False, 0, 0, 0, -1, -1, 0)
    truth = pii.reliabilities([(good, 900), (bad, 100)])
    assert truth[0] > 0.95 and truth[1] < 0.05
    weights = pii.classifier([(good, 900), (bad, 100)], truth)
    assert sum(a * b for a, b in zip(weights, pii.features(good))) > 0 > sum(a * b for a, b in zip(weights, pii.features(bad)))


@pytest.mark.parametrize("hot", [0.002, 0.0])
def test_language_model(spark, docs, empty, monkeypatch, hot):
    monkeypatch.setattr(ngram_lm, "HOT_SHARE", hot)
    monkeypatch.setattr(ngram_lm, "CHUNK_BYTES", 20_000)
    rows = plain(docs)
    got = sorted((tuple(-9 if x is None else x for x in r) for r in ngram_lm.score(docs).collect()))
    want = sorted((-9 if i is None else i, *b) for (i, _), b in zip(rows, brute.bigram_scores(rows, ngram_lm.PRIOR)))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert abs(g[6] - w[6]) <= (ngram_lm.Trie.STEP / 2 + 1e-3) * g[2]
    assert ngram_lm.score(empty).count() == 0
    alone = ngram_lm.score(docs, train=F.lit(False)).agg(F.max("n_known"), F.max("train_tokens")).first()
    assert tuple(alone) == (0, 0)


def test_language_model_shards_stay_small_however_frequent_a_context(spark, monkeypatch):
    for name, value in {"SHARD_BIGRAMS": 100, "CHUNK_BYTES": 4000, "SLICE_BYTES": 1000}.items():
        monkeypatch.setattr(ngram_lm, name, value, raising=False)
    tables = {}
    monkeypatch.setattr(ngram_lm, "written", lambda df, name: tables.setdefault(name, written(df, name)))
    rows = [(i, " ".join(f"the w{i}x{j}" for j in range(20))) for i in range(400)]
    got = ngram_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for g, w in zip(sorted(got), brute.bigram_scores(rows, ngram_lm.PRIOR)):
        assert tuple(g[1:5]) == w[:4]
        assert abs(g["score"] - w[5]) <= (ngram_lm.Trie.STEP / 2 + 1e-3) * g["n_tokens"]
    answers = tables["answers"]
    assert answers.where(F.length("totals") == 0).count() == 0  # no rows that ask for nothing
    shards = answers.groupBy("shard").agg(F.sum(F.length("found")).alias("n"))
    assert shards.agg(F.max("n")).first()[0] <= 250  # of 16,400 bigrams, half of them after one word


def test_language_model_chunks_hold_little_text(spark):
    texts = spark.range(8, numPartitions=1).selectExpr("id AS doc_id", "true AS train", "CAST(repeat('ab cd ', 170000) AS binary) AS data")
    sizes = [r[0] for r in ngram_lm.chunks(texts).select(F.length("tokens") / 4).collect()]
    assert sum(sizes) == 8 * 340_001 and max(sizes) * 3 <= 6 << 20


def test_language_model_beats_unigrams_on_held_out_text(spark, small):
    scored = ngram_lm.score(spark.read.parquet(f"{small}/documents.parquet")).where("held_out")
    base, model = scored.agg(F.sum("base_score"), F.sum("score")).first()
    assert model > base


def test_elias_fano():
    rng = np.random.default_rng(1)
    for universe in (1, 5, 1000, 1 << 40):
        for n in (0, 1, 7, 500):
            values = np.sort(rng.integers(0, universe, n))
            sequence = EliasFano.of(values, universe)
            asked = np.concatenate([values, rng.integers(0, universe, 50)])
            assert (sequence.find(asked) == np.searchsorted(values, asked)).all()
            assert (sequence.at(np.arange(n)) == values).all()
    dense = EliasFano.of(np.arange(100_000) * 7, 700_000)
    assert 8 * (len(dense.low) + len(dense.high)) < 5.5 * 100_000


@pytest.mark.parametrize("hot,held", [(4000, 8 << 20), (2, 600)])
def test_suffix_dedup(docs, empty, monkeypatch, hot, held):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", held)
    rows = plain(docs)
    got = suffix_dedup.remove_repeats(docs).select(
        "row.doc_id", "n_bytes", F.col("n_bytes") - F.length("kept"), F.size("spans"), F.sha2("kept", 256)).collect()
    same(got, [(i, *r) for (i, _), r in zip(rows, brute.removed([(t or "").encode() for _, t in rows]))])
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_arrays():
    rng = np.random.default_rng(2)
    for _ in range(200):
        data = bytes(rng.choice(np.frombuffer(b"ab\xc3c", np.uint8), rng.integers(1, 80))).translate(suffixes.SHIFT) + suffixes.PART
        assert suffixes.suffix_array(data, 200).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def test_runs_hold_each_window_once_and_equal_windows_share_a_key():
    rng = np.random.default_rng(3)
    pool = [bytes(rng.choice(np.frombuffer(b"abcd ", np.uint8), n)) for n in (5, 150, 260)] + [b"z" * 9000]
    found = [b"".join(pool[i] for i in rng.integers(0, 4, 4)) for _ in range(6)]
    text, key, first, last, times = superstrings.runs(found)
    cover = Counter((i, s) for i, a, b in zip(text, first, last) for s in range(a, b + 1))
    assert set(cover) == {(i, s) for i, t in enumerate(found) for s in range(len(t) - 199)} and max(cover.values()) == 1
    keys = {}
    for i, k, a, b, n in zip(text, key, first, last, times):
        for s in range(a, b + 1):
            assert keys.setdefault(found[i][s:s + 200], k) == k
        assert n > 1 or len({found[i][s:s + 200] for s in range(a, b + 1)}) == b - a + 1


def reference_ids(texts, literal=False):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.vocabulary_file())
    tokenizer.encode_special_tokens = literal
    return [[*e.ids, 0] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def encoded(encoder, texts):
    ids, places = encoder.encode_with_end(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(places, places[1:])]


@pytest.mark.parametrize("literal", [False, True])
def test_tokens_equal_the_library(monkeypatch, literal):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    rng = np.random.default_rng(4)
    parts = [" ", " ", "\n", "\t", "\r", "a", "B", "é", "1", "²", ",", "'s", "'ll", "!?", "  ", "日本", "🙂", "\x00", "\x1c", "\x85", "<|endoftext|>", "½", "—"]
    common = [" ", " ", "\n", "a", "Bc", "é", "1", ",", "'s", ".", "  ", "“"]
    texts = ["".join(rng.choice(p, rng.integers(0, 25))) for p in (parts, common) for _ in range(3000)]
    texts += [None, *(t for _, t, _ in brute.texts())]
    encoder = tokens.Encoder(tokens.vocabulary_file(), literal)
    assert encoded(encoder, texts) == reference_ids(texts, literal) == encoded(encoder, texts)
    assert encoded(encoder, []) == [] and encoded(encoder, [None, ""]) == [[0], [0]]
    sliced = pa.array(["x", "a b", None, "c"]).slice(1, 3)
    assert encoded(encoder, sliced.to_pylist()) == [x for x in reference_ids(["a b", "", "c"], literal)]
    assert encoder.encode(sliced)[1].tolist() == [0, 2, 2, 3]


def test_special_tokens_as_the_library_reads_them(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary_file())  # untouched
    rows = [(1, "x <|endoftext|> y"), (2, "<|endoftext|>"), (3, "a<|endoftext|><|endoftext|> b  c"), (4, "plain <|endoftext| > text")]
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in rows}
    assert 50256 in ids[1]
    assert encoded(tokens.encoder(tokens.vocabulary_file()), [t for _, t in rows]) == list(ids.values())
    want = [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs, path, files=2)
    same(token_files.checksums(token_files.read_tokens(spark, path)).select("doc_id", "n_tokens", "ids_crc32").collect(), want)
    same(packing.pack(packing.written_pieces(docs)).select("doc_id", "length", "ids_crc32").collect(), want)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(docs, empty, capacity):
    rows = plain(docs)
    cut = packing.written_pieces(docs, capacity=capacity)
    packed = packing.pack(cut, capacity).collect()
    whole = Counter((i, zlib.crc32(np.array(x, "<u4").tobytes()), len(x)) for (i, _), x in zip(rows, reference_ids([t for _, t in rows])))
    built = Counter()
    for r in packing.with_ids(cut, packing.pack(cut, capacity)).collect():
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        built[r["doc_id"]] += r["length"]
    assert built == Counter({i: sum(n * c for (j, _, n), c in whole.items() if j == i) for i, _, _ in whole})
    bins = {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= 1.25 * sum(r["length"] for r in packed) / capacity + 1
    joined = packing.sequences(cut, packing.pack(cut, capacity)).collect()
    assert len(joined) == len(bins) and all(len(r["ids"]) <= 4 * capacity for r in joined)
    assert packing.pack(packing.written_pieces(empty)).count() == 0


def test_packing_plan_places_every_piece():
    rng = np.random.default_rng(6)
    for capacity in (1, 10, 2048):
        counts = Counter(rng.integers(1, capacity + 1, 500).tolist())
        bins, large, runs = Counter(), Counter(), {}
        for run in packing.plan(dict(counts), capacity):
            runs.setdefault(run[0], []).append(run[1:])
        for length, n in counts.items():
            own = sorted(runs[length])
            for rank in range(n):
                first, start, step, _ = [r for r in own if r[0] <= rank][-1]
                b = start + (rank - first) // step
                bins[b] += length
                large[b] += 3 * length > capacity
        assert max(bins.values()) <= capacity and max(large.values()) <= 2
        assert len(bins) <= 1.15 * sum(bins.values()) / capacity + 2


def test_token_files(spark, docs, empty, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs, path, files=4)
    rows = sorted(zip([i for i, _ in plain(docs)], reference_ids([t for _, t in plain(docs)])), key=lambda r: (r[0] is not None, r[0] or 0))
    got = token_files.checksums(token_files.read_tokens(spark, path)).collect()
    same([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got], [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in rows])
    at, order = 0, sorted(got, key=lambda r: r["start"])
    for r in order:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in order]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    one = token_files.read_tokens(spark, path, F.col("doc_id") == 13)
    assert one.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,13)]" in one._jdf.queryExecution().toString()
    token_files.write_tokens(empty, path + "-none")
    assert spark.read.schema("doc_id long, start long, n_tokens long, ids array<int>").orc(path + "-none").count() == 0


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for (name, stage), columns in zip(corpus_pipeline.STAGES, [docs.columns] * 4 + [None]):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = written(stage(spark, docs, small), "stage")
        after = docs.collect()
        if columns:
            assert docs.columns == columns and {r["doc_id"] for r in after} <= set(before)
        if name == "quality rules":
            for i, t in before.items():
                n, _, _, _, repeated = brute.signals(t)
                assert (i in {r["doc_id"] for r in after}) == (n >= 20 and 100 * repeated <= 30 * n)
        elif name == "n-gram Jaccard join":
            group = brute.components({i: brute.shingles(t, 5) for i, t in before.items()}, 80)
            assert sorted(r["doc_id"] for r in after) == sorted(set(group.values()))
        elif name == "benchmark decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
            bad = {i for i, t in before.items() for n, hit, _ in [brute.contamination(t, items)] if hit and 20 * hit >= n}
            assert bad == set(before) - {r["doc_id"] for r in after}
        elif name == "PII":
            assert not [s for r in after for s in brute.base_spans(r["text"])]
            assert all(r["text"] == before[r["doc_id"]] for r in after if not brute.base_spans(before[r["doc_id"]]) and "[" not in r["text"])
        else:
            assert {r["doc_id"] for r in after} == set(before)
