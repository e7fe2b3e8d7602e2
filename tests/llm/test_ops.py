"""The training-data operators against brute force, round trips and held-out cases."""

import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, "tests")
from oracle import differences  # noqa: E402
from strandline.llm import bpe, common, html_text, mixing, near_embeddings, ngram_join, pii, quality, registry, sharding, toxicity, warc  # noqa: E402

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, at string, c int"


def docs(spark, texts, sources=None):
    """Documents with nulls and with columns whose names the operators use inside."""
    rows = [(i, t, None, sources[i] if sources else f"src{i % 3}", None, "x", "y", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(n))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    names, left, right, (n, m) = differences(spark, registry.queries()[name], registry.oracle_sql()[name])
    assert names and not left and not right and n == m > 0


def test_sharding_cases(spark):
    assert sharding.stratified_shards(docs(spark, [])).count() == 0
    d = docs(spark, ["a"] * 60, [None] * 30 + ["x"] * 20 + ["y"] * 10).unionByName(docs(spark, ["b"], ["x"]))
    got = sharding.stratified_shards(d, 10).collect()
    assert sorted(r.position for r in got) == list(range(1, 62))
    for shard in range(10):
        mine = [r.source for r in got if r.shard == shard]
        assert 2 <= mine.count(None) <= 4 and 1 <= mine.count("x") <= 3 and mine.count("y") <= 2


def filled(sizes, weights, cap, total):
    """Water-filling round by round."""
    share, open_ = {}, set(sizes)
    left = total
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = [s for s in open_ if weights[s] * level > cap * sizes[s]]
        if not over:
            return share | {s: weights[s] * level for s in open_}
        for s in over:
            share[s] = cap * sizes[s]
            left -= share[s]
            open_.remove(s)
    return share


def test_mixing_levels(spark):
    rng = random.Random(4)
    for _ in range(4):
        sizes = {f"s{i}": rng.randint(1, 400) for i in range(6)}
        weights = {s: rng.randint(1, 30) for s in sizes}
        d = spark.createDataFrame([(i, "x" * n, s) for i, (s, n) in enumerate(sizes.items())], "doc_id int, text string, source string")
        got = {r.source: r.target_chars for r in mixing.source_epochs(d, weights, 4, 3, 1.0).collect()}
        want = filled(sizes, weights, 3, sum(sizes.values()))
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)


def test_mixing_cases(spark):
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    d = docs(spark, ["ab", None, "", "abcd", "ab"], [None, None, "x", "x", "y"])
    got = mixing.mix_sources(d, columns=d.columns)
    assert got.columns == [*d.columns, "copy"]
    epochs = {r.source: r.epochs for r in mixing.source_epochs(d).collect()}
    times = {i: sum(r.doc_id == i for r in got.collect()) for i in range(5)}
    assert all(int(epochs[s]) <= times[i] <= int(epochs[s]) + 1 for i, s in enumerate([None, None, "x", "x", "y"]))
    # a column of the copies' name gives way to them, or stays where none is asked for
    e = d.withColumnRenamed("c", "copy")
    assert mixing.mix_sources(e, columns=e.columns).columns == [c for c in e.columns if c != "copy"] + ["copy"]
    kept = mixing.mix_sources(e, columns=e.columns, copy_col=None)
    assert kept.columns == e.columns and {r["copy"] for r in kept.collect()} == {1} and kept.count() == got.count()


def test_pii_formats():
    model = pii.fit_model(4000)
    text = "mail to erst.49@mail9.example.com or +1 (068) 555-1234 10.20.30.40, card 4271650964202739; token = \"186661156f3f9905942d70850a01cbf23a203f82\" on 2021-03-04, version 1.2.3, $12.50"
    (spans,) = pii.find([text], model)
    assert [s[2] for s in spans] == ["EMAIL", "PHONE", "IP", "CARD", "SECRET"]
    assert "2021-03-04, version 1.2.3, $12.50" in pii.redacted(text, spans)
    x, y, kinds = pii._rows(1500, 77)
    p = model.trees.predict(x)
    for k in pii.KINDS:
        chosen = p[kinds == k] >= model.thresholds[k]
        assert (chosen & (y[kinds == k] > 0)).sum() >= 0.97 * (y[kinds == k] > 0).sum()


def test_pii_cases(spark):
    model = pii.fit_model(4000)
    long = "wort " * 40000 + "a.49@mail9.example.com " + "wort " * 10
    d = docs(spark, [None, "", "plain words only", long, "x 1.2.3.4 y", "x 1.2.3.4 y"])
    got = {r.doc_id: r for r in pii.redact(d, model, spans_col="at").collect()}
    assert got[0].text is None and got[1].text == "" and got[2].text == "plain words only" and not got[2]["at"]
    assert "[EMAIL]" in got[3].text and len(got[3].text) > 200000 and got[4].text == got[5].text
    assert pii.scan(docs(spark, []), model).count() == 0


def test_pii_long_runs():
    """Unbroken runs are read once, and candidates are what a search from every @ finds."""
    import re
    import time

    model, began = pii.fit_model(4000), time.time()
    for text in ("=" + "x" * 1_000_000, "a." * 300_000 + "@", "@" * 300_000, "a@" * 200_000, "key" + " " * 500_000 + "=", "1 " * 100_000, "x@y" + ".1" * 300_000):
        pii.candidates(text)
    assert time.time() - began < 20
    text = "to (a.b@c.de), x@y.org;q!r@s.co@t.uk 'm@n.net' @x.de u@v"
    old = re.compile(r"[^\s@<>()\[\],;:\"|]+@[^\s@<>()\[\],;:\"|!?*#$%&]+\.[^\W\d_]{2,}")
    assert list(pii._addresses(text)) == [m.span() for m in old.finditer(text)]
    texts = ["host fe80::1ff:fe23:4567:890a up", "client address 2001:db8::1 seen", "call +33 6 12 34 56 78 now"]
    assert [pii.redacted(t, s) for t, s in zip(texts, pii.find(texts, model))] == ["host [IP] up", "client address [IP] seen", "call [PHONE] now"]


def test_pii_brute():
    """Selected spans by scoring every candidate alone and taking the best, one by one."""
    model = pii.fit_model(4000)
    texts = [t for t, _ in pii._examples(300, 5)] + ["", "no data", "a.b1@mail.com a.b1@mail.com 10.0.0.1"]
    for text, got in zip(texts, pii.find(texts, model)):
        scored = [(float(model.trees.predict(np.array([pii.features(text, c)]))[0]), c) for c in pii.candidates(text)]
        left = sorted(((p, c) for p, c in scored if p >= model.thresholds[c.kind]), key=lambda e: (-round(e[0], 2), e[1].start - e[1].end, e[1].start, e[1].kind))
        taken = []
        for p, c in left:
            if all(c.end <= a or b <= c.start for a, b, _, _ in taken):
                taken.append((c.start, c.end, c.kind, round(p, 6)))
        assert sorted(taken) == got


def near_classes_of(x, t, copies=None):
    """(class, links) of each row by brute force."""
    u = near_embeddings.unit(x).astype(float)
    near = u @ u.T >= t
    np.fill_diagonal(near, False)
    group = np.arange(len(x))
    for i, j in zip(*np.nonzero(np.triu(near))):
        low, high = sorted((group[i], group[j]))
        group[group == high] = low
    return group, near.sum(1)


@pytest.mark.parametrize("most", [8000, 40])
def test_embeddings(spark, monkeypatch, most):
    """Planted copies, dense groups beyond a candidate list, and rows that can have no partner."""
    monkeypatch.setattr(near_embeddings, "SHARD_MOST", most)
    monkeypatch.setattr(common, "HOT", 5)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[300:400] = x[:100] + 0.03 * rng.normal(size=(100, 16))
    x[400:410] = x[0]
    x[410:560] = x[7] + 0.02 * rng.normal(size=(150, 16))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(5, x[5].tolist(), 0)]
    odd = [(None, [1.0] * 16, 0), (700, None, 0), (701, [0.0] * 16, 0), (702, [float("nan")] * 16, 0), (703, [1.0, 2.0], 0), (704, [float("inf")] * 16, 0), (705, [1.0] * 15 + [None], 0), (706, [], 0)]
    d = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, shard int")
    got = {r.vec_id: r for r in near_embeddings.near_classes(d, 0.9, shard_rows=150).collect()}
    group, links = near_classes_of(x, 0.9)
    assert len(got) == 608 and sum(got[i].links for i in range(600)) >= 0.99 * links.sum() and all(got[i].links <= links[i] for i in range(600))
    assert np.mean([got[i].class_id == group[i] for i in range(600)]) >= 0.99 and got[0].recall >= 0.99
    assert all(got[i].links == 0 and got[i].class_id == i for i in range(700, 707)) and got[None].class_id is None
    assert near_embeddings.near_classes(d.limit(0)).count() == 0
    with pytest.raises(TypeError):
        near_embeddings.near_classes(d.withColumn("vec_id", F.col("vec_id").cast("string")))


def test_embeddings_across_shards(spark):
    """Isotropic pairs near the threshold lie across the borders of many small shards."""
    rng = np.random.default_rng(2)
    x, o = (near_embeddings.unit(rng.normal(size=(1000, 64)).astype(np.float32)) for _ in "xo")
    o = near_embeddings.unit(o - (o * x).sum(1, keepdims=True) * x)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, 0.805 * x + np.sqrt(1 - 0.805**2) * o]))], "vec_id bigint, embedding array<float>")
    got = {r.vec_id: r.class_id for r in near_embeddings.near_classes(d, 0.8, shard_rows=60).collect()}
    assert sum(got[i + 1000] == i for i in range(1000)) >= 990


def test_toxicity(spark):
    rng = random.Random(3)
    bad = ["zzkill", "zzhate", "zzworthless", "zzstupid"]
    toxic = [words(rng, 80) + " " + " ".join(rng.choice(bad) for _ in range(6)) + " " + words(rng, 40) for _ in range(60)]
    plain = [words(rng, 130) for _ in range(120)]
    model = toxicity.fit(toxic[:40], plain[:80])
    d = docs(spark, [*toxic[40:], *plain[80:], None, "", "zzkill " * 50000])
    got = {r.doc_id: r.toxic for r in toxicity.score(d, model).collect()}
    assert sum(got[i] for i in range(20)) >= 18 and sum(got[i] for i in range(20, 60)) <= 2
    assert not got[60] and not got[61] and got[62]
    kept = toxicity.drop_toxic(d, model)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {k for k, v in got.items() if not v}
    assert toxicity.score(d.limit(0), model).count() == 0
    assert not toxicity.fit([], plain).decide(0, 9)


def test_toxicity_brute(spark):
    """Scores by compressing every word of every document anew, and a fit that doesn't depend on row order."""
    import zstandard as zs

    rng = random.Random(9)
    bad = ["zzkill", "zzhateful"]
    texts = [words(rng, 60) + (" " + " ".join(rng.choice(bad) for _ in range(3)) if i % 3 == 0 else "") for i in range(90)] + [None, "", "One;zzkill,TWO"]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(0, 90, 2)] + [(1, 1, 0), (1, 1, 1), (None, 1, 1), (5, 1, None)], "doc_id bigint, quality int, toxic int")
    d = docs(spark, texts)
    model = toxicity.fit_on(d, labels)
    assert model == toxicity.fit_on(d.unionByName(d).repartition(5), labels)
    p = zs.ZstdCompressionParameters.from_level(toxicity.LEVEL, min_match=toxicity.MIN_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0, format=zs.FORMAT_ZSTD1_MAGICLESS)

    def length(dictionary, word):
        c = zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(dictionary, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=p)
        return len(c.compress(f" {word} ".encode() + toxicity.TRAILER))

    def toxic(part):
        return (length(model.ordinary, part) - length(model.toxic, part)) / (len(part.encode()) + 1) >= model.gain

    for r in toxicity.score(d, model).collect():
        spaced = (texts[r.doc_id] or "").lower().split()
        hits = sum(any(toxic(x) for x in toxicity.normal_words(w)) for w in spaced)
        assert (r.windows, r.toxic_windows, r.toxic) == (len(spaced), hits, hits > 0 and hits >= model.share * len(spaced))
    assert sum(r.toxic for r in toxicity.score(d, model).collect()) >= 28


TEXTS = ["", "Hello  world", "a", "  ", "a" * 30, "I'll be 123 ok!!\n\n  x  \n y", " x   z", "éàü 日本語 😀", "thintiing ertion, ok.\nFrom", None, "xy" * 600, " lead", "trail ", "a  b", "<|endoftext|>", "Hello  world"]


@pytest.mark.parametrize("max_words", [2, 1 << 18])
def test_bpe(spark, max_words):
    import tiktoken

    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(), special_tokens={})
    got = {r.doc_id: r for r in bpe.round_trip(docs(spark, TEXTS), max_words=max_words).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i].tokens == (None if t is None else enc.encode_ordinary(t))
        assert t is None or got[i].same
    if max_words == 2:
        same = spark.createDataFrame([(t,) for t in TEXTS if t is not None], "t string").select("t", F.hash("t").alias("h")).collect()
        assert all(bpe._murmur(r.t.encode()) == r.h % 2**32 for r in same)
        assert bpe.encode(docs(spark, [])).count() == 0
        d = spark.createDataFrame([([1, None, 60000, 2],), (None,), ([],)], "ids array<int>")
        ranks = {v: k for k, v in bpe.read_ranks().items()}
        assert [None if r[0] is None else bytes(r[0]) for r in d.select(bpe.decode(F.col("ids"))).collect()] == [ranks[1] + ranks[2], None, b""]


def test_bpe_held(spark):
    """The ids of one run of white space aren't another's; bytes that aren't UTF-8 come back."""
    import tiktoken

    texts = ["b\nc d\ne f\ng", "h\ni j\nk", "e  \n", "x \n", "o'll 's\r\n\r\n \u3000y"] * 3
    enc = tiktoken.Encoding("own", pat_str=r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=bpe.read_ranks(), special_tokens={})
    for r in bpe.round_trip(docs(spark, texts).coalesce(1), max_words=8).collect():
        assert r.tokens == enc.encode_ordinary(texts[r.doc_id]) and r.same
    raw = spark.sql("select 1L as doc_id, cast(x'61ff20c3c3a962' as string) as text")
    assert [r.same for r in bpe.round_trip(raw).collect()] == [True]


def test_bpe_plan(spark):
    """Encoding plans no table of words: no job before the rows are asked for, no shuffle, no plan that grows with the texts."""
    rng = random.Random(8)
    d, tracker = docs(spark, [words(rng, 300) for _ in range(60)]), spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    done = bpe.encode(d, tokens_col="text_ids")
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert len(tracker.getJobIdsForGroup(None)) == before and "Exchange" not in plan and "Subquery" not in plan
    assert done.columns == [*d.columns, "text_ids"]


def test_bpe_parts():
    """The ids of a large batch leave a worker in parts, in order and whole."""
    import pyarrow as pa
    import tiktoken
    from strandline.llm import bpe_fold

    with open(bpe.VOCABULARY, "rb") as f:
        encoder = bpe_fold.Encoder(f.read(), 1 << 12)
    enc = tiktoken.Encoding("own", pat_str=r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=bpe.read_ranks(), special_tokens={})
    rng = random.Random(6)
    some = [*(words(rng, 4000) for _ in range(20)), None, "", "é日😀 " * 20_000]
    texts = [rng.choice(some) for _ in range(300)] + [words(rng, 5) * 130_000, None]
    batch = pa.array([None if t is None else t.encode() for t in texts], pa.binary())
    parts = list(bpe._encoded(iter([batch.slice(0, 100), batch.slice(0, 0), batch.slice(100)]), lambda: encoder))
    sizes = [sum(len(t.encode()) for t in own if t) for own in np.split(np.array(texts, object), np.cumsum([len(p) for p in parts])[:-1])]
    assert len(parts) > 5 and all(n <= common.CHUNK_CHARS for n in sizes[:-2]) and max(sizes) > common.CHUNK_CHARS
    known = {t: None if t is None else enc.encode_ordinary(t) for t in set(texts)}
    assert [x for p in parts for x in p.to_pylist()] == [known[t] for t in texts]


def test_text_stages_in_parts(spark, monkeypatch):
    """What toxicity and redaction return doesn't depend on where a batch is cut."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150).unionByName(docs(spark, [None, "", "mail a.bee@example.org"]).select("doc_id", "text", "lang", "source", "n_chars")).coalesce(1).cache()
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model, trees = toxicity.fit_on(d, labels), pii.fit_model(2000)
    scorer, rows = toxicity.Scorer(model), d.collect()
    clean = [r for r in rows if not model.decide(*scorer.count([r.text])[0])]
    assert toxicity.drop_toxic(d, model).collect() == clean
    got = pii.redact(d, trees, spans_col="spans").collect()
    want = pii.find([r.text for r in rows], trees)
    assert [(r.doc_id, r.text, [tuple(x) for x in r.spans]) for r in got] == [(r.doc_id, pii.redacted(r.text, s), s) for r, s in zip(rows, want)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["ab" * 400_000, None, "", "c" * 900_000, "d" * 2_000_000, None, "e"])], ["id", "text"])
    cut = list(common.in_parts([batch, batch.slice(0, 0)], lambda b: b.column(1)))
    assert [b.column(0).to_pylist() for b in cut] == [[0, 1, 2], [3], [4], [5, 6]]
    assert pa.Table.from_batches(cut).equals(pa.Table.from_batches([batch]))


def test_bpe_fold():
    """Words side by side and alone, with few and many held, as tiktoken has them."""
    import tiktoken
    from strandline.llm import bpe_fold

    with open(bpe.VOCABULARY, "rb") as f:
        vocabulary = f.read()
    enc = tiktoken.Encoding("own", pat_str=r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=bpe.read_ranks(), special_tokens={})
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdethering  \n\t'slm12,.!é日😀\xa0\x1c\x85") for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(600)]
    texts += ["".join(rng.choice("thering") for _ in range(n)) for n in (2, 63, 64, 65, 66, 3000)] + ["ab" * 100_000]
    for most in (1, 1 << 19):
        encoder = bpe_fold.Encoder(vocabulary, most)
        for s in range(0, len(texts), 100):
            got = encoder.encode(texts[s : s + 100])
            assert [np.frombuffer(g, np.int32).tolist() for g in got] == [enc.encode_ordinary(t) for t in texts[s : s + 100]]
            assert len(encoder.old) + len(encoder.new) < max(most, 50_000)


def test_quality_brute(spark):
    import math
    from collections import Counter

    rng = random.Random(5)
    texts = [words(rng, rng.randint(1, 40)) for _ in range(40)] + [None, "", "  "]
    labels = spark.createDataFrame([(i, 1 if i < 15 else 0, 0) for i in range(30)] + [(None, 1, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(docs(spark, texts), labels, buckets=1024).collect()}
    grams = []
    for t in texts:
        b, _ = quality.grams([t], 1024)
        grams.append(b.tolist())
    raw, good = Counter(b for g in grams for b in g), Counter(b for g in grams[:15] for b in g)
    n, m = sum(raw.values()), sum(good.values())
    for i, g in enumerate(grams):
        if not g:
            assert got[i].score is None and not got[i].keep
            continue
        want = sum(round((math.log((good[b] + 1) / (m + 1024)) - math.log((raw[b] + 1) / (n + 1024))) * 1e6) for b in g) / len(g) / 1e6
        assert abs(got[i].score - want) < 1e-9 and got[i].keep == (got[i].score >= quality.THRESHOLD)


@pytest.mark.parametrize("range_bytes", [100, 1 << 20])
def test_warc(spark, tmp_path, range_bytes):
    evil = "x WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    rows = [(i, f"http://u/{i}%0A", (evil * (i % 4) + "é" * i) if i % 7 else None, "p") for i in range(60)] + [(None, None, "", "p"), (5, "a\nb", evil, "p"), (5, "a\nb", evil, "p")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, path string").repartition(3)
    files = warc.write_warc(d, f"file://{tmp_path}/w")
    got = warc.read_warc(files, range_bytes).filter("type = 'response'").select("page_id", "url", "html").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(r[:3]) for r in rows)
    assert warc.candidates(files, range_bytes).count() > len(rows)
    assert warc.read_warc(files.limit(0)).count() == 0


@pytest.mark.parametrize("range_bytes", [5000, 1 << 20])
def test_warc_long_headers(spark, tmp_path, range_bytes):
    rows = [(5, " http://s p/ ", "q"), (6, "\thttp://%20\r\n", ""), (0, "http://a", "x"), (1, "http://u/" + "a" * 100_000, "y"), (2, "%" * 100_000, "z" * 70_000), (3, "http://b", "WARC/1.0\r\n" * 9000), (4, "http://c", None)]
    files = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w")
    got = warc.read_warc(files, range_bytes).filter("type = 'response'").select("page_id", "url", "html").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rows, key=repr)


def test_html(spark):
    rng = random.Random(8)

    def page(tag="article"):
        nav = "".join(f'<li><a href="/{words(rng, 1)}">{words(rng, 1)}</a></li>' for _ in range(6))
        body = "".join(f"<p>{words(rng, rng.randint(8, 60))}.</p>" for _ in range(rng.randint(2, 7)))
        main = f"<{tag}><h1>{words(rng, 6)}</h1>{body}</{tag}>"
        return f'<html><head><title>t</title><script>var t="</p>";</script></head><body><nav><ul>{nav}</ul></nav><div class="ad">{words(rng, 9)}.</div>{main}<footer>&copy; {words(rng, 12)}.</footer></body></html>', html_text.text_of(html_text.parse(main)[:1])

    model = html_text.fit_pages([page()[0] for _ in range(150)])
    held = [page("div") for _ in range(60)]
    got = html_text.extract_pages([h for h, _ in held], model)
    assert sum(g[0] == w for g, (_, w) in zip(got, held)) >= 54
    odd = [None, "", "<", "<p>a<p>b</i></x>", "text only", "<div>" * 3000 + "deep", "<!-- open", "&lt;b&gt; &amp;", page()[0]]
    d = spark.createDataFrame([(i, h, 1) for i, h in enumerate(odd)], "page_id bigint, html string, text int")
    found = {r.page_id: r.text for r in html_text.extract(d, None).collect()}
    assert found[0] is None and found[1] == "" and found[4] == "text only" and found[5] == "deep" and found[7] == "<b> &" and found[3] == "a\nb"
    assert html_text.extract(d, html_text.fit_on(d)).count() == len(odd) and html_text.extract(d.limit(0), model).count() == 0
    # siblings of one tag are counted among any number
    many = html_text.parse("<div>" + "<p>a</p><b>c</b>" * 60 + "</div>")
    assert set(html_text.features(many)[2:, 14]) == {60.0}
    import time

    began = time.time()
    for page_ in ("<a b " * 200_000, "<p>" * 100_000 + "x", '<a "' * 150_000, "<a '>\"" * 100_000, "<" * 500_000, "x" * 1_000_000, "<!" * 300_000, "<a class=" + " " * 500_000 + ">t"):
        html_text.parse(page_)
    assert time.time() - began < 20
    assert html_text.text_of(html_text.parse('<a href="x>y">z</a> 1 < 2 <b title="open>u</b>')[:1]) == "z 1 < 2 u"
    # no kept subtree holds another
    nodes = html_text.parse(held[0][0])
    kept = html_text.decode(nodes, np.random.default_rng(0).random(len(nodes)))
    for k in kept:
        up = k.parent
        while up:
            assert up not in kept
            up = up.parent


def jaccard_pairs(texts, t, n=2):
    sets = {}
    for i, x in enumerate(texts):
        w = (x or "").lower().split()
        if w:
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or {tuple(w)}
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


def near_texts():
    rng = random.Random(6)
    base = [words(rng, rng.randint(1, 60)) for _ in range(40)]
    passage = words(rng, 55)
    texts = base + [f"{words(rng, 50)} {passage} {words(rng, 40)}" for _ in range(15)]
    for b in base[:12]:
        for _ in range(rng.randint(1, 8)):
            w = b.split()
            for _ in range(rng.randint(0, 1 + len(w) // 8)):
                w[rng.randrange(len(w))] = words(rng, 1)
            texts.append(" ".join(w))
    return [*texts, None, "", "   ", "One", "one", "ONE ", "two words", "Two Words", base[0] + " " + words(rng, 3000), base[0], base[0]]


def links_and_classes(texts, ids=None):
    """{id: (class, links)} by brute force over the different sets of each id."""
    ids = ids or list(range(len(texts)))
    entries = sorted({(i, frozenset(x)) for i, x in ((i, set_of(t)) for i, t in zip(ids, texts)) if x}, key=lambda e: e[0])
    links, group = dict.fromkeys(ids, 0), {i: i for i in ids}
    for a, (i, x) in enumerate(entries):
        for j, y in entries[a + 1 :]:
            if i != j and len(x & y) >= 0.6 * len(x | y) - 1e-12:
                links[i] += 1
                links[j] += 1
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    return {i: (group[i], links[i]) for i in ids}


def set_of(text, n=2):
    w = (text or "").lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("block", [3000, 7])
def test_ngram_join(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BROADCAST_COPIES", block // 1000)
    monkeypatch.setattr(common, "HOT", block // 3)
    texts = near_texts()
    d = docs(spark, texts)
    got = {r.doc_id: (r.class_id, r.links) for r in ngram_join.similar_classes(d).collect()}
    assert got == links_and_classes(texts)
    pairs = {(r.a, r.b): r.jaccard for r in ngram_join.similar_pairs(d).collect()}
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(frozenset(set_of(t)), i)
    want = {k: v for k, v in jaccard_pairs(texts, 0.6).items() if all(first[frozenset(set_of(texts[i]))] == i for i in k)}
    assert pairs.keys() == want.keys() and all(abs(pairs[k] - want[k]) < 1e-9 for k in pairs)


def test_ngram_join_repeats(spark):
    """Repeated rows, one id with several texts, null ids, ids that aren't numbers."""
    texts = near_texts()
    ids = list(range(len(texts)))
    texts, ids = texts + texts[:20] + ["other words here"] * 2 + [texts[3]], ids + ids[:20] + [4, 4, 9]
    d = docs(spark, texts).join(spark.createDataFrame(list(enumerate(ids)), "doc_id bigint, new bigint"), "doc_id").withColumn("doc_id", F.col("new")).drop("new")
    d = d.unionByName(docs(spark, ["x y", None]).withColumn("doc_id", F.lit(None).cast("bigint")))
    rows = ngram_join.similar_classes(d).collect()
    got = {r.doc_id: (r.class_id, r.links) for r in rows if r.doc_id is not None}
    assert got == links_and_classes(texts, ids) and [(r.class_id, r.links) for r in rows if r.doc_id is None] == [(None, 0)] * 2
    kept = [r.doc_id for r in ngram_join.keep_one(d).collect()]
    assert set(kept) - {None} == {i for i, (c, _) in got.items() if c == i} and kept.count(None) == 2 and kept.count(0) == 1
    with pytest.raises(TypeError):
        ngram_join.similar_classes(d.withColumn("doc_id", F.col("doc_id").cast("string")))
    assert ngram_join.similar_classes(docs(spark, [])).count() == 0


def test_keep_one(spark):
    texts = near_texts()
    d = docs(spark, texts)
    group = list(range(len(texts)))
    for a, b in jaccard_pairs(texts, 0.6):
        x, y = group[a], group[b]
        group = [min(x, y) if g in (x, y) else g for g in group]
    kept = ngram_join.keep_one(d)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == set(group)
    assert ngram_join.keep_one(docs(spark, [])).count() == 0
    # rows without an id stay
    assert ngram_join.keep_one(d.withColumn("doc_id", F.lit(None).cast("bigint"))).count() == len(texts)


def test_blocks_skip_nothing():
    rng = np.random.default_rng(2)
    for _ in range(30):
        m = int(rng.integers(33, 700))
        size = np.sort(rng.integers(1, 60, m))
        pos = rng.integers(0, size)
        bound = np.minimum((size - pos)[:, None], (size - pos)[None, :])
        ok = (bound >= ngram_join._need(size[:, None], size[None, :], 0.6)) & (np.minimum(size[:, None], size[None, :]) >= 0.6 * np.maximum(size[:, None], size[None, :]) - 1e-9) & ~np.eye(m, dtype=bool)
        assert (ngram_join._blocks_with_pairs(size, pos, 0.6) == ok.any(1)).all()
