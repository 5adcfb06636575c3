"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows and extra columns."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import (
    common,
    decontaminate,
    fingerprints,
    graph,
    line_dedup,
    ngram_join,
    packing,
    sharding,
    suffix_dedup,
    token_counts,
    toxicity,
    warc,
)
from plumbline.llm.queries import tokenizer_path
from plumbline.llm.shingles import shingles

FORM = "doc_id long, text string, lang string, row string, w string, l string"
LOREM = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega "
         "Été ñandú straße ÀÉ 12 3x").split()


def prose(rng, n):
    return " ".join(rng.choice(LOREM) + rng.choice(["", ".", ",", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [prose(rng, rng.randint(1, 160)) for _ in range(40)]
    near = [b + " " + prose(rng, 3) for b in base[:12]]
    joined = [base[i] + "\n" + base[20] for i in range(5)]
    return [*base, *near, *joined, base[0], base[0], base[1], None, "", "", " \n ", "x", prose(rng, 9000), "é" * 300, "é" * 300]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "extra", "w", "l") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, FORM).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], FORM)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, and whole rows repeated."""
    rows = [(None, "one two three four five six", "a", "b", "w", "l"), (7, "same text here", "a", "b", "w", "l"), (7, "same text here", "a", "b", "w", "l"),
            (7, "another text here", "a", "b", "w", "l"), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, FORM)


def sets(text, width=5):
    w = words(text)
    return set(zip(*[w[i:] for i in range(width)], strict=False)) if len(w) >= width else ({tuple(w)} if w else set())


# -- 1 --------------------------------------------------------------------------

def test_shingle_hashes_match_sets(texts):
    every = [t or "" for t in texts]
    h, at = shingles(pa.array(every))
    seen = {}
    for i, t in enumerate(every):
        mine = h[at[i]:at[i + 1]]
        assert len(set(mine.tolist())) == len(sets(t))
        for x in set(mine.tolist()):
            seen.setdefault(x, set()).add(i)
    for i, a in enumerate(every):
        for j in range(i):
            both = sum(1 for x in set(h[at[i]:at[i + 1]].tolist()) if j in seen[x])
            assert both == len(sets(a) & sets(every[j]))


def test_edited_pairs(docs, texts):
    got = {r["doc_id"]: r for r in fingerprints.edited_pairs(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, n = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + n[:half]
        a, b, c = sets(t), sets(edited), sets(n)
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for name, other in (("near_edited", b), ("near_next", c)):
            true = len(a & other) / len(a | other) if a | other else 1.0
            assert got[i][name] == pytest.approx(true, abs=0.2 if len(a | other) > 128 else 1e-12)
    assert got[0]["fingerprint"] == got[texts.index(texts[0], 1)]["fingerprint"]


def test_fingerprints_merge(spark, docs, texts):
    every = fingerprints.fingerprint(docs.withColumn("part", F.col("doc_id") % 3)).join(docs.select("doc_id", (F.col("doc_id") % 3).alias("part")), "doc_id")
    got = {r["part"]: r for r in fingerprints.merge_fingerprints(every, "part").collect()}
    for p in range(3):
        h, _ = shingles(pa.array([t or "" for i, t in enumerate(texts) if i % 3 == p]))
        assert fingerprints.decode(got[p]["fingerprint"]).tolist() == np.unique(h)[:fingerprints.K].tolist()
        assert got[p]["n_distinct"] == pytest.approx(len(np.unique(h)), rel=0.35)


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 1.0])
def test_containment_of_large_sets(share):
    """The mean of 30 estimates is near the truth: one has a standard error of about 0.1."""
    found = []
    for seed in range(30):
        rng = np.random.default_rng(seed)
        a, b = (rng.integers(0, 2**64, 4000, dtype=np.uint64) for _ in "ab")
        both = np.concatenate([a[:int(4000 * share)], b])
        found.append(fingerprints.containment(fingerprints.merge([a]), fingerprints.merge([both])))
    assert np.mean(found) == pytest.approx(share, abs=0.06)


def test_containment_of_small_sets_is_exact():
    a, b = np.arange(1, 51, dtype=np.uint64), np.arange(31, 71, dtype=np.uint64)
    assert fingerprints.containment(a, b) == pytest.approx(20 / 50) and fingerprints.containment(b, a) == pytest.approx(20 / 40)


def test_each_range_has_its_own_task(spark):
    """Ranges of ids are dealt one to one, so the largest task holds about a mean range."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three four five six").alias("text"))
    parts = fingerprints.edited_pairs(docs).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) == common.partitions(spark) and max(r["count"] for r in parts) < 1.5 * 4000 / len(parts)


def test_edited_pairs_edge_cases(empty, odd):
    assert fingerprints.edited_pairs(empty).count() == 0
    assert fingerprints.edited_pairs(odd).count() == 5
    one = fingerprints.edited_pairs(odd.limit(1)).first()
    assert one["near_next"] == 1.0


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_range_bucket(spark, n):
    rng = random.Random(n)
    bounds = sorted(rng.sample(range(1000), n))
    rows = spark.createDataFrame([(v,) for v in [None, -5, *range(0, 1100, 7), *bounds]], "v long")
    got = rows.select("v", common.range_bucket(F.col("v"), bounds).alias("b")).collect()
    assert all(r["b"] == common.bucket_of(r["v"], bounds) for r in got)


# -- 2 --------------------------------------------------------------------------

def labelled(spark, n=600, seed=1):
    rng = random.Random(seed)
    bad = ["grizzle", "snorkel", "blatherous"]
    rows, labels = [], []
    for i in range(n):
        w = prose(rng, 40).split()
        y = i % 4 == 0
        if y:
            for b in rng.sample(bad, 2):
                w.insert(rng.randrange(len(w)), b)
        rows.append((i, " ".join(w), "en", "e", "w", "l"))
        labels.append((i, int(y)))
    return spark.createDataFrame(rows, FORM), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark)
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in got) and held
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = labelled(spark, 200)
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r["doc_id"], r["score"]) for r in toxicity.toxicity(docs, y).collect()) for y in (labels, flipped))
    assert a == b


def test_block_max_search_is_exact(spark):
    docs, labels = labelled(spark, 500, 3)
    model = toxicity.fit(docs, labels)
    dense = np.zeros((len(model.ids), len(model.words) + 1))
    for w, (e, v, _, _) in enumerate(model.postings):
        dense[e, w] = v
    dense[:, -1] = model.rest
    for r in docs.limit(60).collect():
        found, value = model.vector(r["text"])
        q = np.zeros(len(model.words) + 1)
        q[found] = value
        scores = dense @ q
        order = np.lexsort((np.arange(len(scores)), -scores))[:10]
        order = order[scores[order] > 0]
        e, s = model.nearest(found, value, 10)
        assert np.allclose(s, np.minimum(scores[order], 1)) and set(np.round(scores[e], 9)) == set(np.round(scores[order], 9))


def test_toxicity_finds_cosines_over_all_words(spark):
    """Copies of examples and texts without a word that tells the classes apart have neighbours, too."""
    docs, labels = labelled(spark, 300, 5)
    rng = random.Random(6)
    plain = [(1000 + i, prose(rng, 30) + f" rare{i % 3} only{i}", "en", "e", "w", "l") for i in range(30)]
    copies = docs.where("doc_id < 30").withColumn("doc_id", F.col("doc_id") + 2000)
    docs = docs.union(spark.createDataFrame(plain, FORM)).union(copies)
    rows = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    words = {r["doc_id"]: collections.Counter(re.findall(r"[^\W_]+", r["text"].lower())) for r in docs.collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    begun = {i: collections.Counter({f: sum(n for w, n in c.items() if w.startswith(f[:-1])) for f in {w[:k] + "*" for w in c for k in range(4, 9) if len(w) >= k}})
             for i, c in words.items()}
    n1 = sum(toxic.values())
    n0 = len(toxic) - n1
    have = [collections.Counter(f for i, y in toxic.items() if y == c for f in begun[i]) for c in (0, 1)]

    def goes_with_the_label(f):
        a, c = have[1][f], have[0][f]
        out = n0 + n1 - a - c
        return a + c >= 3 and out > 0 and (n0 + n1) * (a * (n0 - c) - c * (n1 - a)) ** 2 / ((a + c) * out * n0 * n1) >= toxicity.MIN_CHI2

    marks = {f for f in have[0].keys() | have[1].keys() if goes_with_the_label(f)}
    assert marks
    words = {i: c + collections.Counter({f: n for f, n in begun[i].items() if f in marks}) for i, c in words.items()}
    df = collections.Counter(w for c in words.values() for w in c)
    weigh = {i: {w: (1 + np.log(n)) * (np.log((1 + len(words)) / (1 + df[w])) + 1) for w, n in c.items()} for i, c in words.items()}
    size = {i: np.sqrt(sum(x * x for x in v.values())) for i, v in weigh.items()}
    assert rows.keys() == words.keys()

    def cosines(i):
        return {e: sum(x * weigh[e].get(w, 0) for w, x in weigh[i].items()) / size[i] / size[e] for e in toxic if e != i or i >= 1000}

    base = (n1 + 1) / (n0 + n1 + 2)

    def vote(cosine):
        best = sorted(((c, toxic[e]) for e, c in cosine.items() if c > 0), reverse=True)[:toxicity.NEIGHBOURS]
        yes, no = sum(c for c, y in best if y) + toxicity.PRIOR_VOTES * base, sum(c for c, y in best if not y) + toxicity.PRIOR_VOTES * (1 - base)
        return np.log(max(yes, 1e-9) / max(no, 1e-9))

    x, y = np.array([[vote(cosines(e)), 1.0] for e in toxic]), np.array(list(toxic.values()), float)
    fit = np.array([1.0, 0.0])
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ fit))
        fit = fit - 0.5 * np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - y) + 1e-3 * (fit - [1.0, 0.0]))
    assert fit[0] > 0
    for i in weigh:
        cosine = {e: c for e, c in cosines(i).items()} | ({i: 1.0} if i in toxic else {})
        best = sorted((c for c in cosine.values() if c > 0), reverse=True)[:toxicity.NEIGHBOURS]
        assert rows[i]["cosines"] == pytest.approx(best)
        assert [cosine[e] for e in rows[i]["evidence"]] == pytest.approx(rows[i]["cosines"])
        voted = sum(c * toxic[e] for e, c in zip(rows[i]["evidence"], rows[i]["cosines"], strict=True)) + toxicity.PRIOR_VOTES * base
        z = np.log(max(voted, 1e-9) / max(sum(rows[i]["cosines"]) + toxicity.PRIOR_VOTES - voted, 1e-9))
        assert rows[i]["score"] == pytest.approx(1 / (1 + np.exp(-(fit[0] * z + fit[1]))), abs=0.02)
    for i in range(2000, 2030):
        assert rows[i]["cosines"][0] == pytest.approx(1) or i - 2000 not in toxic


def test_toxicity_learns_from_all_bounded_examples(spark):
    rows = [(i, f"shared word{i % 7}" + (" vile" if i % 10 == 0 else ""), "en", "e", "w", "l") for i in range(4500)]
    labels = spark.createDataFrame([(r[0], int(r[0] % 10 == 0)) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(rows, FORM), labels)
    assert sorted(model.ids) == [r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5]


def test_toxicity_edge_cases(spark, docs, empty, odd):
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(empty, labels).count() == 0
    for y in (labels, none):
        for d in (docs, odd):
            assert all(0 <= r["score"] <= 1 for r in toxicity.toxicity(d, y).collect())
    assert toxicity.keep_clean(odd, none).columns == odd.columns


def test_stage_of_toxicity_leaves_no_broadcasts(spark, monkeypatch):
    """What tasks were sent is destroyed once the verdicts are saved, and the driver holds no words while it makes the index."""
    import os

    rows = [(i, f"shared word{i % 7}" + (" vile" if i % 3 == 0 else ""), "en", "e", "w", "l") for i in range(60)]
    labels = spark.createDataFrame([(r[0], int(r[0] % 3 == 0)) for r in rows], "doc_id long, toxic int")
    folder, held, index = spark.sparkContext._temp_dir, [], toxicity.index_examples
    monkeypatch.setattr(toxicity, "index_examples", lambda model, *a: held.append(len(model.words)) or index(model, *a))
    had = set(os.listdir(folder))
    kept = toxicity.keep_clean(spark.createDataFrame(rows, FORM), labels)
    assert set(os.listdir(folder)) <= had and held == [0]
    assert sorted(r["doc_id"] for r in kept.collect()) == [r[0] for r in rows if r[0] % 3]


def test_toxicity_makes_postings_in_little_memory():
    """Making what a search reads takes few bytes a posting beside the blocks, and it holds each posting once."""
    import tracemalloc

    rng, n, n_words = np.random.default_rng(5), 3000, 20_000
    own = [np.unique((n_words * rng.random(400)**3).astype(np.int64)) for _ in range(n)]
    number = np.bincount(np.concatenate(own), minlength=n_words)
    rank = np.empty(n_words, np.int64)
    rank[np.argsort(-number, kind="stable")] = np.arange(n_words)  # words are numbered by falling number of examples
    own = [np.sort(rank[w]) for w in own]
    own[2000] = own[7]
    word = np.concatenate(own).astype(np.int32)
    count = rng.integers(1, 9, len(word)).astype(np.uint8)
    at = np.concatenate([[0], np.cumsum([len(w) for w in own])])
    count[at[2000]:at[2001]] = count[at[7]:at[8]]
    model = toxicity.Index(idf=1 + rng.random(n_words), ids=np.arange(n), at=at, word=word, count=count)
    tracemalloc.start()
    try:
        made = model.ready()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert made.frequent > 20 and peak < made.blocks.nbytes + 16 * len(word) + 48 * n_words
    assert len(made.example) == len(made.weight) == (word >= made.frequent).sum()
    assert made.same[2000] == 7 and len(set(made.same)) == n - 1
    for w, (e, v, _, _) in enumerate(model.postings):
        a, b = made.at[w:w + 2] - made.at[made.frequent]
        if w < made.frequent:
            assert np.array_equal(np.flatnonzero(made.blocks[:, w]), e) and np.array_equal(made.blocks[e, w], v.astype(np.float32))
        else:
            assert np.array_equal(made.example[a:b], e) and np.array_equal(made.weight[a:b], v.astype(np.float32))


def test_toxicity_reads_few_texts_at_once():
    """Features come in small batches, whatever Spark hands over, as a text's words take several times its room."""
    class Rows:
        columns, schema = ["id", "text"], []

        def mapInArrow(self, run, form):
            return run

    class Sent:
        value = ({"a": 0, "b": 1}, {}, set(), np.zeros(3, np.int64), np.zeros(0, np.int64))

    texts = [f"a w{i}" if i % 2 else None for i in range(2000)]
    got = list(toxicity.features(Rows(), Sent())(iter([pa.record_batch([pa.array(range(2000)), pa.array(texts)], ["id", "text"]),
                                                       pa.record_batch([pa.array([], pa.int64()), pa.array([], pa.string())], ["id", "text"])])))
    assert max(len(b) for b in got) <= toxicity.TOGETHER
    assert [i for b in got for i in b.column("id").to_pylist()] == list(range(2000))
    assert [o for b in got for o in b.column("others").to_pylist()] == [[f"w{i}"] if i % 2 else [] for i in range(2000)]


# -- 3 --------------------------------------------------------------------------

def test_warc_round_trip(spark, tmp_path):
    pages = [(5, "http://a", "same"), (2, "http://b", "same"), (9, None, "same"), (3, "http://c\r\nX: y", ""), (4, "u", None), (6, "v", "é" * 1000), (None, "w", "same"), (8, "x", "ab"), (1, "y", "ab")]
    df = spark.createDataFrame([(*p, "extra", "d") for p in pages], "page_id long, url string, html string, digest string, header string")
    warc.write_archive(df, f"{tmp_path}/a")
    got = {r["page_id"]: r for r in warc.read_records(spark, f"{tmp_path}/a").collect()}
    assert len(got) == len(pages)
    for i, _, h in pages:
        raw = (h or "").encode()
        assert got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode() and got[i]["payload_bytes"] == len(raw)
        first = min(p[0] for p in pages if (p[2] or "") == (h or "") and p[0] is not None)
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if i == first else ("revisit", first))
    assert spark.read.parquet(f"{tmp_path}/a/payloads").count() == 4
    originals = {r["page_id"]: bytes(r["record"]) for r in warc.read_originals(spark, f"{tmp_path}/a").collect()}
    for i, record in originals.items():
        head, _, rest = record.partition(b"\r\n\r\n")
        length = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        assert record.startswith(b"WARC/1.1\r\n") and rest[length:] == b"\r\n\r\n"
        body = dict((p[0], (p[2] or "").encode()) for p in pages)[i]
        assert rest[:length].partition(b"\r\n\r\n")[2] == (body if got[i]["record_type"] == "response" else b"")


def test_warc_threshold_and_damage(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    warc.write_archive(df, f"{tmp_path}/b", revisit_bytes=3)
    assert {r["record_type"] for r in warc.read_records(spark, f"{tmp_path}/b").collect()} == {"response"}
    bad = spark.read.parquet(f"{tmp_path}/b/payloads").withColumn("payload", F.lit(b"xx"))
    bad = spark.createDataFrame(bad.collect(), bad.schema)
    bad.write.mode("overwrite").parquet(f"{tmp_path}/b/payloads")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_records(spark, f"{tmp_path}/b").collect()
    warc.write_archive(df.limit(0), f"{tmp_path}/c")
    assert warc.read_records(spark, f"{tmp_path}/c").count() == 0


# -- 4 and 10 -------------------------------------------------------------------

def strange(n, seed):
    rng = random.Random(seed)
    pool = [chr(c) for c in [*range(0x250), 0x3A3, 0x130, 0x2028, 0x85, 0xA0, 0x3000, 0x4E00, 0x1F600, 0x301, 0x1E9E, 0xFEFF, 0x660]]
    return ["".join(rng.choice(pool) if rng.random() < 0.4 else rng.choice("ab 're'll<|endoftext|>  \n") for _ in range(rng.randint(0, 30)))
            + rng.choice(["", "", "<|endoftext|>", "<|startoftext|>x"]) for _ in range(n)]


def test_ids_match_the_library(texts):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_path("byte_bpe_50k.json")
    encode, library = packing.encoder(path), tokenizers.Tokenizer.from_file(path)
    for t in [*strange(1500, 1), *(t or "" for t in texts)]:
        assert encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_counts_match_the_library(docs, texts):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_path("word_bpe_49k.json")
    merger, library = token_counts.PairMerger(path, cache_words=50), tokenizers.Tokenizer.from_file(path)
    newer = [f"a{chr(c)}b {chr(c)}" for c in token_counts.NEWER]
    for t in [*strange(1500, 2), *newer, "a" * 5000, "ab" * 3000]:
        assert merger.count(t) == len(library.encode(t, add_special_tokens=False).ids)
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs, path).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 2048)


def test_counts_edge_cases(empty, odd):
    path = tokenizer_path("word_bpe_49k.json")
    assert token_counts.token_counts(empty, path).count() == 0 and token_counts.token_counts(odd, path).count() == 5


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    counts = collections.Counter(rng.choice([rng.randint(1, 1024), rng.randint(1, 90), 1024, 512]) for _ in range(rng.choice([1, 5, 400, 5000])))
    patterns = packing.plan(dict(counts))
    used = collections.Counter()
    tokens = padded = 0
    for p in patterns:
        assert sum(p.lengths) <= p.size
        for n in p.lengths:
            used[n] += p.copies
        total = sum(p.lengths)
        tokens += total * p.copies
        padded += (1024 - total) * p.copies if total & (total - 1) else 0
        assert p.size == 1024 or total == p.size
    assert used == counts
    if sum(counts.values()) >= 400:
        assert padded / tokens < 0.02
    seen = collections.defaultdict(list)
    for n, low, high, *_ in packing.places(patterns):
        seen[n].append((low, high))
    for n, spans in seen.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == counts[n] - 1 and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_packing(spark, docs, texts):
    path = tokenizer_path("byte_bpe_50k.json")
    encode = packing.encoder(path)
    ids = {i: [*(encode(t).tolist() if t else []), 0] for i, t in enumerate(texts)}
    placed = packing.pack(docs, path)
    rows = placed.collect()
    covered = collections.defaultdict(list)
    windows = collections.defaultdict(list)
    for r in rows:
        part = np.array(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        covered[r["doc_id"]].append((r["start"], r["length"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"], r["window"], r["doc_id"], r["start"]))
    for i in ids:
        assert sum(n for _, n in covered[i]) == len(ids[i])
    got = {r["sequence_id"]: r["ids"] for r in packing.sequences(docs, placed, path).collect()}
    for s, parts in windows.items():
        parts.sort()
        at = 0
        for offset, n, size, *_ in parts:
            assert offset == at and size in packing.TIERS
            at += n
        assert at <= size
        assert got[s] == [x for _, n, _, i, start in parts for x in ids[i][start:start + n]]


def test_packing_edge_cases(empty, odd):
    path = tokenizer_path("byte_bpe_50k.json")
    assert packing.pack(empty, path).count() == 0 and packing.pack(odd, path).count() == 5


# -- 5 --------------------------------------------------------------------------

def kept_bytes(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "gram", "limit"), [(200, 64, 20_000), (60, 16, 20_000), (60, 16, 3)])
def test_suffix_dedup(docs, texts, length, gram, limit):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup_bytes(docs, length, gram, class_limit=limit).collect()}
    assert [got[i] for i in range(len(texts))] == kept_bytes(texts, length)


def test_induced_order_on_small_alphabets():
    rng = random.Random(3)
    for _ in range(60):
        length, gram = rng.choice([(20, 6), (24, 8), (40, 12)])
        letters = rng.choice([b"ab", b"abcdefghij", b"a", b"\x00\xff"])
        base = [bytes(rng.choice(letters) for _ in range(rng.randint(5, 120))) for _ in range(4)]
        texts = {b"".join(rng.choice(base)[rng.randint(0, 30):rng.randint(30, 120)] for _ in range(rng.randint(1, 4))) for _ in range(8)}
        texts = sorted(t for t in texts if len(t) >= length)
        count = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
        parts, seen = [], collections.Counter()
        for k, t in enumerate(texts):
            at, value, least = suffix_dedup.sampled(np.frombuffer(t, np.uint8), length, gram)
            owner = suffix_dedup.owners(at, value, least)
            seen.update(value.tolist())
            for w, a, n in zip(*np.unique(owner, return_index=True, return_counts=True), strict=True):
                parts.append((int(value[w]), k, int(at[w]), int(a), int(a + n - 1), t[a:a + n - 1 + length]))
        parts = [p for p in parts if seen[p[0]] > 1]
        got = set()
        if parts:
            group = np.unique([p[0] for p in parts], return_inverse=True)[1].astype(np.int64)
            at, low, high = (np.array([p[i] for p in parts]) for i in (2, 3, 4))
            found, d = suffix_dedup.repeated_windows([p[5] for p in parts], group, at - low, at - high, at - low, length)
            got = {(parts[i][1], int(at[i] - x)) for i, x in zip(found, d, strict=True)}
        assert got == {(k, i) for k, t in enumerate(texts) for i in range(len(t) - length + 1) if count[t[i:i + length]] > 1}


def test_suffix_dedup_of_periodic_runs(spark):
    rng = random.Random(8)
    base = ["a" * 200, "a" * 201, "a" * 3000, "b" * 200, "c" * 230, "ab" * 100, "ab" * 101, "xyz" * 500 + prose(rng, 60), prose(rng, 60) + "xyz" * 70,
            "é " * 400 + "a" * 260 + " \n" * 300, "q" + "a" * 250 + "q", "zx" * 150 + "a" * 199, " \n" * 103]
    df = spark.createDataFrame(list(enumerate(base)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup_bytes(df).collect()}
    assert [got[i] for i in range(len(base))] == kept_bytes(base, 200)


@pytest.mark.parametrize("run", ["a", "\n", "ab"])
def test_long_runs_sample_few_positions(run):
    data = np.frombuffer((run * 2_000_000).encode()[:2_000_000] + b"end", np.uint8)
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([data.tobytes()])], names=["text", "bytes"])
    rows = [b for b in suffix_dedup._samples(200, 64)([batch])]
    assert sum(len(b) for b in rows) < 400 and rows[-1].column("stop").to_pylist() == [2_000_000]


def test_suffix_dedup_edge_cases(empty, odd):
    assert suffix_dedup.dedup_bytes(empty).count() == 0
    assert sorted(r["n_removed"] for r in suffix_dedup.dedup_bytes(odd, 10, 4).collect()) == [0, 0, 10, 14, 14]


# -- 6 --------------------------------------------------------------------------

@pytest.mark.parametrize("bucket_bytes", [10**9, 700])
def test_sharding(docs, texts, bucket_bytes):
    rows = sharding.shuffle_shards(docs, 7, bucket_bytes=bucket_bytes).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in rows) == [(i, t or "") for i, t in enumerate(texts)]
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    again = sharding.shuffle_shards(docs.repartition(3), 7, bucket_bytes=bucket_bytes).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert order != sorted(order)


def test_sharding_edge_cases(empty, odd, tmp_path):
    assert sharding.shuffle_shards(empty, 24).count() == 0
    assert sharding.shuffle_shards(odd, 24).columns == [*odd.columns, "shard", "slot"] and sharding.shuffle_shards(odd, 24).count() == 5
    sharding.write_shards(odd, f"{tmp_path}/s", shards=2)
    assert odd.sparkSession.read.parquet(f"{tmp_path}/s").count() == 5


def test_shards_split_repeated_rows(spark):
    rows = [(1, "same row " * 20)] * 400 + [(i, f"other {i}") for i in range(2, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = collections.Counter()
    keyed = sharding.shuffle_shards(df, shards=4, bucket_bytes=8_000)
    got = keyed.collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter(rows)
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in range(4) for k in range(len(rows) * (s + 1) // 4 - len(rows) * s // 4)]
    counts.update(r["shard"] for r in got if r["doc_id"] != 1)
    assert len(counts) == 4  # the copies do not lie together


@pytest.mark.parametrize("run", ["\n", " ", "a", "ab", "é "])
def test_packing_of_very_long_runs_equals_the_library(run):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    text = "Begin " + run * (1_100_000 // len(run)) + " end"
    assert packing.encoder(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


# -- 7 --------------------------------------------------------------------------

def components_of(n, links):
    label = list(range(n))
    for a, b in sorted(links) * 4:
        label[a] = label[b] = min(label[a], label[b])
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("block", [384, 2])
def test_ngram_join(docs, texts, block):
    s = [sets(t) for t in texts]
    links = {(i, j) for i in range(len(s)) for j in range(i) if (texts[i] or "") == (texts[j] or "")
             or len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]) > 0}
    degree = collections.Counter(x for pair in links for x in pair)
    label = components_of(len(s), links)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.similar_texts(docs, block=block).collect()}
    assert got == {i: (label[i], degree[i]) for i in range(len(s))}
    kept = ngram_join.first_of_class(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label))


def test_texts_of_few_shingles_need_less_shortening():
    assert [ngram_join.needed(n, 0.8, 0.999) for n in (1, 3, 6, 8, 20)] == [8, 8, 7, 6, 6]


def test_ngram_join_edge_cases(empty, odd):
    assert ngram_join.similar_texts(empty).count() == 0
    assert ngram_join.similar_texts(odd).count() == 5
    assert ngram_join.first_of_class(odd).count() == 4
    assert ngram_join.prefix_length(0.8, 0.999) == 6


def test_unreachable_recall_is_an_error():
    assert ngram_join.prefix_length(0.3, 0.999) == 1
    with pytest.raises(ValueError):
        ngram_join.prefix_length(0.2, 0.999)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(5, 5)]
    got = {r["node"]: r["comp"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 60)}}


# -- 8 --------------------------------------------------------------------------

def lines_kept(texts, run=line_dedup.RUN, long_chars=line_dedup.LONG_CHARS):
    lines = [[x for x in (t or "").split("\n") if x.strip(" ")] for t in texts]
    first, out = {}, []
    grams = lambda ls: [(p, run, tuple(ls[p:p + run])) for p in range(len(ls) - run + 1)] + [(p, 1, (x,)) for p, x in enumerate(ls) if len(x) >= long_chars]
    for i, ls in enumerate(lines):
        for p, n, g in sorted(grams(ls)):
            first.setdefault((n, g), (i, p))
    for i, ls in enumerate(lines):
        gone = {q for p, n, g in grams(ls) if first[n, g] != (i, p) for q in range(p, p + n)}
        at, kept = -1, []
        for x in (texts[i] or "").split("\n"):
            if x.strip(" "):
                at += 1
                if at in gone:
                    continue
            kept.append(x)
        out.append((len(ls), len(gone), "" if gone and len(gone) == len(ls) else "\n".join(kept)))
    return out


def test_line_dedup(docs, texts):
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept"]) for r in line_dedup.dedup_lines(docs).select("row.doc_id", "n_lines", "n_removed", "kept").collect()}
    assert [got[i] for i in range(len(texts))] == lines_kept(texts)


def test_line_dedup_by_hand(spark, empty, odd):
    long = "long line " * 8
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, f"{long}\nz"), (4, f"q\n\n{long}"), (5, "a\nb"), (6, long), (7, "p\np\np\np\np\np")]
    got = {r["doc_id"]: (r["kept"], r["n_runs"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("row.*", "kept", "n_runs").collect()}
    assert got[1] == ("a\nb\nc\nd", 0) and got[2] == ("x\ny", 1) and got[3][1] == 0 and got[4] == ("q\n", 1)
    assert got[5] == ("a\nb", 0) and got[6] == ("", 1) and got[7] == ("p", 1)
    assert line_dedup.dedup_lines(empty).count() == 0 and line_dedup.dedup_lines(odd).count() == 5


# -- 9 --------------------------------------------------------------------------

def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(decontaminate.UPPER, decontaminate.LOWER)))


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontaminate(spark, docs, texts, limit):
    items = [(1, " ".join(words(texts[0])[3:30])), (2, "Straße, 12 3X"), (3, None), (4, "..."), (10, " ".join(words(texts[20])[:12])), (11, "never seen words here"), (12, "x")]
    table = spark.createDataFrame([(*i, "extra") for i in items], "item_id long, text string, word string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for p in range(max(1, len(w) - 9)) if w else []:
            windows[tuple(w[p:p + 10])].add(str(i))
    got = {r["k_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.decontaminate(docs, table, limit=limit).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        hit, found = set(), set()
        for k, ids in windows.items():
            for p in range(len(w) - len(k) + 1):
                if tuple(w[p:p + len(k)]) == k:
                    hit |= set(range(p, p + len(k)))
                    found |= ids
        assert got[i] == (len(w), len(hit), sorted(found))
    assert any(v[1] for v in got.values())


def test_decontaminate_edge_cases(spark, empty, odd):
    items = spark.createDataFrame([(1, "same text here")], "item_id long, text string")
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert decontaminate.decontaminate(odd, items.limit(0)).where("n_hit > 0").count() == 0
    assert [r["n_hit"] for r in decontaminate.decontaminate(odd, items).orderBy("n_hit").collect()] == [0, 0, 0, 3, 3]
