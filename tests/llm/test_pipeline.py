"""The pipeline's stages against plain versions of their decisions, on planted documents."""

import random
import zlib

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"
FORM = "doc_id long, text string, lang string, source string, n_chars long, row string, k1 string"
WORDS = [a + b + c for a in ("ba", "do", "fi", "gu") for b in ("la", "me", "no", "ri") for c in ("st", "ra", "vel", "ton", "x")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Documents, labels and items with cases of each stage, as a folder of tables; and which ids go where."""
    rng = random.Random(11)
    rows, toxic, i = [], set(), 0
    for _ in range(160):
        bad = i % 4 == 0
        rows.append((i, prose(rng, 60) + (" vileword cursedword" * 2 if bad else "")))
        toxic |= {i} if bad else set()
        i += 1
    base = prose(rng, 80)
    item = " ".join(rng.choice(WORDS) + "q" for _ in range(14))
    run = [prose(rng, 4) for _ in range(4)]
    special = {
        "first": base, "copy": base, "near": base + " " + prose(rng, 4), "leak": prose(rng, 40) + " " + item + " " + prose(rng, 30),
        "run": prose(rng, 50) + "\n" + "\n".join(run), "again": prose(rng, 50) + "\n" + "\n".join(run), "all": "\n".join(run),
        "null": None, "empty": "", "blank": " \n ", "word": "alone", "long": prose(rng, 12000)}
    names = {}
    for name, text in special.items():
        names[name] = i
        rows.append((i, text))
        i += 1
    rows.append(rows[1])  # a repeated row
    sf = str(tmp_path_factory.mktemp("planted"))
    full = [(d, t, "en", "s", len(t or ""), "r", "k") for d, t in rows] + [(None, prose(rng, 55), None, None, None, None, None)]
    spark.createDataFrame(full, FORM).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d in toxic)) for d, _ in rows[:160]], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([("b1", item), ("b2", "")], "item_id string, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, names, toxic, {d: t for d, t in rows}


def test_stages_decide_as_plain_versions(spark, planted):
    sf, at, toxic, texts = planted
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, made = docs.columns, {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.common.saved(stage(spark, docs, sf), name)
        made[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    ids = {name: sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) for name, rows in made.items()}
    everything = sorted([*texts, 1])
    held = {d for d in toxic if zlib.crc32(str(d).encode()) % 5 == 0}
    assert held and ids["toxicity"] == [d for d in everything if d not in toxic]
    clean = {r["doc_id"]: r for r in made["toxicity"]}
    assert all(clean[d]["text"] == texts[d] and clean[d]["row"] == "r" for d in ids["toxicity"])
    # the run's first occurrence stays, the second goes, and a document of nothing else goes
    assert ids["line_dedup"] == [d for d in ids["toxicity"] if d not in (at["all"],) and not (d == at["copy"] and len(texts[d]) >= 60)]
    kept = {r["doc_id"]: r for r in made["line_dedup"]}
    assert kept[at["run"]]["text"] == texts[at["run"]]
    assert kept[at["again"]]["text"] == texts[at["again"]].split("\n")[0] and kept[at["again"]]["n_chars"] == len(kept[at["again"]]["text"])
    # one of each group: by brute force over what the stage got
    group = {}
    for d in sorted(kept, key=lambda x: (x is None, x or 0)):
        mine = shingles(kept[d]["text"] or "")
        same = [g for g, s in group.items() if (kept[g]["text"] or "") == (kept[d]["text"] or "") or (mine and len(mine & s) >= 0.8 * len(mine | s))]
        if not same:
            group[d] = mine
    assert sorted((r["doc_id"] for r in made["ngram_join"]), key=str) == sorted(group, key=str)
    assert at["first"] in group and at["near"] not in group
    assert ids["decontamination"] == [d for d in ids["ngram_join"] if d != at["leak"]]
    tokens = {}
    for r in made["packing"]:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
        assert r["doc_tokens"] >= r["length"]
    assert set(tokens) == {r["doc_id"] for r in made["decontamination"]}
    assert all(tokens[r["doc_id"]] == r["doc_tokens"] for r in made["packing"])


def test_empty_tables(spark, planted, tmp_path):
    sf = planted[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = pipeline.run(spark, SF)
    assert 0 < got.select("doc_id").distinct().count() < docs.count()
    assert len(pipeline.STAGES) == 5
