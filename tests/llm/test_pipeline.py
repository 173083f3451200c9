"""The pipeline's stages: decisions take effect, columns stay, planted cases are caught."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    clean = [" ".join(word() for _ in range(80)) for _ in range(120)]
    junk = [" ".join(word() + "###" for _ in range(80)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(clean + junk)]
    near = " ".join(["other", *clean[0].split(" ")[1:]])
    passage = " ".join(word() for _ in range(20))
    rows += [(300, clean[0]), (301, near), (302, clean[1] + " " + passage + " " + clean[2])]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids, d = [], docs
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, d, str(tmp_path)).write.parquet(f"{tmp_path}/out/{k}")
        d = spark.read.parquet(f"{tmp_path}/out/{k}")
        if k < len(pipeline.STAGES) - 1:
            assert d.columns == pipeline.COLUMNS
        ids.append({x.doc_id for x in d.select("doc_id").collect()})
    quality, near_, bench, mix, shards = ids
    assert {i for i in range(120, 180)}.isdisjoint(quality) and set(range(120)) <= quality
    assert quality - near_ == {300, 301} and near_ - bench == {302}
    assert mix <= bench and shards == mix
    assert {x.doc_id for x in pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == shards


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_mix_keeps_rows_without_an_id_of_their_own(spark, tmp_path):
    from docgraph.llm import mixing

    rows = [(None if i % 5 == 0 else i // 2 if i % 5 == 1 else i, " ".join(["w"] * (i + 1)), "en", f"s{i % 2}", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    expect = Counter()
    for r in mixing.mix(docs).collect():  # sizes differ, so each tells its row
        expect[r.doc_id, r.size] += -(-r.taken // r.size)
    out = pipeline.mixed(spark, docs, str(tmp_path))
    assert out.columns == pipeline.COLUMNS
    got = Counter((r.doc_id, len(r.text.split(" "))) for r in out.collect())
    assert got == +expect and {i for i, _ in got} >= {None}
    assert len({got[i, n] for i, n in expect}) > 1


def test_mix_is_in_the_order_of_the_schedule(spark, tmp_path):
    rows = [(i, " ".join(["w"] * 50), "en", f"s{i % 3}", 0) for i in range(600)]
    out = pipeline.mixed(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()
    where = {s: [k for k, r in enumerate(out) if r.source == s] for s in ("s0", "s1", "s2")}
    for own in where.values():  # each source is spread over the whole mix
        assert max(b - a for a, b in zip([-1, *own], [*own, len(out)], strict=True)) < 30


def test_shards_keep_the_order_of_the_mix(spark, tmp_path):
    """Copies that the mix makes of a document lie apart, and the sources of every shard are mixed."""
    rows = [(i, f"{i} " + " ".join(["w"] * 50), "en", "abc"[0 if i < 60 else 1 if i < 500 else 2], 0) for i in range(1000)]
    pipeline.mixed(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).write.parquet(str(tmp_path / "mix"))
    mix = spark.read.parquet(str(tmp_path / "mix"))
    out = pipeline.sharded(spark, mix, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in mix.collect())
    line = sorted(out, key=lambda r: (r.shard, r.slot))
    places = {}
    for k, r in enumerate(line):
        places.setdefault(r.doc_id, []).append(k)
    repeated = [p for p in places.values() if len(p) > 1]
    assert len(repeated) > 30
    assert sum(any(b - a == 1 for a, b in zip(p, p[1:], strict=False)) for p in repeated) <= len(repeated) // 10
    sizes = Counter(r.shard for r in out)
    assert sorted(sizes) == list(range(40)) and all({r.slot for r in out if r.shard == s} == set(range(n)) for s, n in sizes.items())


def test_shards_follow_a_given_order(spark):
    from docgraph.llm import sharding

    d = spark.range(4000).selectExpr("id AS doc_id", "'the same text' AS text", "if(id < 3000, id, id * 1000000) AS at").repartition(5)
    out = sorted(sharding.assign(d, shards=8, ranges=16, keep=("at",), order="at").collect(), key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in out] == list(range(4000))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    labels = [(i, int(i % 3 > 0), 0) for i in range(300, 480)]
    texts = {i: " ".join(word() + ("" if q else "###") for _ in range(80)) for i, q, _ in labels}
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(word() for _ in range(12)))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), texts, word


def test_stages_on_odd_rows(spark, folder):
    """Null ids and texts, repeated rows, ids with several texts, ties: no clean row goes but copies and what the mix leaves out."""
    d, texts, word = folder
    good = [t for t in texts.values() if "#" not in t]
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    odd = [(None, good[0] + " own words here", None, None, None), (None, None, "en", None, 0), (1, "", "en", "s", 0), (2, " ".join(word() for _ in range(90)), None, "t", 0)]
    odd += [odd[3], odd[3], (2, " ".join(word() for _ in range(90)), None, None, 0), (3, " ".join(word() for _ in range(60_000)), "en", "s", 0)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    stage = lambda name, x: dict(pipeline.STAGES)[name](spark, x, d)
    q = stage("quality classifier", docs).collect()
    ids = Counter(r.doc_id for r in q)
    assert ids[2] == 4 and ids[3] == 1 and not any("###" in (r.text or "") for r in q)
    n = stage("minhash near-dedup", docs).collect()
    assert Counter(r.doc_id for r in n)[None] == 2 and Counter(r.doc_id for r in n)[2] == 4
    item = spark.read.parquet(f"{d}/benchmark.parquet").first().text
    hit = spark.createDataFrame([(None, f"{item} x", "en", "s", 0), (None, "free", "en", "s", 0), (5, item.upper(), "en", "s", 0), (5, "free", "en", "s", 0), (None, None, None, None, None)], SCHEMA)
    assert Counter((r.doc_id, r.text) for r in stage("benchmark decontamination", hit).collect()) == Counter([(None, "free"), (5, "free"), (None, None)])
    s = stage("sharding", docs).collect()
    assert len(s) == len(rows + odd) and Counter(r.doc_id for r in s)[None] == 2


def test_run_on_odd_rows(spark, folder, tmp_path):
    """The whole pipeline over nulls, repeated rows, near copies, a benchmark passage and an id with several texts."""
    import shutil

    d, texts, word = folder
    shutil.copytree(d, tmp_path / "t")
    item = spark.read.parquet(f"{d}/benchmark.parquet").first().text
    good = [" ".join(word() for _ in range(120)) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()] + [(1000 + i, t, "fr", f"s{i % 3}", 0) for i, t in enumerate(good)]
    rows += [(2000 + i, f"{t} {word()}", None, None, None) for i, t in enumerate(good[:10])]  # near copies
    rows += [(3000, f"{good[11]} {item}", "en", "s1", 0), (None, None, None, None, None), (None, " ".join(word() for _ in range(90)), "en", "s2", 0), (4000, "", "en", "s0", 0)]
    rows += [(5000, " ".join(word() for _ in range(90)), "en", "s0", 0), rows[0], (5000, " ".join(word() for _ in range(90)), "en", "s1", 0)]
    spark.createDataFrame(rows, SCHEMA).withColumn("slot", F.lit("a column of that name")).write.parquet(str(tmp_path / "t/documents.parquet"))
    out = pipeline.run(spark, str(tmp_path / "t")).collect()
    ids = {r.doc_id for r in out}
    assert not any("#" in texts.get(i, "") for i in ids) and not ids & {3000, *range(2000, 2010)}
    assert ids >= {None, 5000} and len(ids & set(range(1000, 1060))) > 30
    for s in {r.shard for r in out}:
        own = sorted(r.slot for r in out if r.shard == s)
        assert own == list(range(len(own)))


def test_stages_on_empty_tables(spark, folder):
    nothing = spark.createDataFrame([], SCHEMA)
    for name, stage in pipeline.STAGES:
        out = stage(spark, nothing, folder[0])
        assert out.count() == 0 and (name == "sharding" or out.columns == pipeline.COLUMNS)
