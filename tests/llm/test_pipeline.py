"""The pipeline's stages on a small table, each on its predecessor's rows."""

from collections import Counter, defaultdict

from conftest import DOCS, documents, prose


def test_stages(spark, tmp_path):
    import corpus_pipeline

    rows = documents() + [(1000 + i, " ".join(f"{w.upper()}!!" for w in prose(80, i).split()), "en", "s0", 1, 0.0, 0) for i in range(60)] + [(2000 + i, prose(80, 900 + i), "en", "s1", 1, 0.0, 1) for i in range(150)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 0 if (r[0] or 0) // 1000 == 1 else 1, 0) for r in rows if r[0] and r[0] >= 1000], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/s{k}")
        docs = spark.read.parquet(f"{tmp_path}/s{k}")
        seen.append(docs.count())
    quality = {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/s0").collect()}
    assert not any(1000 + i in quality for i in range(60)) and all(2000 + i in quality for i in range(150))
    language = {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/s1").collect()}
    assert 205 not in language and all(2000 + i in language for i in range(150))
    unique = [r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/s2").collect()]
    assert 100 not in unique and len(unique) == len(set(unique)) and all(2000 + i in unique for i in range(150))
    packed = {r["doc_id"] for r in docs.collect()}
    assert packed <= set(unique)
    brute(spark, tmp_path, rows)


def brute(spark, tmp_path, rows):
    """Every stage's rows against what its predecessor kept, worked out plainly."""
    from test_operators import WORD, brute_components, shingles

    kept = [spark.read.parquet(f"{tmp_path}/s{k}").collect() for k in range(5)]
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert set(map(tuple, kept[0])) <= set(rows) and set(map(tuple, kept[1])) <= set(map(tuple, kept[0]))
    copies = brute_components({r["doc_id"]: shingles(r["text"]) for r in kept[1] if r["doc_id"] is not None})
    want = {tuple(r) for r in kept[1] if r["doc_id"] is None or copies[r["doc_id"]] == r["doc_id"]}
    assert sorted(map(tuple, kept[2]), key=order) == sorted(want, key=order)
    size = lambda r: len(WORD.findall(r["text"] or ""))
    have, taken = Counter(), Counter()
    for r in kept[2]:
        have[r["source"]] += size(r)
    for r in kept[3]:
        taken[r["source"]] += size(r)
    times = Counter(map(tuple, kept[3]))
    assert set(times) <= want and max(times.values()) <= 3 and all(taken[s] <= 3 * n + max(map(size, kept[2])) for s, n in have.items())
    held, pieces = defaultdict(list), Counter()
    for r in kept[4]:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]] += r["piece"] == 0
    assert pieces == Counter(r["doc_id"] for r in kept[3])
    for x in held.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x[:-1], x[1:], strict=True)) and sum(x[-1]) <= 2048


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame(documents()[:5], DOCS)
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for _, stage in corpus_pipeline.STAGES[:2]:  # without labels nothing goes for its quality
        assert {r["doc_id"] for r in stage(spark, docs, str(tmp_path)).collect()} == {0, 1, 2, 3, 4}
