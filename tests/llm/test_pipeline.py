import re
from collections import Counter, defaultdict

import corpus_pipeline
from test_quality import brute as quality_brute
from test_quality import share
from test_secrets import brute as secrets_brute

from marlstone.llm import quality


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    want = {r.doc_id: r for r in docs.collect()}
    cols = docs.columns
    got = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, got, d)
        assert got.columns == cols, name
        rows = got.collect()
        if name == "quality_rules":
            limits = quality.Rules().windows
            want = {i: r for i, r in want.items() if not quality_brute(r.text)[5] and all(share(r.text, n) <= most for n, most in limits.items())}
            lost = set(want) - {r.doc_id for r in rows}
            assert {r.doc_id for r in rows} <= set(want) and len(lost) <= 0.02 * len(want)  # line rules take the rest
            want = {r.doc_id: r for r in rows}
        elif name == "near_duplicates":
            kept = {r.doc_id for r in rows}
            sets = {i: shingles(r.text) for i, r in want.items()}
            alike = defaultdict(set)
            for i in sets:
                for j in sets:
                    if i < j and len(sets[i]) and (s := len(sets[i] & sets[j]) / len(sets[i] | sets[j])) >= 0.6:
                        alike[i].add(j)
                        alike[j].add(i)
                        assert s < 0.9 or not {i, j} <= kept
            assert all(alike[i] for i in set(want) - kept)
            least = {i: i for i in kept}
            want = {i: want[i] for i in least.values()}
        elif name == "secret_scan":
            assert {r.doc_id for r in rows} == set(want)
            for r in rows:
                assert r.n_chars == len(r.text) and not secrets_brute(r.text)
                if not secrets_brute(want[r.doc_id].text):
                    assert r.text == want[r.doc_id].text
        else:
            n = Counter(r.doc_id for r in rows)
            assert set(n) <= set(want) and max(n.values()) <= 2
        got = spark.createDataFrame(rows, docs.schema)
    packed = corpus_pipeline.pack(spark, got, d).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in rows)


def test_run_and_empty(spark):
    d = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, d)
    at = defaultdict(int)
    for r in out.collect():
        at[r.sequence_id] += r.length
    assert at and max(at.values()) <= 2048
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
    assert docs.count() == 0


def test_run_goes_on_and_cleans_up(spark, tmp_path, monkeypatch):
    import pytest

    calls = []

    def stage(name, broken=False):
        def run(spark, docs, sf_dir):
            calls.append(name)
            if broken and calls.count(name) == 1:
                raise RuntimeError(name)
            return docs.withColumn(name, docs.doc_id + len(calls))

        return name, run

    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("one"), stage("two"), stage("three", True), stage("four")])
    folder = tmp_path / "run"
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, str(tmp_path), str(folder))
    assert sorted(p.name for p in folder.iterdir()) == ["two"]
    out = corpus_pipeline.run(spark, str(tmp_path), str(folder))
    assert calls == ["one", "two", "three", "three", "four"] and out.columns == ["doc_id", "text", "one", "two", "three", "four"] and out.count() == 2
    assert sorted(p.name for p in folder.iterdir()) == ["four"]
    again = corpus_pipeline.run(spark, str(tmp_path), str(folder))
    assert calls == ["one", "two", "three", "three", "four"] and again.count() == 2


def test_columns_that_clash_pass_through_all_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(60)
    names = ["id", "name", "_id", "_nth", "_name", "_salt", "_w", "rank", "length", "target", "ids", "root", "spans", "kept"]
    wide = docs.select("*", *[docs.doc_id.cast("string").alias(n) for n in names])
    got = wide
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = spark.createDataFrame(stage(spark, got, d).collect(), wide.schema)
        assert got.columns == wide.columns, name
        assert got.where("id <> doc_id OR _salt <> doc_id OR kept <> doc_id").count() == 0
    assert corpus_pipeline.pack(spark, got, d).count() >= got.count()
