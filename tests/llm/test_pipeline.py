"""A run of the pipeline over a small folder against what was planted in it, and every stage on odd tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def _folder(spark, path):
    rng = random.Random(31)
    fresh = lambda n: " ".join(f"v{rng.randrange(20_000)}" for _ in range(n))
    item = fresh(30)
    texts = {i: fresh(60) for i in range(200)}  # clean ones
    toxic = {}
    for i in range(200, 320):
        w = fresh(60).split()
        for k in rng.sample(range(60), 12):
            w[k] = rng.choice(["idiot", "scum", "moron", "trash"])
        toxic[i] = " ".join(w)
    copies = {400 + i: texts[i].replace(texts[i].split()[30], "other") for i in range(10)}
    leaks = {500 + i: f"{fresh(30)} {item} {fresh(30)}" for i in range(8)}
    shared = fresh(14)
    lines = {600 + i: f"{fresh(50)}\n{shared}{' x' * (i % 2)}\n{fresh(50)}" for i in range(6)}
    docs = texts | toxic | copies | leaks | lines
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()] + [(700, None, None, None, None)], DOC).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 200, 2)] + [(i, 1, 1) for i in range(200, 320, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, set(toxic), set(copies), set(leaks), set(lines), shared


def test_run_against_brute_force(spark, tmp_path):
    docs, toxic, copies, leaks, lines, shared = _folder(spark, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in got}
    clean = set(range(200)) | lines
    assert kept >= clean | {700} and not kept & (copies | leaks) and len(kept & toxic) <= 0.1 * len(toxic)
    assert kept <= clean | toxic | {700}
    # tokens of what is left: whole texts, without the shared line in all but the first document that has it
    from tokenizers import Tokenizer

    from tessera.llm.queries import vocabulary

    tok = Tokenizer.from_file(vocabulary())
    want = {}
    for i in clean:
        t = docs[i] if i not in lines or i == min(lines) else "\n".join(x for x in docs[i].split("\n") if not x.startswith(shared))
        want[i] = len(tok.encode(t, add_special_tokens=False).ids) + 1
    assert {i: sum(r["length"] for r in got if r["doc_id"] == i) for i in clean} == want
    assert all(r["length"] == 1 for r in got if r["doc_id"] == 700)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_on_odd_tables(spark, tmp_path, name):
    """Null ids and texts, repeated ids, empty and long texts, clashing columns, and no rows at all."""
    _folder(spark, str(tmp_path))
    stage = dict(corpus_pipeline.STAGES)[name]
    long = " ".join(f"u{i}" for i in range(30_000))
    rows = [(None, "a text without an id", "x", "y", 1), (1, None, "x", "y", None), (2, "", "x", "y", 0), (3, "some words of one text", "x", "y", 1), (3, "some other words than those", "x", "y", 1), (4, long, "x", "y", 9)]
    df = spark.createDataFrame(rows, DOC).withColumns({"gone": F.lit("g"), "severity": F.lit("s"), "leak": F.lit("l"), "h": F.lit("h")})
    out = stage(spark, df, str(tmp_path))
    assert out.columns == df.columns and {r["gone"] for r in out.collect()} == {"g"}
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in out.collect()) == sorted((i or -1, t or "") for i, t, *_ in rows)
    assert stage(spark, df.limit(0), str(tmp_path)).count() == 0


def test_packing_stage_on_no_rows(spark, tmp_path):
    assert corpus_pipeline.packing(spark, spark.createDataFrame([], DOC), str(tmp_path)).count() == 0


def test_stages_over_a_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), name)
        assert docs.columns == names and 0 < docs.count() <= before
        before = docs.count()


def test_whole_texts_and_sets_go_to_python_in_small_batches(spark, monkeypatch):
    """Where rows hold texts or sets, few go at once; afterwards the session is as before, and results are the same."""
    from tessera.llm import line_dedup, minhash

    key, seen, real = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, minhash.materialize
    before = spark.conf.get(key)

    def kept(df, name):
        seen.setdefault(name, set()).add(int(spark.conf.get(key)))
        return real(df, name)

    monkeypatch.setattr(minhash, "materialize", kept)
    monkeypatch.setattr(line_dedup, "materialize", kept)
    words = "one two three four five six seven eight nine ten".split()
    docs = spark.createDataFrame([(i, " ".join(words + [str(i // 2)]) + "\nanother line of the text " + str(i)) for i in range(6)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    left = line_dedup.dedup_lines(docs).count()
    assert 0 < left < 6 and set(got) == set(range(6))
    assert all(seen[n] == {1_000} for n in ("signatures", "postings", "line-hashes", "lines")) and 1_000 in seen["links"]
    assert spark.conf.get(key) == before
