"""The pipeline as a whole: the stages in turn, a run that goes on where it stopped, empty documents."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, d = random.Random(4), tmp_path_factory.mktemp("corpus")
    word = lambda: "".join(rng.choice("bdklmnrst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = [prose(rng.choice([8, 60, 150])) for _ in range(30)]
    shared = prose(50)
    texts += [texts[12], texts[12].upper(), f"{prose(30)} {shared} {prose(30)}", f"{prose(30)} {shared} {prose(30)}", None, "", " \n", "123 456", prose(60) * 300]
    texts.append(f"{prose(20)} the item that a benchmark asks for in so many words {prose(20)}")
    rows = [(i, t, "xx" if i % 3 else "yy", f"s{i % 2}", None, 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "The item that a benchmark asks for in so many words.")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_run_is_the_stages_in_turn(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    got = corpus_pipeline.run(spark, folder)
    assert rows(got) == rows(docs) and got.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
    ids = {r.doc_id for r in got.collect()}
    assert not {30, 31, 34, 35, 36, 37, 39} & ids and len(ids) > 10  # copies, texts without words or letters, and the benchmark's go
    import os

    where = os.path.dirname(got.inputFiles()[0].removeprefix("file:").replace("///", "/"))
    assert os.listdir(os.path.dirname(where)) == ["mixture"]  # the folders between are gone


def test_a_run_goes_on_where_it_stopped(spark, folder, tmp_path, monkeypatch):
    import corpus_pipeline

    ran = []

    def watched(name, stage, dies):
        def run(*args):
            ran.append(name)
            if name in dies:
                dies.remove(name)
                raise RuntimeError("lost")
            return stage(*args)

        return name, run

    dies, stages = ["repeated_passages"], list(corpus_pipeline.STAGES)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(*s, dies) for s in stages])
    at = str(tmp_path / "run")
    with pytest.raises(RuntimeError, match="lost"):
        corpus_pipeline.run(spark, folder, at)
    got = corpus_pipeline.run(spark, folder, at)
    names = [n for n, _ in stages]
    assert ran == [*names[:3], *names[2:]]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    assert rows(got) == rows(corpus_pipeline.run(spark, folder))
    ran.clear()
    assert rows(corpus_pipeline.run(spark, folder, at)) == rows(got)


def test_stages_of_no_documents(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0, name
        if name != "mixture":
            assert out.columns == docs.columns
