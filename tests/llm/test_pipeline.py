"""The corpus pipeline: each stage on its own input, against plain versions."""

import random

import pytest

import corpus_pipeline
from brindle.llm.common import components, shared_dir
from brindle.llm.decontaminate import plain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The input and the rows of every stage."""
    folder, docs = tmp_path_factory.mktemp("pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def ids(df):
    return sorted(x["doc_id"] for x in df.collect())


def test_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "sharding"]


def test_columns(stages):
    assert all(df.columns == COLUMNS for df in stages[:-1])
    assert stages[-1].columns == [*COLUMNS, "shard", "slot"]


def test_toxicity(spark, sf_dir, stages):
    labels = dict(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").collect())
    kept, before = set(ids(stages[1])), ids(stages[0])
    clean = [i for i in before if labels.get(i) == 0]
    assert sum(i in kept for i in clean) > 0.97 * len(clean)
    assert len(kept) < len(before)


def test_simhash(stages):
    def grams(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    before = {x["doc_id"]: grams(x["text"]) for x in stages[1].collect()}
    kept = set(ids(stages[2]))
    for i, g in before.items():
        alike = [j for j, h in before.items() if j != i and len(g & h) > 0.3 * len(g | h)]
        if not alike:
            assert i in kept  # clean documents stay
        if any(before[j] == g and j < i for j in alike):
            assert i not in kept  # copies go


def test_decontamination(spark, sf_dir, stages):
    tests = [plain(x["text"]) for x in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaked = {x["doc_id"] for x in stages[2].collect() if any(t in plain(x["text"]) for t in tests)}
    assert leaked and set(ids(stages[3])) == set(ids(stages[2])) - leaked


def test_mixing_and_sharding(stages):
    before = {x["doc_id"]: x["text"] for x in stages[3].collect()}
    rows = stages[4].collect()
    assert all(before[x["doc_id"]] == x["text"] for x in rows) and max(ids(stages[4]).count(i) for i in before) <= 3
    placed = stages[5].collect()
    assert sorted(tuple(x)[:-2] for x in placed) == sorted(map(tuple, rows))
    by_text = {}
    assert all(by_text.setdefault(x["text"], x["shard"]) == x["shard"] for x in placed)
    for s in range(8):
        slots = sorted(x["slot"] for x in placed if x["shard"] == s)
        assert slots == list(range(len(slots)))


def test_odd_documents(spark, sf_dir):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "word " * 100_000, "en", None, 5), (3, "a few words here", None, "a", 1), (3, "quite other words", None, "b", 1)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long")
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            if name == "simhash":
                assert docs.count() == (5 if some else 0) - (1 if some else 0) * 1
        docs.collect()


def test_without_labels_and_benchmark(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, f"document number {i} has words of its own {i * i}", "en", "ab"[i % 2], 5) for i in range(40)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.toxicity(spark, docs, str(tmp_path)).count() == 41
    assert corpus_pipeline.decontamination(spark, docs, str(tmp_path)).count() == 41


def test_run_keeps_its_last_stage_only(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 100 and out.columns == [*COLUMNS, "shard", "slot"]
    files = {f.rsplit("/", 2)[1] for f in out.inputFiles()}
    folder = out.inputFiles()[0].rsplit("/", 2)[0]
    left = [x.getPath().getName() for x in spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(folder))]
    assert files == set(left) == {"4-sharding"}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 300)] + [(1000 + rng.randrange(200), 1000 + rng.randrange(200)) for _ in range(150)] + [(5, 5), (7, 6)]
    group = {x: x for e in edges for x in e}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        group[max(a, b)] = min(a, b)
    found = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in group if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_no_plan_of_components_repeats_a_star(spark, monkeypatch):
    from brindle.llm import common

    joins, own = [], common.cut

    def cut(df):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return own(df)

    monkeypatch.setattr(common, "cut", cut)
    found = common.components(spark.createDataFrame([(1, 2), (2, 3), (5, 4)], "a long, b long"))
    assert sorted(map(tuple, found.collect())) == [(2, 1), (3, 1), (5, 4)] and max(joins) == 1


def test_the_shared_folder_is_the_session_s(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
