import random
import re
from collections import defaultdict

import corpus_pipeline
from vecloom.llm.jaccard import jaccard_groups
from vecloom.llm.mixing import plan
from vecloom.llm.packing import best_fit_packing
from vecloom.llm.quality import scored, train
from vecloom.llm.secrets import secret_spans
from vecloom.llm.tokens import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    r = random.Random(11)
    text = lambda: " ".join("".join(r.choices("abcdefgh", k=r.randrange(2, 8))) for _ in range(80)) + "."
    rows, labels, base = [], [], None
    for i in range(240):
        kind = r.random()
        own = text()
        if kind < 0.2:
            own = "!! ".join(own.upper().split())
        elif kind < 0.35 and base:
            own = base + " and more"
        elif kind < 0.5:
            own += " password = hunter2hunter2x"
        base = own if kind >= 0.5 and not base else base
        rows.append((i, own, "en", f"s{i % 4}", len(own)))
        labels.append((i, int(kind >= 0.2), 0))
    return [*rows, (500, None, None, None, None), (501, "", "en", None, 0)], labels


def test_stages(spark, docs, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    given = docs(*rows)
    given.write.parquet(str(tmp_path / "documents.parquet"))
    now, kept = given, []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, now, str(tmp_path)).write.parquet(path)
        before, now = now, spark.read.parquet(path)
        kept.append((name, before.cache(), now.cache()))
        if name != "pack":
            assert now.columns == COLUMNS and now.dtypes == given.dtypes
    at = {name: (a, b) for name, a, b in kept}
    a, b = at["quality"]
    good = [r.doc_id for r in scored(a, train(a, spark.read.parquet(str(tmp_path / "labels.parquet")))).collect() if r.predicted]
    assert sorted(r.doc_id for r in b.collect()) == sorted(good) and 0.7 < len(good) / len(rows) < 0.9
    a, b = at["near"]
    groups = {r.doc_id: r.component_id for r in jaccard_groups(a, 5, 80).collect()}
    assert sorted(r.doc_id for r in b.collect()) == sorted(set(groups.values())) and len(set(groups.values())) < len(groups)
    a, b = at["secrets"]
    texts, clean = ({r.doc_id: r.text for r in x.collect()} for x in (a, b))
    assert texts.keys() == clean.keys() and not any("hunter2hunter2x" in (t or "") for t in clean.values())
    assert all(clean[d] == re.sub("password = hunter2hunter2x", "[SECRET]", t or "") or t is None for d, t in texts.items())
    assert all(len(r.spans) == 0 for r in secret_spans(b).collect())
    a, b = at["mix"]
    words = defaultdict(int)
    for r in b.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars is None or r.n_chars == len(r.text)
    assert dict(words) == {r.doc_id: r.taken for r in plan(a).collect() if r.taken}
    a, b = at["pack"]
    lines = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert lines(b) == lines(best_fit_packing(a, tokenizer_path("word_bpe_49k.json"))) and b.count() >= a.count()
    assert lines(corpus_pipeline.run(spark, str(tmp_path))) == lines(b)


def test_empty_tables(spark, docs, tmp_path):
    docs((1, "x")).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_entry():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) == 10 and set(entry.oracle_sql()) <= set(names)
