import ast
from pathlib import Path
from types import SimpleNamespace

import pytest

from vecloom.sources.staging import fresh_path, release, shared_dir, staged

ROOT = Path(__file__).resolve().parents[1]


def session(master, **conf):
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf, applicationId="app-test"))


def test_shared_folder_is_needed_off_local_masters():
    for master in ("yarn", "local-cluster[3,2,3000]", "spark://somewhere:7077", "k8s://https://somewhere"):
        with pytest.raises(ValueError):
            shared_dir(session(master))
        assert shared_dir(session(master, **{"spark.checkpoint.dir": "hdfs:///shared/"})) == "hdfs:///shared"
    assert all(shared_dir(session(m)).startswith("file://") for m in ("local", "local[4]", "local[*]"))


def test_staged(spark):
    df = spark.range(5).toDF("a")
    out = staged(df, "numbers")
    assert out.dtypes == df.dtypes and sorted(r.a for r in out.collect()) == [0, 1, 2, 3, 4]
    assert fresh_path(spark, "x") != fresh_path(spark, "x")
    release(spark)


def test_nothing_in_the_library_needs_the_llm_package():
    """The library works without it, so no module outside may import it (the entry module guards its import)."""
    for path in (ROOT / "vecloom").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] + [a.name for a in node.names] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n.split(".") for n in names), path
