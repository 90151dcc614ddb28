import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

from corpusloom.plans import registry
from tests import plain

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no supplied tables here")


def rows(frame, columns):
    return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))


@needs_data
@pytest.mark.parametrize("name", registry.queries())
def test_query_equals_sql(spark, name):
    got = registry.queries()[name](spark, str(DATA)).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        want = plain.VERSIONS[name](DATA)  # a query has SQL or a plain version
    else:
        c = duckdb.connect()
        for t in TABLES:
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        want = c.sql(sql).df()
    for f in (got, want):
        for column in f.columns:
            f[column] = f[column].map(lambda x: list(map(float, x)) if isinstance(x, (list, np.ndarray)) else x)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


@needs_data
def test_plans(spark):
    plan = lambda f: f._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan(registry.cosine_topk(spark, str(DATA))) and "NestedLoop" not in plan(registry.cosine_topk(spark, str(DATA)))
    scan = plan(registry.chunk_ids(spark, str(DATA)))
    assert "ReadSchema: struct<doc_id:bigint>" in scan
    assert "Window" not in plan(registry.embedding_batches(spark, str(DATA)))


def test_entry_needs_no_llm(tmp_path):
    """Without the training-data subpackage and the pipeline, everything else still registers."""
    root = Path(__file__).resolve().parents[1]
    code = "import sys, importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if n.startswith('corpusloom.llm') or n == 'corpus_pipeline' else f(n, *a); import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(registry.queries())), "False", "True"]
    sources = [p for p in (root / "corpusloom").rglob("*.py") if "llm" not in p.parts]
    assert sources and not [p for p in sources if "corpusloom.llm" in p.read_text()]
