import ast
import pathlib

import __spark_entry__ as entry

ROOT = pathlib.Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_only_the_entry_imports_the_optional_package():
    for path in (ROOT / "marginalia").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text(encoding="utf-8"))):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("marginalia.llm") for n in names), path


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "content_correctness" in df.columns


def test_plans_hold_no_cross_join(spark):
    for name, f in entry.queries().items():
        if not name.startswith("stream_"):
            plan = f(spark, DATA)._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
