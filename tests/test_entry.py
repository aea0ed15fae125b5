"""The driver contract, and that the library does without the training-data operators."""

import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and all(callable(q) for q in queries.values())
    assert len(queries) > 100


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 1 and "rmse" in df.columns


def test_nothing_outside_imports_the_training_data_operators():
    for path in [*ROOT.glob("nearfield/**/*.py")]:
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path
