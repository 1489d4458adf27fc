import pytest

from passagework.llm import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, same_as_sql):
    same_as_sql(registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_rows_only(name, spark):
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0 or name == "p7_reparameterised"


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent.parent
    for f in [*(root / "passagework").rglob("*.py"), root / "bench.py"]:
        if "llm" not in f.relative_to(root).parts and f.exists():
            assert "passagework.llm" not in f.read_text(), f
