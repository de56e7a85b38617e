import importlib.util
import __spark_entry__ as entry_mod


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["source", "article_count", "avg_sentiment"]
    assert df.count() > 0


def test_registry_contract():
    q, sql = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(sql) <= set(q)
    assert len(q) >= 40
    # The training-data queries are there where their subpackage is, and only there.
    optional = importlib.util.find_spec("articlespark.llm") is not None
    assert any(name.startswith("op1_") for name in q) == optional


def test_queries_remain_where_the_optional_ones_cannot_be_imported(monkeypatch):
    import builtins

    import pytest

    if importlib.util.find_spec("articlespark.llm") is None:
        pytest.skip("no optional queries here")
    plain = builtins.__import__

    def fails(name, *args, **kwargs):
        if name == "articlespark.llm.queries":
            raise ImportError("broken")
        return plain(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", fails)
    with pytest.warns(UserWarning, match="broken"):
        names = entry_mod.queries()
    assert len(names) >= 40 and not any(n.startswith("op1_") for n in names)
