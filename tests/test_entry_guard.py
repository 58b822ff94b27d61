"""The driver's entry leaves out what cannot be imported, and no more."""

import importlib

import pytest


@pytest.mark.parametrize("missing", ["lorebank.llm.queries", "corpus_pipeline"])
@pytest.mark.parametrize("error", [ImportError, ModuleNotFoundError])
def test_other_queries_load_without_the_corpus_operators(monkeypatch, missing, error):
    import __spark_entry__

    own = importlib.import_module

    def load(name, *rest):
        if name == missing:
            raise error(name)
        return own(name, *rest)

    monkeypatch.setattr(importlib, "import_module", load)
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert "knn_topk" in queries and "pipeline" not in queries and set(oracles) <= set(queries)
    if missing == "lorebank.llm.queries":
        assert not any(name.startswith("op") and name[2].isdigit() for name in queries)


def test_a_fault_inside_a_module_is_not_hidden(monkeypatch):
    import __spark_entry__

    def load(name, *rest):
        raise ValueError(name)

    monkeypatch.setattr(importlib, "import_module", load)
    with pytest.raises(ValueError):
        __spark_entry__.queries()
