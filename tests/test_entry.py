import importlib
import sys

import __spark_entry__ as entry


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(isinstance(sql, str) for sql in entry.oracle_sql().values())


def test_entry_works_without_the_llm_folders(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("palimpsest.llm")]:
        monkeypatch.delitem(sys.modules, name)
    for name in ("palimpsest.llm", "palimpsest.llm.registry", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    again = importlib.reload(entry)
    assert not [k for k in again.queries() if k.startswith("op") or k == "pipeline"] and len(again.queries()) > 80
    assert set(again.oracle_sql()) == set(again.queries())
