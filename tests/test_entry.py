import __spark_entry__ as entry


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["page_id", "reference", "ours", "matched", "exact", "diffs"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_without_the_optional_part(monkeypatch):
    import builtins
    import sys

    import __spark_entry__ as entry

    real = builtins.__import__

    def without(name, *args, **kw):
        if name == "corpus_pipeline" or name.startswith("leafscan.llm"):
            raise ImportError(name)
        return real(name, *args, **kw)

    for name in [m for m in sys.modules if m.startswith("leafscan.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", without)
    assert "pipeline" not in entry.queries() and "box_iou" in entry.queries() and not any(q.startswith("op") and q[2].isdigit() for q in entry.oracle_sql())
