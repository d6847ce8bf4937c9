import __spark_entry__ as entry


def test_entry(spark):
    found = entry.entry(spark)
    assert set(found.columns) == {"lang", "type", "n", "documents"} and found.count() > 0


def test_names():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 80


def test_without_the_training_data_operators(monkeypatch):
    monkeypatch.setattr(entry, "_imported", lambda name: None)
    names = entry.queries()
    assert names and not any(name.startswith("op") or name == "pipeline" for name in names if name[:2] == "op" and name[2].isdigit())
    assert set(entry.oracle_sql()) <= set(names)
