import importlib
import pkgutil
from pathlib import Path

import panelspark

ROOT = Path(panelspark.__file__).parent


def test_nothing_outside_the_subpackage_imports_it():
    for p in ROOT.rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "panelspark.llm" not in p.read_text(), p


def test_every_module_imports():
    for m in pkgutil.walk_packages([str(ROOT)], "panelspark."):
        importlib.import_module(m.name)


def test_entry_and_names(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60
    assert e.entry(spark).count() > 0


def test_scratch_needs_a_shared_folder_on_clusters(spark):
    from panelspark.session import scratch_path, shared_dir

    assert scratch_path(spark, "x").startswith(shared_dir(spark).rstrip("/"))
