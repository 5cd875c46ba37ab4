"""The entry module stands on its own when the training-data operators are gone."""

import subprocess
import sys
import textwrap

from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_imports_without_the_optional_parts():
    code = textwrap.dedent(
        """
        import sys
        sys.modules["strandweave.llm"] = None
        sys.modules["corpus_pipeline"] = None
        import __spark_entry__ as e
        q, o = e.queries(), e.oracle_sql()
        assert "pipeline" not in q and not any(k.startswith("op") for k in q), sorted(q)
        assert len(q) > 60 and set(o) <= set(q)
        """
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_every_query_has_a_name_of_its_own():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns == ["rid", "name", "sequence", "qualities"] and out.count() > 1000
