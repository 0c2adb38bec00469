"""The engine stands without the training-data package."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_engine_without_the_training_data_package(tmp_path):
    """A copy without those folders: the queries of the engine are all there, whether or not the pipeline's file is."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "*.json"))
    code = "import __spark_entry__ as E; q = E.queries(); assert len(q) > 140 and set(E.oracle_sql()) <= set(q), len(q); assert 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); print('fine')"
    for _ in range(2):
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
        assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)


def test_nothing_else_names_the_training_data_package():
    for path in [*ROOT.glob("lattica/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts and path != Path(__file__).resolve():
            assert "lattica.llm" not in path.read_text() and "from .llm" not in path.read_text() and "from ..llm" not in path.read_text(), path


def test_shared_folder_must_be_named_on_a_cluster(monkeypatch):
    import pytest

    from lattica import storage

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):  # noqa: N802
            return Conf()

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext, conf = Context(), Conf()  # noqa: N815

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session())
