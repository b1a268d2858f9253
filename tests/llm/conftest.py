import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text, ...) tuples, with a column that clashes with what operators make."""
    def make(rows):
        full = [(*r, *(None,) * (4 - len(r))) for r in rows]
        schema = "doc_id long, text string, lang string, source string, node long, value string, n_chars long"
        return spark.createDataFrame([(*r, 7, "x", None if r[1] is None else len(r[1])) for r in full], schema)
    return make
