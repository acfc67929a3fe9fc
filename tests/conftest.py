import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    import tempfile

    from litrank.session import checkpoint_dir, get_session
    warehouse = tempfile.mkdtemp(prefix="litrank-warehouse-", dir="/tmp")
    s = get_session("local[*]", app="litrank-tests", shuffle_partitions=8,
                    extra={"spark.sql.warehouse.dir": warehouse})
    checkpoint_dir(s)
    yield s
    s.stop()


def rows(df, *cols):
    """Sorted list of tuples of the given columns (all if none)."""
    sel = df.select(*cols) if cols else df
    return sorted(tuple(r) for r in sel.collect())
