import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def docs(spark):
    import corpora

    return spark.createDataFrame(corpora.rows(corpora.texts()), corpora.SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    import corpora

    return spark.createDataFrame([], corpora.SCHEMA)
