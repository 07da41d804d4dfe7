import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.path.join(ROOT, "tests"), os.environ.get("PYTHONPATH", "")])
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return DATA


def rows(df):
    """Rows as sorted tuples, whatever the order."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    names = "region nation customer supplier part orders lineitem events documents embeddings questions question_raw student_step kc_template problems kc_table kc_values question_vecs doc_labels subject_list mix_targets"
    for n in names.split():
        con.sql(f"create view {n} as select * from '{sf}/{n}.parquet'")
    return con


@pytest.fixture(scope="session")
def same(spark, sf, duck):
    """Whether a query and its SQL give the same rows."""
    from collections import Counter

    def canon(values):
        out = Counter()
        for r in values:
            out[tuple(None if v is None or v != v else round(v, 6) + 0.0 if isinstance(v, float) else str(v) for v in r)] += 1
        return out

    def check(query, sql):
        df = query(spark, sf)
        cols = sorted(df.columns)
        mine = canon(tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
        quoted = ", ".join(f'"{c}"' for c in cols)
        theirs = canon(duck.sql(f"select {quoted} from ({sql})").fetchall())
        assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])

    return check
