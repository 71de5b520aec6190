"""Every registered query against its SQL twin, and stable rows of those without one."""

import pytest

from parlance.catalogue import ORACLES, QUERIES
from tests.conftest import DATA

WIDE = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def plain(rows):
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return sorted((tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=key)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    assert {c: WIDE.get(k, k) for c, k in df.dtypes} == kinds
    ours = plain(tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    theirs = plain(duck.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({ORACLES[name]})").fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    df = QUERIES[name](spark, str(DATA))
    assert df.count() > 0
    assert all(k not in ("void", "int", "float") for _, k in df.dtypes)


def test_realigned_segments_are_whole(spark):
    from parlance.catalogue import audio_text

    said = {(r.rec_id, r.seq): r.text for r in audio_text.spoken(spark, str(DATA)).collect()}
    got = {(r.rec_id, r.seq): r.text for r in QUERIES["realigned_segments"](spark, str(DATA)).collect()}
    assert got.keys() == said.keys() and any(len(t) > 200 for t in said.values())
    assert all(len(got[k]) > 0.9 * len(t) for k, t in said.items() if len(t) > 200)


def test_chunks_have_vectors_of_the_whole_table(spark):
    from pyspark.errors import PySparkException

    from parlance.catalogue import folds

    chunks = spark.range(800).selectExpr("id AS rec_id", "0L AS seq", "0L AS chunk_no")
    vectors = spark.range(800).selectExpr("id AS vec_id", "array(CAST(id AS FLOAT)) AS embedding")
    got = folds.chunk_vectors(chunks, vectors).collect()
    assert len(got) == 800 and {r.vec_id for r in got} == set(range(800)) and all(r.embedding == [r.vec_id] for r in got)
    with pytest.raises(PySparkException):
        folds.chunk_vectors(chunks, vectors.filter("vec_id <> 31")).collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
