"""Every registered query of the engine against its SQL on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from lodestone.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert rows
        return
    want = con.execute(ORACLES[name]).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in place) for r in want), key=repr)


def test_whole_inputs(spark, sf, con):
    """Queries over documents and over all pairs: lexical scores by brute force, and the number of pairs."""
    from lodestone.plans.catalogue import tokens

    sql = f"""with q as (select item_id, {tokens('text')} as t from benchmark), d as (select doc_id, list_distinct({tokens('text')}) as t from documents)
        select item_id, doc_id, round(len(list_intersect(list_distinct(q.t), d.t)) / sqrt(len(q.t) * len(d.t)), 5) from q join d on len(list_intersect(q.t, d.t)) > 0"""
    want = {(a, b): s for a, b, s in con.execute(sql).fetchall()}
    got = {(r.item_id, r.doc_id): r.score for r in QUERIES["lexical_score_documents"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-5 for k in want)
    n = con.execute("select count(*) from benchmark").fetchone()[0]
    assert QUERIES["char_trigram_dice_pairs"](spark, sf).count() == n * (n - 1) // 2


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "chunk_id", "rank", "lexical", "semantic", "fusion", "score"]
