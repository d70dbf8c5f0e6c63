"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from docspark import page_queries
from docspark import queries as q

QUERIES, ORACLES = q.QUERIES | page_queries.QUERIES, q.ORACLES | page_queries.ORACLES


def _norm(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for name in sorted(os.listdir(sf)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    names = sorted(got.columns)
    ours = sorted((tuple(_norm(r[n]) for n in names) for r in got.collect()), key=repr)
    answer = duck.execute(ORACLES[name])
    at = [d[0] for d in answer.description]
    assert sorted(at) == names
    theirs = sorted((tuple(_norm(r[at.index(n)]) for n in names) for r in answer.fetchall()), key=repr)
    assert ours == theirs


def test_every_query_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "text", "status"]


def test_damaged_text_is_counted(spark, sf):
    """Against Python's own repair of the same bytes, character by character."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = q.utf8_repair(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = bytearray(texts[r.doc_id].encode())
        raw[::7] = b"\xff" * len(raw[::7])
        assert (r.n_bytes, r.has_replacements, r.n_replaced) == (len(raw), len(raw) > 0, raw.decode("utf-8", "replace").count("\ufffd"))


def test_nations_with_more_suppliers_than_an_entry_has_children(spark, tmp_path):
    """600 suppliers of one nation, one of another: an entry of an outline has 255 children at most."""
    spark.createDataFrame([(0, "A", 0), (1, "B", 0), (2, "C", 1)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    suppliers = spark.range(601).selectExpr("id AS s_suppkey", "concat('s', id) AS s_name", "IF(id = 600, 1, 0) AS s_nationkey")
    suppliers.write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted(map(tuple, q.outline_tree(spark, str(tmp_path)).collect()), key=repr)
    names = ["r_regionkey", "title", "parent_title", "n_below"]
    tops = [(0, "A", None, 600), (0, "B", None, 1), (1, "C", None, 0)]
    assert got == sorted([*tops, *((0, f"s{k}", "B" if k == 600 else "A", 0) for k in range(601))], key=repr) and q.outline_tree(spark, str(tmp_path)).columns == names


def test_outlines_are_cut_by_entries():
    nations = [{"n_nationkey": k, "n_name": f"n{k}", "names": [f"{k}-{j}" for j in range(m)]} for k, m in enumerate((700, 0, 300))]
    cut = q._outlines(nations, 300)
    assert max(map(len, cut)) <= 300 and all(n <= 255 for entries in cut for _, _, n in entries)
    assert [t for entries in cut for t, h, _ in entries if not h] == [x for n in nations for x in n["names"]]
    assert {h for entries in cut for _, h, _ in entries if h} == {"#0", "#1", "#2"}


def test_questions_inside_a_page_join_and_broadcast_nothing(spark, sf):
    for name, exchanges in (("zone_hits", 1), ("zone_descendants", 2)):  # rows dealt to be packed; and counts of a document
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Broadcast" not in plan and plan.count("Exchange hashpartitioning") <= exchanges


def test_pixels_are_not_shuffled(spark, sf):
    """Blits are dealt once, before they become pixels; neither pixels nor colours are dealt again."""
    for name in ("palette_last_wins", "union_mask"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(l_orderkey" in plan


def test_first_reduction_that_fits(spark):
    """Halving finds what trying every reduction finds; each is tried few times, as a table is dealt to all cores."""
    import math

    from docspark.functions import native

    rows = spark.range(400).selectExpr("id", "id * 977 % 40000 + 1 AS w", "id * 1409 % 60000 + 1 AS h", "double(1 / (id * 31 % 400 + 1)) AS z")
    col = lambda n: q.F.col(n)
    got = {r.id: (r.s, r.w, r.h, r.z) for r in rows.withColumn("s", native.subsample_for(col("w"), col("h"), col("z"), q.F.lit(4000), q.F.lit(3000), q.F.lit(1.0), most=6)).collect()}
    count = lambda size, view, z, s: min(math.ceil(math.ceil(size / s) / 512), math.ceil(view / (z * s * 512)) + 1)
    want = {k: next((s for s in range(max(1, min(256, math.floor(1 / z))), 257) if count(w, 4000, z, s) * count(h, 3000, z, s) <= 6), 256) for k, (_, w, h, z) in got.items()}
    assert {k: v[0] for k, v in got.items()} == want and len(set(want.values())) > 20
    assert "256" not in str(native.subsample_for(col("w"), col("h"), col("z"), q.F.lit(1), q.F.lit(1), q.F.lit(1.0))).split("sequence(")[1].split(")")[0]  # eight tries, not all
