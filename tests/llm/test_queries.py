import pytest

from mailsieve.llm import queries as q

SHAPES = {
    "p1_found": "msg_id_a bigint, msg_id_b bigint",
    "p2_found": "msg_id bigint, line_no int",
    "p3_found": "src string, rec_id string, seg_no int, lang string",
    "p4_found": "msg_id bigint, field string, link_index int, entry_id int",
    "p5_found": "msg_id bigint, field string, kind string, value string",
    "p6_found": "src string, rec_id bigint, part_no int",
    "p7_found": "doc_id bigint, item_id bigint",
    "p9_found": "doc_id bigint, kind string",
}


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, sf_dir, name):
    df = q.queries()[name](spark, sf_dir)
    if name in SHAPES:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == SHAPES[name]
        rows = df.collect()
        assert rows and len(rows) == len(set(rows))
    else:
        assert df.limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    got = q.queries()[name](spark, sf_dir).toPandas()
    want = duck.execute(q.oracle_sql()[name]).df()
    assert sorted(map(tuple, got[sorted(got)].values.tolist())) == sorted(map(tuple, want[sorted(want)].values.tolist()))
