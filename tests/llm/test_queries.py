import pytest

from strandloom.llm import queries as q

from ..oracle import HAVE, SF, check

pytestmark = pytest.mark.skipif(not HAVE, reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, name):
    check(spark, q.queries()[name], q.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(q.BASE_SQL))
def test_base_columns_equal_sql(spark, name):
    check(spark, q.queries()[name], q.BASE_SQL[name], whole=False)


@pytest.mark.parametrize("name", ["op2_toxicity", "op4_packing", "op5_token_store", "op6_decontamination", "op7_sharding"])
def test_columns_of_the_others(spark, name):
    want = {
        "op2_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
        "op4_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
        "op5_token_store": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
        "op6_decontamination": "doc_id bigint, item_id bigint, n_items bigint, n_tiles int, matched_words int, item_words int, coverage double",
        "op7_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    }
    df = q.queries()[name](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == want[name]
    assert df.count() > 0
