"""Operators on literal rows: the rules that are easy to get wrong."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tenderflow import functions as fn
from tenderflow.codes import Codes
from tenderflow.operators import (
    by_eligibility,
    eligible_stores,
    ordered_listing,
    property_summary,
    scalar_lookup,
    session_matches,
    surplus_over,
)
from tenderflow.sources.from_orders import number_within

CODES = Codes()


def one(spark, column, value, type_="string"):
    return spark.createDataFrame([(value,)], f"v {type_}").select(column.alias("r")).first().r


@pytest.mark.parametrize("text, n, want", [
    ("1::2::D::7::9", 4, "7"), ("1::2::D::7::9", 5, "9"), ("1::2", 4, None),
    ("::1:::2", 2, "2"), (None, 1, None), ("", 1, None),
])
def test_nth_run(spark, text, n, want):
    assert one(spark, fn.nth_run(F.col("v"), ":", n), text) == want


def test_text_helpers(spark):
    assert one(spark, fn.first8(F.col("v")), "123456789") == "12345678"
    assert one(spark, fn.scope_store(F.col("v"), CODES), "STORE:12") == "12"
    assert one(spark, fn.scope_store(F.col("v"), CODES), "STORE:") is None
    assert one(spark, fn.full_name(F.col("v"), F.lit("Lee")), None) == " Lee"
    assert one(spark, fn.month_name_day_text(F.col("v")), "2024-03-05") == "05-MAR-2024"


def test_unknown_tender_type_has_no_payment_type(spark):
    kind, tender = F.lit(None).cast("string"), F.col("v")
    assert one(spark, fn.payment_type(kind, tender, CODES), "CHECK") is None
    assert one(spark, fn.is_deposit(kind, tender, CODES), "CHECK") is False
    assert one(spark, fn.payment_type(F.lit("CHECK"), tender, CODES), "ACH_CHECK") == "ACH_CHECK"
    assert one(spark, fn.payment_type(F.lit("CHECK"), tender, CODES), "CHECK") == "DEPOSIT"
    card = fn.payment_type(F.lit("CREDIT_CARD"), tender, CODES)
    assert one(spark, card, "ACH_CHECK") == "CREDIT_CARD"


def test_underscore_of_a_code_prefix_is_a_wildcard(spark):
    rule = fn.code_like(F.col("v"), "SMART_ID")
    assert one(spark, rule, "SMARTxID_1") is True
    assert one(spark, rule, "SMART_I") is False


def test_not_in_drops_null(spark):
    assert one(spark, fn.is_core_sale(F.col("v"), CODES), None) is None
    assert one(spark, fn.is_core_sale(F.col("v"), CODES), "ITEM") is True


def test_listing_is_in_text_order_and_keeps_repeats(spark):
    df = spark.createDataFrame(
        [(1, "D9"), (1, "D10"), (1, "D9"), (1, None), (2, None)], "k int, v string"
    )
    rows = ordered_listing(df, ["k"], "v", "out").collect()
    assert [tuple(row) for row in rows] == [(1, "D10, D9, D9")]


def test_property_summary(spark):
    df = spark.createDataFrame(
        [
            (1, "ID_1", "b", None), (1, "ID_2", "a", None), (1, "ID_3", "b", None),
            (1, "AMT_1", "x", Decimal(2)), (1, "AMT_2", "x", None), (2, "ID_1", None, None),
            (3, "OTHER", "z", Decimal(1)),
        ],
        "k int, property_code string, string_value string, decimal_value decimal(17,6)",
    )
    out = property_summary(df, ["k"], {"ids": "ID"}, {"total": "AMT"}).orderBy("k").collect()
    assert [tuple(row) for row in out] == [(1, "a, b, b", Decimal(2)), (2, None, None)]


def test_lookup_raises_only_for_rows_that_find_two_values(spark):
    dim = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d"), (3, "d")], "id int, v string")
    rows = spark.createDataFrame([(1,), (9,)], "k int")
    found = scalar_lookup(rows, dim, {"k": "id"}, {"out": F.col("v")}).orderBy("k").collect()
    assert [tuple(row) for row in found] == [(1, "a"), (9, None)]
    again = spark.createDataFrame([(3,)], "k int")
    same = scalar_lookup(again, dim, {"k": "id"}, {"out": F.col("v")}, distinct=True)
    assert same.first().out == "d"
    for key, distinct in ((2, True), (2, False), (3, False)):
        asked = spark.createDataFrame([(key,)], "k int")
        with pytest.raises(Exception, match="more than one value"):
            scalar_lookup(asked, dim, {"k": "id"}, {"out": F.col("v")}, distinct).collect()


def test_distinct_lookup_counts_null_as_a_value(spark):
    dim = spark.createDataFrame([(1, "a"), (1, None)], "id int, v string")
    rows = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(Exception, match="more than one value"):
        scalar_lookup(rows, dim, {"k": "id"}, {"out": F.col("v")}, distinct=True).collect()


def config(spark, changes, scopes, members=()):
    return {
        "cfg_profile_element_changes": spark.createDataFrame(
            [(1, "G", "E", "SYSCFG", "SystemConfig.xml", version, text)
             for version, text in changes],
            "organization_id int, profile_group_id string, profile_element_id string, "
            "change_type string, change_subtype string, config_version bigint, changes string",
        ),
        "dpl_deployment": spark.createDataFrame(
            [(version, "E", "G", "CONFIGURATOR", "COMPLETE", scope) for version, scope in scopes],
            "config_version bigint, profile_element_id string, profile_group_id string, "
            "deployment_type string, deploy_status string, org_scope string",
        ),
        "loc_rtl_loc_collection_element": spark.createDataFrame(
            list(members), "collection_name string, org_scope_code string"
        ),
    }


ON, OFF = "SmartSafeEnabled=true", "SmartSafeEnabled=false"


@pytest.mark.parametrize("changes, want", [
    ([(1, ON), (2, OFF)], set()), ([(1, OFF), (2, ON)], {"7"}), ([(2, ON), (2, OFF)], {"7"}),
    ([(1, ON), (2, None)], set()),
])
def test_newest_push_decides_and_a_tie_counts(spark, changes, want):
    tables = config(spark, changes, [(1, "STORE:7"), (2, "STORE:7")])
    assert {row.rtl_loc_id for row in eligible_stores(tables).collect()} == want


def test_collection_scope_gives_its_members(spark):
    members = [("WEST", "STORE:1"), ("WEST", "STORE:2")]
    tables = config(spark, [(1, ON)], [(1, "WEST"), (1, "STORE:7")], members)
    assert {row.rtl_loc_id for row in eligible_stores(tables).collect()} == {"1", "2", "7"}


@pytest.mark.parametrize("scopes, inside", [
    ([(1, "STORE:2")], [2]), ([(1, "STORE:*:*")], [1, 2]), ([(9, "STORE:1")], []),
])
def test_every_store_mark(spark, scopes, inside):
    eligible = eligible_stores(config(spark, [(1, ON)], scopes))
    stores = spark.createDataFrame([(1,), (2,)], "rtl_loc_id bigint")
    for wanted in (True, False):
        kept = by_eligibility(stores, eligible, wanted, CODES).orderBy("rtl_loc_id").collect()
        want = [store for store in (1, 2) if (store in inside) is wanted]
        assert [row.rtl_loc_id for row in kept] == want


def test_session_pair_appears_once(spark):
    controls = spark.createDataFrame(
        [(1, 1, 5, 5), (1, 1, 5, 6), (1, 1, None, 6)],
        "organization_id int, rtl_loc_id bigint, outbound_session_id bigint, "
        "inbound_session_id bigint",
    )
    sessions = spark.createDataFrame(
        [(1, 1, 5), (1, 1, 6)], "organization_id int, rtl_loc_id bigint, session_id bigint"
    )
    assert session_matches(controls, sessions).count() == 4


def test_surplus_against_brute_force(spark):
    r = random.Random(5)
    money = [Decimal(n) / 4 for n in range(-300, 900, 7)] + [None, Decimal(64), Decimal(128)]
    lines = [(n, r.choice([1, 1, 1, 2, 3]), r.choice(money)) for n in range(120)]
    values = [(r.choice([1, 1, 1, 2, 4]), r.choice(money)) for _ in range(200)]
    got = {
        row.n: row.over
        for row in surplus_over(
            spark.createDataFrame(lines, "n int, k int, amt decimal(17,6)"),
            spark.createDataFrame(values, "k int, v decimal(17,6)"), ["k"], "amt", "v", "over",
        ).collect()
    }
    assert len(got) == len(lines)
    for n, key, amount in lines:
        below = [
            amount - v for k, v in values
            if k == key and None not in (amount, v) and amount - v > 0
        ]
        assert got[n] == (sum(below) if below else None)


def test_numbering_in_blocks_is_row_number(spark, monkeypatch):
    from tenderflow.sources import from_orders

    monkeypatch.setattr(from_orders, "BLOCK", 16)
    df = spark.range(500).select((F.col("id") * 7 % 501).alias("id"), (F.col("id") % 3).alias("g"))
    numbered = number_within(df, ["g"], "id", "n").collect()
    for group in range(3):
        rows = sorted((row.id, row.n) for row in numbered if row.g == group)
        assert [n for _, n in rows] == list(range(1, len(rows) + 1))
