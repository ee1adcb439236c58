"""Operators against brute force and golden values."""

from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlgate.functions import normalize as norm
from marlgate.operators import incremental, profile, snapshots, trailing, units
from marlgate.operators.knowntime import PersistentTree, known_facts


def test_spellings(spark):
    rows = [("000001.sz", "20220131", "1.0"), (" SH600000 ", "2022-01-31", " 2"), ("600000", "20220132", "x"), ("bj.830001", "220131", "1.5"), (None, "", None), ("830001.BJ", "2022/01-31", "3")]
    got = spark.createDataFrame(rows, "c string, d string, t string").select(norm.market_code("c"), norm.day_text(norm.real_day("d")), norm.digits_of_number("t")).collect()
    assert [tuple(r) for r in got] == [("000001.SZ", "20220131", "1"), ("600000.SH", "20220131", "2"), (None, None, None), ("830001.BJ", None, None), (None, None, None), ("830001.BJ", None, "3")]


@pytest.mark.parametrize(("text", "number", "unit"), [
    ("12.5 lots", 12.5, "lot"), ("1,234,500shares", 1234500, "share"), ("0.9900 10k shares", 0.99, "ten thousand shares"), ("１２．５万股", 12.5, "ten thousand shares"),
    ("1.0883e+02 X10^4 Shares", 108.83, "ten thousand shares"), ("lots 10564", 10564, "lot"), ("3 万手", 3, "ten thousand lots"), ("N/A", None, None), ("", None, None), ("7 bushels", 7, None),
    ("-5 手", -5, "lot"), ("4 m shares", 4, "million shares"), ("100 sharesh", 100, None), ("12 " + "x" * 100_000, 12, None),
    ("2022 report: 12.5 lots", 12.5, "lot"), ("lot 7 of 2022", 7, "lot"),
])
def test_unit_finder_volume(text, number, unit):
    assert units.UnitFinder("volume").read(text) == (number, unit)


@pytest.mark.parametrize(("text", "number", "unit"), [
    ("RMB '000 10007.022", 10007.022, "thousand yuan"), ("9.5m yuan", 9.5, "million yuan"), ("3.2万", 3.2, "ten thousand yuan"), ("3.2亿元", 3.2, "hundred million yuan"),
    ("CNY x10^4 822.2175", 822.2175, "ten thousand yuan"), ("88 100mn yuan", 88, "hundred million yuan"), ("5.5 RMB million", 5.5, "million yuan"),
])
def test_unit_finder_money(text, number, unit):
    assert units.UnitFinder("money").read(text) == (number, unit)


def test_units_stated_by_an_alias(spark):
    """Aliases count in feed_units too; a unit that can't be read is reported and states nothing."""
    stated = [("f", "stock", "vol", "万股", "20220101", None), ("f", "stock", "amount", "千元", None, None), ("g", "stock", "vol", "bushels", None, None), ("g", "stock", "amount", " K CNY ", None, None)]
    feed_units = spark.createDataFrame(stated, "feed string, asset_type string, field_name string, unit_text string, valid_from string, valid_until string")
    got = {(r["feed"], r["field_name"]): (r["pow10"], r["readable"], r["valid_from"]) for r in units.stated_units(feed_units).collect()}
    assert got == {("f", "vol"): (4, True, "20220101"), ("f", "amount"): (3, True, "00010101"), ("g", "vol"): (None, False, "00010101"), ("g", "amount"): (3, True, "00010101")}
    schema = "row_id long, feed string, asset_type string, trade_date string, open double, high double, low double, close double, vol string, vol_unit string, amount string, amount_unit string"
    rows = [(1, "f", "stock", "20220105", 10.0, 10.0, 10.0, 10.0, "5", None, "500", None), (2, "f", "stock", "20220105", 10.0, 10.0, 10.0, 10.0, "50000", "股", "500", None), (3, "g", "stock", "20220105", 10.0, 10.0, 10.0, 10.0, "5", "lot", "5", None)]
    fed = {r["row_id"]: r for r in units.resolve_feed_units(spark.createDataFrame(rows, schema), feed_units).collect()}
    assert (fed[1]["vol_stated"], fed[1]["vol_pow10"], fed[1]["amount_pow10"]) == (4, 4, 3)
    assert (fed[2]["vol_stated"], fed[2]["vol_pow10"]) == (4, 0)
    assert (fed[3]["vol_stated"], fed[3]["vol_pow10"], fed[3]["amount_pow10"]) == (None, 2, 3)


def test_difference_of_sorted_arrays():
    keys, kinds = snapshots.difference(np.array([1, 3, 5]), np.array([1, 1, 1]), np.array([3, 5, 9]), np.array([1, 2, 1]))
    assert sorted(zip(keys.tolist(), snapshots.KINDS[kinds].tolist(), strict=True)) == [(1, "removed"), (5, "changed"), (9, "added")]
    empty = np.array([], dtype=np.int64)
    assert snapshots.difference(empty, empty, np.array([4]), np.array([0]))[0].tolist() == [4]
    assert snapshots.difference(np.array([4]), np.array([0]), empty, empty)[1].tolist() == [1]


def test_buckets_do_not_change_the_differences(spark):
    rng = random.Random(3)
    rows = [(s, f"2022{m:02d}01", f"c{i}", rng.choice([1, 2, None])) for s in "ab" for m in range(1, 6) for i in range(30) if rng.random() < 0.8]
    frame = spark.createDataFrame(rows, "series string, snapshot string, item string, w int")
    one, many = (sorted(map(tuple, snapshots.snapshot_changes(frame, ["w"], n).collect()), key=str) for n in (1, 7))
    assert one == many
    held = {}
    for s, d, i, w in rows:
        held.setdefault(s, {}).setdefault(d, {})[i] = w
    want = []
    for s, days in held.items():
        order = sorted(days)
        for a, b in zip(order, order[1:], strict=False):
            for i in days[a].keys() | days[b].keys():
                if i not in days[a]:
                    want.append((s, b, i, "added"))
                elif i not in days[b]:
                    want.append((s, b, i, "removed"))
                elif days[a][i] != days[b][i]:
                    want.append((s, b, i, "changed"))
    assert sorted(r[:4] for r in one) == sorted(want)


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 3), st.integers(0, 15), st.integers(0, 12)), max_size=60), st.lists(st.tuples(st.integers(0, 4), st.integers(0, 17)), max_size=25), st.booleans(),
)
def test_known_facts(facts, events, exact):
    columns = [np.array([f[i] for f in facts], dtype="int64") for i in range(3)]
    entity, known, valid = columns[0], columns[1], columns[2] * (not exact)
    got = known_facts(entity, valid, known, np.array([e for e, _ in events], dtype="int64"), np.array([d for _, d in events], dtype="int64"), exact)
    for (e, day), found in zip(events, got.tolist(), strict=True):
        seen = {}
        for i in np.lexsort((np.arange(len(facts)), known)).tolist():
            if entity[i] == e and known[i] < day and (exact or valid[i] <= day):
                seen[int(valid[i])] = i
        assert found == (seen[max(seen)] if seen else -1)


def test_versions_of_the_tree_share_nodes():
    keys = np.arange(100, dtype="int64") * 3
    places = np.array([50, 10, 90, 10, 0, 99])
    tree = PersistentTree(keys, places)
    assert sum(map(len, tree.sides)) == len(places) * 7  # a path each, no copied tree
    assert tree.get(np.array([0, 1, 3, 5]), keys[[10, 10, 10, 50]]).tolist() == [-1, 1, 3, 0]
    assert tree.floor(np.array([1, 2, 4, 5]), np.array([29, 1000, 2, 298])).tolist() == [-1, 2, 4, 5 if keys[99] <= 298 else 2]


def test_trailing_windows_equal_plain_sums(spark):
    rng = random.Random(5)
    start = date(2022, 1, 1)
    rows = [(a, start + timedelta(days=n), float(rng.randint(0, 9))) for a in "xy" for n in range(90) if rng.random() < 0.6]
    frame = spark.createDataFrame(rows, "e string, d date, v double")
    windows = [1, 2, 3, 5, 7, 30, 31]
    got = trailing.trailing_sums(trailing.dense_days(frame, "e", "d", ["v"]), "e", "cal_day", ["v"], windows).collect()
    by = {(e, d): v for e, d, v in rows}
    spans = {a: [d for e, d, _ in rows if e == a] for a in "xy"}
    assert len(got) == sum((max(s) - min(s)).days + 1 for s in spans.values())
    for r in got:
        for n in windows:
            assert r[f"v_{n}d"] == sum(by.get((r["e"], r["cal_day"] - timedelta(days=k)), 0.0) for k in range(n))
    with pytest.raises(ValueError):
        trailing.trailing_sums(frame, "e", "d", ["v"], [0])


def log(spark, rows):
    schema = "row_id long, trade_date string, ts_code string, open double, high double, low double, close double, pre_close double, volume double, turnover double, load_id int"
    return spark.createDataFrame([(i, d, c, 1.0, 1.0, 1.0, float(p), 1.0, 1.0, 1.0, load) for i, d, c, p, load in rows], schema)


def ids(frame, removed=False):
    return sorted(r["row_id"] for r in frame.where(F.col("removed") == removed).collect())


def test_increments_are_published_with_their_tree(spark, tmp_path):
    bars, folder = incremental.stock_daily_set(), str(tmp_path / "store")
    store = incremental.Generations(spark, folder)
    first = [(1, "20220103", "000001.SZ", 5, 1), (2, "20220104", "000001.SZ", 6, 1), (3, "bad", "000001.SZ", 6, 1)]
    assert store.current() is None
    assert ids(incremental.run_increment(log(spark, first), bars, store)) == [1, 2]
    assert incremental.run_increment(log(spark, first), bars, store).count() == 0
    named = store.current()
    more = [*first, (4, "20220104", "000001.SZ", 7, 2), (5, "20220105", "600000.SH", 7, 2)]

    class Broken(incremental.Generations):
        def publish(self, name):
            raise RuntimeError("executor lost before the rename")

    with pytest.raises(RuntimeError):
        incremental.run_increment(log(spark, more), bars, Broken(spark, folder))
    assert store.current() == named
    assert ids(incremental.run_increment(log(spark, more), bars, store)) == [4, 5]
    assert store.current() != named
    lost = store.recover()
    assert len(lost) == 1 and store.part("state").count() == 2 and store.part("tree", named).count() > 0
    assert store.roll_back() == named and ids(incremental.run_increment(log(spark, more), bars, store)) == [4, 5]


def test_redelivery_change_and_removal(spark, tmp_path):
    """One rule for the stored run and the test tables: records count, not rows."""
    bars, store = incremental.stock_daily_set(), incremental.Generations(spark, str(tmp_path / "store"))
    first = [(1, "20220103", "000001.SZ", 5, 1), (2, "20220104", "000001.SZ", 6, 1), (3, "20220301", "000002.SZ", 6, 1)]
    incremental.run_increment(log(spark, first), bars, store)
    again = [*first, (4, "2022-01-04", "sz000001", 6, 2)]
    assert incremental.run_increment(log(spark, again), bars, store).count() == 0  # delivered again with equal values
    gone = [*again[:2], again[3], (5, "20220105", "000001.SZ", 1, 3), (6, "20220103", "000001.SZ", 8, 3), (7, "20220103", "000001.SZ", 5, 4)]
    got = incremental.run_increment(log(spark, gone), bars, store)
    assert ids(got) == [5] and ids(got, removed=True) == [3]  # changed and changed back is no change; a vanished leaf is found
    assert incremental.run_increment(log(spark, gone), bars, store).count() == 0
    assert ids(incremental.run_increment(log(spark, [*gone, first[2]]), bars, store)) == [3]


def test_only_changed_leaves_are_descended_into(spark, tmp_path):
    bars, store = incremental.stock_daily_set(), incremental.Generations(spark, str(tmp_path / "store"))
    rows = [(i, f"2022{1 + i % 12:02d}10", f"{i:06d}.SZ", i, 1) for i in range(200)]
    incremental.run_increment(log(spark, rows), bars, store)
    first, whole = store.current(), store.part("state").count()
    assert ids(incremental.run_increment(log(spark, [*rows, (900, "20220310", "000002.SZ", 1, 2)]), bars, store)) == [900]
    assert [r["range"] for r in store.part("stale").collect()] == ["20220310"]
    assert whole == 200 and store.part("state").count() < 8  # a second run reads and writes a fraction
    held = {r["range"]: r["holder"] for r in store.part("holders").where("range in ('20220310', '20220410')").collect()}
    assert held["20220410"] == first
    months = incremental.differing_nodes(store.part("tree"), store.part("tree", first), incremental.MONTH, ["all"]).collect()
    assert [r["name"] for r in months] == ["202203"]


def test_exact_medians(spark):
    rng = random.Random(8)
    for rows in (501, 500, 1):
        values = [(rng.lognormvariate(5, 4), float(rng.randint(0, 3)), None if rows > 1 and rng.random() < 0.5 else -rng.random(), None, rng.choice([-1e-300, 0.0, -0.0, 1e300])) for _ in range(rows)]
        frame = spark.createDataFrame(values, "a double, b double, c double, d double, e double")
        got = profile.exact_medians(frame, list("abcde"))
        for i, name in enumerate("abcde"):
            seen = [v[i] for v in values if v[i] is not None]
            assert got[name] == (np.median(seen) if seen else None), (name, rows)


def test_two_sample_test_names_the_odd_load(spark):
    rng = random.Random(4)
    rows = [(i, i % 5, rng.lognormvariate(3, 0.3) * (0.01 if i % 5 == 3 else 1), rng.lognormvariate(6, 1)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "row_id long, load_id int, a double, b double")
    _, tested = profile.two_sample_test(frame, ["a", "b"])
    area = {(r["load"], r["column"]): r for r in tested.collect()}
    assert area[3, "a"]["area_alone"] > 0.95 and area[3, "a"]["area_without"] < 0.6
    assert all(r["area_alone"] < 0.6 and not r["named"] for k, r in area.items() if k[1] == "b")
    assert area[3, "a"]["area"] - area[3, "a"]["area_without"] > 0.3  # the ablation names the column too
    found = {(r["rule_name"], r["ref_id"]) for r in profile.outstanding_loads(frame, "t", ["a", "b"]).collect()}
    assert found == {("median_shift:a", 3)}


def test_every_finding_has_a_score_that_named_it_whatever_the_size(spark):
    """Loads of ten rows upwards, cases just at the half, columns where a third of the table is odd."""
    rng = random.Random(6)
    rows = []
    for load in range(60):
        n = rng.choice([10, 11, 12, 14, 40])
        kind = load % 6
        for i in range(n):
            a, b = rng.lognormvariate(3, 0.4), rng.lognormvariate(6, 0.4) * (1000 if rng.random() < 0.3 else 1)
            if kind == 1 and 2 * i < n:
                a = None
            if kind == 2 and 2 * i <= n:
                b *= 1e-3
            if kind == 3 and 2 * i + 2 < n:
                a = None  # just not half
            rows.append((len(rows), load, a, b, b if kind != 4 else None))
    frame = spark.createDataFrame(rows, "row_id long, load_id int, a double, b double, c double")
    medians, tested = profile.two_sample_test(frame, ["a", "b", "c"])
    named = {(r["load"], r["column"]) for r in tested.collect() if r["named"]}
    want = set()
    for load in range(60):
        for k, c in ((2, "a"), (3, "b"), (4, "c")):
            own = [r[k] for r in rows if r[1] == load]
            seen = [v for v in own if v is not None]
            if 2 * (len(own) - len(seen)) >= len(own):
                want.add((f"null_surge:{c}", load))
            elif not 0.1 * medians[c] <= np.median(seen) <= 10 * medians[c]:
                want.add((f"median_shift:{c}", load))
    got = {(r["rule_name"], r["ref_id"]) for r in profile.outstanding_loads(frame, "t", ["a", "b", "c"]).collect()}
    assert got == want and len(want) > 25
    assert all((load, rule.split(":")[1]) in named for rule, load in got)


def test_what_reaches_the_driver_does_not_grow_with_loads(spark):
    """Models come in blocks; a small block gives the same scores."""
    rows = [(i, i % 50, float(i % 7), float(i % 11)) for i in range(2000)]
    frame = spark.createDataFrame(rows, "row_id long, load_id int, a double, b double")
    one, many = (sorted(map(tuple, profile.two_sample_test(frame, ["a", "b"], block=n)[1].collect())) for n in (512, 7))
    assert len(one) == 100 and [r[:3] for r in one] == [r[:3] for r in many]
    assert np.allclose([r[3:6] for r in one], [r[3:6] for r in many])
