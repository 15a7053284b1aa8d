import datetime as dt
import itertools
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift
from tidemark.operators.tree_edit import ADD, DELETE, NEVER, _listed, assign, edit_script, pair_cost, schema_tree

SCHEMA = "order_id string, price decimal(12,2), due timestamp, _rescued_data string, _feed string, _batch_date date"


def ops(old, new):
    return [(e.op, e.old_path, e.new_path) for e in edit_script(schema_tree(old), schema_tree(new))[1]]


@pytest.mark.parametrize("seed", range(6))
def test_assignment_is_cheapest(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 5)
    cost = [[rng.randint(0, 20) for _ in range(n)] for _ in range(n)]
    best = min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
    got = assign(cost)
    assert sorted(got) == list(range(n)) and sum(cost[i][got[i]] for i in range(n)) == best


def test_scripts():
    assert ops([("a", "number")], [("a", "number")]) == []
    assert ops([("a", "number")], [("a", "text")]) == [("retyped", "a", "a")]
    assert ops([("price", "number")], [("preco", "number")]) == [("renamed", "price", "preco")]
    assert ops([("price", "number")], [("note", "text")]) == [("added", "", "note"), ("removed", "price", "")]
    assert ops([("price", "number")], [("price", "text"), ("cost", "number")]) == [("added", "", "cost"), ("retyped", "price", "price")]
    assert ops([("packed_at", "timestamp"), ("ship_by", "timestamp")], [("packing_ts", "timestamp"), ("shipping_by", "timestamp")]) == [("renamed", "packed_at", "packing_ts"), ("renamed", "ship_by", "shipping_by")]
    assert ops([("box", "object"), ("box.size", "text"), ("box.g", "number")], [("parcel", "object"), ("parcel.size", "text")]) == [("removed", "box.g", ""), ("renamed", "box", "parcel")]
    assert ("moved", "box.size", "lid.size") in ops([("box", "object"), ("box.size", "text"), ("lid", "object")], [("box", "object"), ("lid", "object"), ("lid.size", "text")])
    assert ops([], []) == [] and edit_script(schema_tree([]), schema_tree([("a.b", "text")]))[0] == 2


def test_kinds(spark):
    values = ["12", "-1.5e3", "TRUE", "2024-04-01", "2024-04-01T10:00:00", '{"a":1}', "R$ 5", "", "{broken", "13,56", "1715219356", None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(drift.kind_of(F.col("v"))).collect()]
    assert got == ["number", "number", "boolean", "timestamp", "timestamp", "object", "text", "text", "text", "text", "number", None]


def deliveries(spark):
    day = lambda n: dt.date(2024, 4, n)
    out = []
    for i in range(5):
        out.append((f"a{i}", Decimal(10 + i), None, json.dumps({"gift": "true"}), "f0", day(1)))
        out.append((f"b{i}", None, None, json.dumps({"preco": f"{20 + i}.5", "gift": "true", "box": json.dumps({"g": 5})}), "f0", day(2)))
        out.append((f"c{i}", None, None, json.dumps({"price": f"R$ {30 + i},25", "wrapped": "false", "stray": "1" if i < 2 else None}), "f0", day(3)))
        out.append((f"d{i}", Decimal(1), None, None, "f1", day(1)))
    out.append(("x", None, None, None, None, day(1)))
    return spark.createDataFrame(out, SCHEMA)


def test_changes_between_deliveries(spark, rows):
    schemas = drift.delivery_schemas(deliveries(spark), "_feed", "_batch_date", ["price", "due"], "_rescued_data")
    got = rows(drift.top_level_changes(drift.schema_scripts(schemas)), "feed", "day", "field_name", "change")
    assert got == sorted([("f0", dt.date(2024, 4, 2), "preco", "renamed"), ("f0", dt.date(2024, 4, 2), "box", "added"), ("f0", dt.date(2024, 4, 3), "box", "removed"), ("f0", dt.date(2024, 4, 3), "price", "added"), ("f0", dt.date(2024, 4, 3), "preco", "removed"), ("f0", dt.date(2024, 4, 3), "wrapped", "renamed")], key=str)


@pytest.mark.parametrize("most", [5_000, 1])
def test_all_deliveries_in_one_table(spark, rows, monkeypatch, most):
    monkeypatch.setattr(drift, "MOST_MAPS", most)  # the second joins by key
    df = deliveries(spark).withColumn("names", F.lit("mine")).withColumn("extra_fields", F.lit(1))
    schemas = drift.delivery_schemas(df, "_feed", "_batch_date", ["price", "due"], "_rescued_data")
    names = drift.steady_names(schemas, drift.schema_scripts(schemas), ["price", "due"])
    got = drift.unify(df, "_feed", "_batch_date", ["price", "due"], "_rescued_data", names, ["order_id"])
    by = {r["order_id"]: r for r in got.collect()}
    assert len(by) == df.count() and dict(got.dtypes)["price"] == "decimal(12,2)"
    assert float(by["a1"]["price"]) == 11 and float(by["b1"]["price"]) == 21.5 and float(by["c1"]["price"]) == 31.25
    assert by["b1"]["extra_fields_"]["gift"] == "true" and by["c1"]["extra_fields_"]["gift"] == "false" and by["c1"]["names"] == "mine"


def test_values_in_other_forms(spark):
    n = [r[0] for r in spark.createDataFrame([(v,) for v in ['{"amount":49.25,"currency":"BRL"}', "1.234,50 cr.", "17,47 BRL", "x", None]], "v string").select(drift.number_from(F.col("v"))).collect()]
    assert [x and float(x) for x in n] == [49.25, 1234.5, 17.47, None, None]
    t = [r[0] for r in spark.createDataFrame([(v,) for v in ["18/04/2024 16h19", "1715144592", "2024-04-18T16:19:00", "soon", None]], "v string").select(drift.timestamp_from(F.col("v"))).collect()]
    assert t == [dt.datetime(2024, 4, 18, 16, 19), dt.datetime(2024, 5, 8, 5, 3, 12), dt.datetime(2024, 4, 18, 16, 19), None, None]


def test_empty(spark, rows):
    df = deliveries(spark).limit(0)
    schemas = drift.delivery_schemas(df, "_feed", "_batch_date", ["price", "due"], "_rescued_data")
    assert rows(drift.top_level_changes(drift.schema_scripts(schemas))) == []


def cheapest(old, new):
    """All one-to-one matchings of fields, each costed by the definition."""
    olds, news = _listed(old), _listed(new)
    best = NEVER

    def walk(i, match):
        nonlocal best
        if i == len(olds):
            back = {b: a for a, b in match.items()}
            total = 0.0
            for a, b in match.items():
                for name, c in olds[a].below.items():  # a name that stays under matching parents stays itself
                    if name in news[b].below and match.get(c) != news[b].below[name]:
                        return
                if a:
                    total += pair_cost(olds[a].node, news[b].node, match.get(olds[a].parent) == news[b].parent)
            total += DELETE * sum(a not in match for a in range(len(olds))) + ADD * sum(b not in back for b in range(len(news)))
            best = min(best, total)
            return
        walk(i + 1, match)
        for j in range(1, len(news)):
            if j not in match.values():
                walk(i + 1, match | {i: j})

    walk(1, {0: 0})
    return best


def random_schema(rng, most):
    out, objects = {}, [""]
    for _ in range(rng.randint(1, most)):
        name, kind = rng.choice("abcd"), rng.choice(["number", "text", "object"])
        path = ".".join(x for x in (rng.choice(objects), name) if x)
        if path not in out:
            out[path] = kind
            if kind == "object":
                objects.append(path)
    return sorted(out.items())


@pytest.mark.parametrize("seed", range(120))
def test_scripts_cost_the_least(seed):
    rng = random.Random(seed)
    old, new = (schema_tree(random_schema(rng, 5)) for _ in range(2))
    assert edit_script(old, new)[0] == pytest.approx(cheapest(old, new))


def test_moves_are_weighed_with_the_rest():
    old = [("p", "object"), ("p.a", "number"), ("q", "object"), ("r", "object"), ("r.b", "number")]
    new = [("p", "object"), ("p.b", "number"), ("q", "object"), ("q.a", "number"), ("r", "object")]
    cost, script = edit_script(schema_tree(old), schema_tree(new))
    assert cost == pytest.approx(2.4) and [(e.op, e.old_path, e.new_path) for e in script] == [("moved", "p.a", "q.a"), ("moved", "r.b", "p.b")]


def test_numbers_and_texts_are_read_whole_or_not_at_all(spark):
    read = lambda f, *v: [r[0] for r in spark.createDataFrame([(x,) for x in v], "v string").select(f(F.col("v"))).collect()]
    assert read(drift.number_from, "order 66 pending", "SKU-12", "5 of 7", "12 3", "1.2.3", "", "{}", '{"a":1,"b":2}', "--5", "5-") == [None] * 10
    assert [float(x) for x in read(drift.number_from, "1,234.56", "1.234,56", "1,234,567", "-77,65 BRL", "R$ 31,25", " 7 ", "+.5", "1e3", '{"n":"4,5 cr.","u":"BRL"}')] == [1234.56, 1234.56, 1234567, -77.65, 31.25, 7, 0.5, 1000, 4.5]
    assert read(drift.timestamp_from, "2024", "at 2024-04-01T10:00:00", "18/04/2024 16h19 or so", "31/02/2024 10h00", "") == [None] * 5
    assert read(drift.text_from, '{"code":"x\\"y","v":3}', '{"a":"b","c":"d"}', "{broken", "plain") == ['x\\"y', None, "{broken", "plain"]


def test_every_step_is_compiled():
    days = [dt.date(2024, 4, n) for n in range(1, 6)]
    fields = [["box", "box.g", "box.size", "n"], ["parcel", "parcel.g", "parcel.size", "n"], ["g", "parcel", "parcel.size", "m"], ["g", "parcel", "parcel.size", "m", "n"], ["price", "parcel", "parcel.size"]]
    scripts = {days[1]: [("box", "parcel")], days[2]: [("parcel.g", "g"), ("n", "m")], days[4]: [("m", "price")]}
    got = dict(drift.steady_paths(list(zip(days, fields)), scripts, {"price"}))
    assert got[days[0]] == {}
    assert got[days[1]] == {"parcel": "box", "parcel.g": "box.g", "parcel.size": "box.size"}
    assert got[days[2]] == {"g": "box.g", "parcel": "box", "parcel.size": "box.size", "m": "n"}
    assert got[days[3]] == {"g": "box.g", "parcel": "box", "parcel.size": "box.size", "m": "n", "n": "n_2"}  # a new field of an old name
    assert got[days[4]] == {"parcel": "box", "parcel.size": "box.size"}


def test_deep_fields_moves_and_unreadable_values_in_one_table(spark, rows):
    day = lambda n: dt.date(2024, 4, n)
    deep = lambda v, **more: json.dumps({"a": json.dumps({"b": {"c": {"d": v}}}), **more})
    data = [(f"a{i}", None, None, deep(i, k="1"), "f0", day(1)) for i in range(3)] + [(f"b{i}", None, None, json.dumps({"a": json.dumps({"b": {"c": {}, "d": i}}), "j": "2", "price": "soon" if i else "{\"amount\":7,\"currency\":\"BRL\"}"}), "f0", day(2)) for i in range(3)]
    df = spark.createDataFrame(data, SCHEMA)
    assert drift.nesting(df, "_rescued_data") == 4
    schemas = drift.delivery_schemas(df, "_feed", "_batch_date", ["price", "due"], "_rescued_data")
    assert "a.b.c.d" in {r["path"] for r in schemas.collect()}
    scripts = drift.schema_scripts(schemas)
    assert ("moved", "a.b.c.d", "a.b.d") in set(rows(scripts, "op", "old_path", "new_path"))
    out = drift.unify(df, "_feed", "_batch_date", ["price", "due"], "_rescued_data", drift.steady_names(schemas, scripts, ["price", "due"]), ["order_id"])
    by = {r["order_id"]: (r["price"], r["extra_fields"]) for r in out.collect()}
    assert by["a1"] == (None, {"a.b.c.d": "1", "k": "1"})
    assert by["b0"] == (Decimal(7), {"a.b.c.d": "0", "k": "2"}) and by["b1"] == (None, {"a.b.c.d": "1", "k": "2", "price": "soon"})


def test_no_nesting_no_rows(spark):
    assert drift.nesting(spark.createDataFrame([(None,), ("",), ('{"a":"1"}',), ("{",)], "_rescued_data string"), "_rescued_data") == 1
    assert drift.nesting(spark.createDataFrame([], "_rescued_data string"), "_rescued_data") == 1
