"""Questions, plans, names, readers and small operators on hand-checked cases."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ravelin.functions import stats
from ravelin.functions.names import format_number, humanize, name_tokens, same_word
from ravelin.functions.periods import last_is_complete, suggest_grain
from ravelin.operators import documents, forecast, kpi, quality
from ravelin.plans.answers import sentence
from ravelin.plans.compile import compile_plan
from ravelin.plans.ir import Filter, Operation, QueryPlan
from ravelin.plans.nl import Parser, ask
from ravelin.sources import readers


@pytest.fixture(scope="module")
def orders(spark, data):
    return spark.read.parquet(f"{data}/orders.parquet")


@pytest.fixture(scope="module")
def parser(orders):
    return Parser(orders)


@pytest.mark.parametrize(("text", "operation", "column", "other"), [
    ("How many orders are there?", Operation.COUNT, "o_orderkey", None),
    ("What is the total price in 1996?", Operation.SUM, "o_totalprice", None),
    ("average total price by order priority", Operation.AVERAGE, "o_totalprice", "o_orderpriority"),
    ("top 5 customers by total price", Operation.TOP_N, "o_totalprice", "o_custkey"),
    ("Which order has the highest total price?", Operation.ARGMAX, "o_totalprice", "o_orderkey"),
    ("monthly total price", Operation.CHART, "o_totalprice", "o_orderdate"),
])
def test_questions(parser, text, operation, column, other):
    p = parser.parse(text).plan
    assert (p.operation, p.column) == (operation, column)
    assert other in (None, p.subject, p.group_by)


def test_unknown_words_are_refused(orders, parser):
    q, result = ask(orders, "total price in Atlantis region", parser)
    assert result is None and "atlantis" in q.unresolved and "atlantis" in sentence(q, result)


def test_at_least_is_one_filter(parser):
    p = parser.parse("number of customers with total price at least 200,000").plan
    assert p.filters == (Filter("o_totalprice", ">=", 200000.0),)


def test_unknown_column_is_refused(orders):
    with pytest.raises(ValueError, match="unknown column"):
        compile_plan(QueryPlan(Operation.SUM, "nothing"), orders)
    with pytest.raises(ValueError, match="no number"):
        compile_plan(QueryPlan(Operation.SUM, "o_orderstatus"), orders)


def test_names():
    assert name_tokens("totalSales_2024 ID") == ["total", "sales", "2024", "id"]
    assert same_word("categories", "category") and same_word("priced", "price") and not same_word("cat", "category")
    assert humanize("o_orderDate") == "Order date"
    assert [format_number(x) for x in (1234567, 2.5, None, float("nan"), 0.1234567)] == ["1,234,567", "2.5", "no value", "no value", "0.12"]


def test_periods():
    assert last_is_complete(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 26), "M") and not last_is_complete(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 10), "M")
    assert suggest_grain(100, dt.datetime(2024, 1, 1), dt.datetime(2024, 3, 1)) == "D" and suggest_grain(10, None, None) is None


def test_empty_sums_are_zero(spark):
    d = spark.createDataFrame([], "g string, x double")
    assert compile_plan(QueryPlan(Operation.SUM, "x"), d).first()[0] == 0.0
    assert compile_plan(QueryPlan(Operation.AVERAGE, "x"), d).first()[0] == 0.0
    assert compile_plan(QueryPlan(Operation.MAX, "x"), d).first()[0] is None


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 40), st.floats(0.01, 60))
def test_chi_square_tail(k, x):
    # against a plain numeric integral of the density
    t = np.linspace(1e-9, 1, 20001) if k < 0 else np.linspace(x, x + 40 * k + 400, 400001)
    density = np.exp((k / 2 - 1) * np.log(t) - t / 2 - (k / 2) * np.log(2) - __import__("math").lgamma(k / 2))
    assert stats.chi2_sf(x, k) == pytest.approx(np.trapezoid(density, t), abs=2e-4)


def test_roles(spark):
    rows = [(i, f"N{i % 3}", float(i) / 7, "same", i % 2, dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(30)]
    d = spark.createDataFrame(rows, "row_id long, kind string, amount double, fixed string, flag int, at timestamp_ntz")
    assert {c.name: c.role for c in quality.infer_schema(d).columns} == {"row_id": "identifier", "kind": "dimension", "amount": "measure", "fixed": "constant", "flag": "binary", "at": "time"}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('day;amount;name;name\n2024-01-05;"1,200.5";x;y\n2024-02-05;3;z;\n')
    d = readers.load(spark, str(tmp_path / "a.csv"))
    assert d.columns == ["day", "amount", "name", "name_1"] or len(d.columns) == 4
    assert dict(d.dtypes)["amount"] == "double" and dict(d.dtypes)["day"] == "timestamp_ntz"
    assert readers.page(d, limit=1)["total_rows"] == 2
    with pytest.raises(ValueError, match="unsupported"):
        readers.load(spark, "x.doc")


def test_kpi_errors():
    with pytest.raises(ValueError, match="op must be"):
        kpi.parse({"kpis": [{"name": "a", "value": {"table": "t", "op": "power"}}]})


def test_chunks():
    parts = documents.chunks("# A\n\n" + "one two three four five six seven eight nine\n\n## B\n\n" + "x " * 700 + "\n\n" + "y " * 30)
    assert [h for h, _ in parts] == ["A", "A > B", "A > B"]
    assert documents.grounded("It rose 25 percent", ["25"]) and not documents.grounded("It rose 26 percent", ["25"])


def test_forecasts():
    y = np.arange(24.0)
    assert forecast.drift(y, 12, 2).tolist() == [24.0, 25.0]
    assert forecast.seasonal_naive(y, 12, 3).tolist() == [12.0, 13.0, 14.0]
    for name in forecast.MODELS:
        f = forecast.forecast_one(name, 100 + 10 * np.sin(np.arange(48) * np.pi / 6), 12, 3)
        assert len(f) == 3 and np.isfinite(f).all() and (f >= 0).all()


def test_stream(spark, data, tmp_path):
    from ravelin.streaming.windows import tumbling

    schema = spark.read.parquet(f"{data}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{data}/events.parquet").write.parquet(str(tmp_path / "in/e"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/e"))
    q = tumbling(stream, "ts", "1 day", "2 hours", ["event_type"], F.count(F.lit(1)).alias("n")).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("daily").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{data}/events.parquet").count()


@pytest.mark.parametrize(("text", "pipeline"), [("Forecast total price for the next months by order status", "forecast"), ("Why did total price drop", "why"), ("check the data quality", "quality"), ("find unusual orders", "anomaly"), ("explore patterns", "explore")])
def test_goals(orders, parser, text, pipeline):
    from ravelin.plans import goals

    g = goals.interpret(text, parser)
    assert g.pipeline == pipeline and not g.missing
    assert goals.run(g, orders, parser.schema, text).count() >= 0


def test_goal_without_time_is_refused(spark):
    from ravelin.plans import goals

    d = spark.createDataFrame([("a", 1.5), ("b", 2.5), ("c", 9.0)] * 10, "kind string, amount double")
    g = goals.interpret("forecast the amount", Parser(d))
    assert g.missing == ("a time column",)
    with pytest.raises(ValueError, match="time column"):
        goals.run(g, d, Parser(d).schema)


def test_index(spark, tmp_path):
    (tmp_path / "k").mkdir()
    (tmp_path / "k/a.md").write_text("# Returns\n\nGoods may be returned within 30 days of delivery to the warehouse.\n\n# Prices\n\nPrices are set every quarter by the board of the company.\n")
    first = documents.save_index(spark, str(tmp_path / "k"), str(tmp_path / "i"))
    assert first == documents.fingerprint(spark, str(tmp_path / "k"))
    hit = documents.search_index(spark, str(tmp_path / "i"), "when can goods be returned?").first()
    assert hit["id"].endswith("#0")
    text = "Goods may be returned within 30 days of delivery."
    assert documents.best_sentences("When are goods returned?", [("a", text)]) == [(text, "a")]
    assert not documents.cited("Goods are returned within 30 days [a].", {"a": text}) and documents.cited("It takes 31 days [a].", {"a": text})


def test_store(spark, data, tmp_path):
    from ravelin.sources.store import Store, add_document

    store = Store(spark, most=1)
    b = store.load("shop", {t: f"{data}/{t}.parquet" for t in ("orders", "customer", "nation")})
    assert "c_name" in b.table("orders").columns and b.schema("orders").rows == b.catalog.tables["orders"].count()
    assert ask(b.table("orders"), "How many orders are there?", b.parser("orders"))[1].first()[0] == 1500
    store.load("other", {"region": f"{data}/region.parquet"})
    assert store.names() == ["other"]
    with pytest.raises(KeyError):
        store.get("shop")
    assert add_document(str(tmp_path), "../notes on x.md", b"# A").name == "notes_on_x.md"
    with pytest.raises(ValueError, match="only"):
        add_document(str(tmp_path), "a.exe", b"")


def test_target_report(spark, data):
    from ravelin.operators.report import markdown

    d = spark.read.parquet(f"{data}/lineitem.parquet").withColumn("returned", (F.col("l_returnflag") == "R").cast("int"))
    text = markdown(d, quality.infer_schema(d), "returned")
    assert "# Target returned" in text and "l_returnflag: tells the target almost surely" in text
