import collections

import pytest

from veridoc.llm import common, mixing, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, duck, sf):
    d = f"/root/testdata/{sf}"
    df = registry.op3_source_mixing(spark, d)
    rel = duck(d).execute(registry.oracle_sql()["op3_source_mixing"])
    names = [c[0] for c in rel.description]
    assert names == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


def cells_of(spark, sf="sf0.01"):
    return mixing.described(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).groupBy(*mixing.MARGINS).agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "tokens")


def margins_of(cells, raked, budget):
    """The drawn part of each value, by the probabilities, and the targets"""
    rates, shares = raked
    tokens = {(r.source, r.lang, r.topic): r.tokens for r in cells.collect() if r.tokens}
    got = {m: collections.Counter() for m in mixing.MARGINS}
    for r in rates.collect():
        for m in mixing.MARGINS:
            got[m][r[m]] += r.probability * tokens[r.source, r.lang, r.topic] / sum(tokens.values()) / budget
    return got, {m: {r.value: r.target for r in shares[m].collect()} for m in mixing.MARGINS}


def test_raked_cells_meet_their_margins(spark):
    cells = cells_of(spark)
    got, want = margins_of(cells, mixing.rake(cells), mixing.BUDGET)
    for m in mixing.MARGINS:
        assert abs(sum(want[m].values()) - 1) < 1e-9
        assert all(abs(got[m][v] - want[m][v]) < 1e-3 for v in want[m]), [(v, got[m][v], want[m][v]) for v in want[m] if abs(got[m][v] - want[m][v]) > 1e-3]


def test_given_targets_are_met(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    given = {"lang": {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}, "topic": {"short": 0.3}}
    cells = cells_of(spark, "sf0.1")
    got, want = margins_of(cells, mixing.rake(cells, 0.2, given, tolerance=1e-7), 0.2)
    assert all(abs(want["lang"][v] - x) < 1e-9 for v, x in given["lang"].items()) and abs(want["topic"]["short"] - 0.3) < 1e-9
    assert all(abs(got[m][v] - want[m][v]) < 1e-5 for m in mixing.MARGINS for v in want[m])
    # the documents that are drawn have these margins too, and the budget
    rows = mixing.draw(df, budget=0.2, targets=given).collect()
    taken, total = [r for r in rows if r.drawn], sum(r.n_tokens for r in rows)
    tokens = sum(r.n_tokens for r in taken)
    assert abs(tokens - 0.2 * total) < 0.02 * total
    for v, x in given["lang"].items():
        assert abs(sum(r.n_tokens for r in taken if r.lang == v) / tokens - x) < 0.05
    for wrong in ({"lang": {"en": 0.7, "de": 0.6}}, {"author": {"x": 1}}, {"lang": {"en": -0.1}}):
        with pytest.raises(ValueError):
            mixing.rake(cells, 0.2, wrong)


def test_saturated_cells_leave_their_rest_to_others(spark):
    rows = [("a", "en", "x", 300), ("a", "de", "x", 700), ("b", "en", "x", 50), ("b", "de", "x", 950), ("c", "en", "x", 1600), ("c", "de", "x", 400)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    given = {"source": {"a": 0.3, "b": 0.3, "c": 0.4}, "lang": {"en": 0.5, "de": 0.5}}
    got, want = margins_of(cells, mixing.rake(cells, 0.5, given, tolerance=1e-7), 0.5)
    for m in mixing.MARGINS:
        assert all(abs(got[m][v] - want[m][v]) < 1e-4 for v in want[m]), (m, got[m], want[m])
    # more than all tokens of a value can't be drawn: what is over goes to the others
    got, want = margins_of(cells, mixing.rake(cells, 0.5, {"lang": {"en": 0.1, "de": 0.9}, "source": {"b": 0.9, "a": 0.05, "c": 0.05}}), 0.5)
    assert abs(want["source"]["b"] - 0.5) < 1e-9 and abs(sum(want["source"].values()) - 1) < 1e-9 and abs(want["source"]["a"] - 0.25) < 1e-9


def test_many_cells_give_the_same(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    given = {"lang": {"en": 0.6, "xx": 0.2, "de": 0.0}}
    cells = mixing.checkpointed(cells_of(spark, "sf0.001"), 1000)
    probabilities = lambda t: sorted((r.source, r.lang, r.topic, round(r.probability, 7)) for r in mixing.rake(cells, targets=t, sweeps=4)[0].collect())
    want, mixed = [probabilities(t) for t in (None, given)], sorted(r.doc_id for r in mixing.mix(df, targets=given).collect())
    assert not any(r[-1] for r in want[1] if r[1] == "de") and mixed
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rate = mixing.rates(mixing.described(df), targets=given)
    monkeypatch.setattr(mixing, "FEW_CELLS", 3)
    assert [probabilities(t) for t in (None, given)] == want
    monkeypatch.setattr(mixing, "rates", lambda *a: rate)  # a join instead of a broadcast
    assert sorted(r.doc_id for r in mixing.mix(df, targets=given).collect()) == mixed


def test_a_topic_column_is_taken(spark):
    df = spark.createDataFrame([(i, "a b c", "s", "en", "news" if i % 4 else None) for i in range(40)], "doc_id long, text string, source string, lang string, topic string")
    rows = mixing.draw(df, targets={"topic": {"news": 0.5, "(none)": 0.5}}).collect()
    assert {r.topic for r in rows} == {"news", "(none)"}
    assert {(r.topic, round(r.probability, 4)) for r in rows} == {("news", round(1 / 3, 4)), ("(none)", 1.0)}


def test_drawn_tokens_near_budget(spark):
    rows = mixing.draw(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect()
    assert all(0 <= r.probability <= 1 for r in rows)
    want = sum(r.probability * r.n_tokens for r in rows)
    assert abs(sum(r.n_tokens for r in rows if r.drawn) - want) < 0.05 * want


def test_mix_gives_the_drawn_rows(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("n_chars", "probability")
    drawn = {r.doc_id for r in mixing.draw(df).collect() if r.drawn}
    out = mixing.mix(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == drawn


def test_edges(spark):
    rows = [(None, None, None, None), (1, "", "", "en"), (2, "a b", "s", "en"), (2, "a b", "s", "en"), (3, "x " * 100000, "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mixing.draw(df).collect()
    assert len(got) == 5 and {r.n_tokens for r in got} == {0, 2, 100001}
    assert len({r.drawn for r in got if r.doc_id == 2}) == 1
    assert mixing.mix(df).columns == df.columns
    assert mixing.draw(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0
    assert mixing.draw(df.drop("source", "lang")).count() == 5
    assert mixing.draw(spark.createDataFrame([(1, None, "s", "l")], df.schema)).count() == 1
    clash = df.selectExpr("doc_id", "text", "source", "lang", "1 AS probability", "2 AS _probability", "'x' AS __source", "3 AS drawn")
    assert mixing.mix(clash).columns == clash.columns and mixing.mix(clash).count() == mixing.mix(df).count()
