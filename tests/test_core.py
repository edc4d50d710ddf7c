import hashlib
import json

import pytest

from veridoc.functions import declared
from veridoc.operators import evidence, evolve, links, sampling
from veridoc.plans import core
from veridoc.sources import notes, register, request

SF = "/root/testdata/sf0.001"


def rows(spark_or_duck_rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(str(r[i]) for i in order) for r in spark_or_duck_rows))


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    rel = duck(SF).execute(core.ORACLE[name])
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.collect(), df.columns) == rows(rel.fetchall(), columns)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_sample_order_prefix_and_partitioning(spark):
    values = [f"c{i}" for i in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "id string")
    want = sorted(values, key=lambda v: (hashlib.sha256(f"s\n{v}".encode()).hexdigest(), v))
    assert ids(sampling.seeded_sample(df, "id", 20, "s")) == want[:20]
    assert ids(sampling.seeded_sample(df.repartition(7).orderBy("id"), "id", 21, "s")) == want[:21]
    assert ids(sampling.seeded_sample(df, "id", 0, "s")) == []
    assert len(ids(sampling.seeded_sample(df, "id", 200, "s"))) == 200


@pytest.mark.parametrize("count,seed", [(-1, "s"), (4, "s"), (1, ""), (1.0, "s"), (True, "s"), (2**53, "s")])
def test_sample_guard(spark, count, seed):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    with pytest.raises(ValueError):
        sampling.seeded_sample(df, "id", count, seed)


def test_sample_repeated_and_null_ids(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "id string, v int")
    assert [r["v"] for r in sampling.seeded_sample(df, "id", 2, "s").collect()] == [1, 2]
    with pytest.raises(ValueError):
        sampling.seeded_sample(spark.createDataFrame([(None,)], "id string"), "id", 1, "s")


def test_add_table_column_twice(spark):
    spark.sql("DROP TABLE IF EXISTS quote_letter_lines")
    spark.sql("CREATE TABLE quote_letter_lines (n INT) USING parquet")
    assert evolve.add_table_column_if_absent(spark, "quote_letter_lines", "letter_date", "date")
    assert not evolve.add_table_column_if_absent(spark, "quote_letter_lines", "Letter_Date", "date")
    assert spark.table("quote_letter_lines").dtypes == [("n", "int"), ("letter_date", "date")]
    with pytest.raises(Exception):
        evolve.add_table_column_if_absent(spark, "no_such_table", "x", "date")


def test_reconcile_sides_and_nulls(spark):
    a = spark.createDataFrame([("x",), ("x",), (None,)], "h string")
    b = spark.createDataFrame([("y",), (None,)], "h string")
    got = {r["h"]: (r["side"], r["n_left"], r["n_right"]) for r in evidence.hash_reconcile(a, b, "h").collect()}
    assert got == {"x": ("only_left", 2, 0), "y": ("only_right", 0, 1), None: ("both", 1, 1)}


def test_coverage_keeps_failed(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", None)], "g string, ok boolean")
    got = {r["g"]: (r["n_all"], r["n_ok"], r["n_held"]) for r in evidence.coverage(df, ["g"], df.ok).collect()}
    assert got == {"a": (2, 1, 1), "b": (1, 0, 1)}


def test_links(spark):
    df = spark.createDataFrame([("n1", "[[a]] and [[b::p]]"), ("n2", None), ("n3", "none")], "id string, t string")
    got = {(r.src, r.target, r.package) for r in links.extract_links(df, "id", "t").collect()}
    assert got == {("n1", "a", None), ("n1", "b", "p")}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, target string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in links.follow(edges, start, 1).collect()} == {("a", 0), ("b", 1)}
    assert {(r.node, r.depth) for r in links.follow(edges, start, 3).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_allow_list_empty_allows_nothing(spark):
    req = spark.createDataFrame([("p", "x"), ("q", "x"), ("p", "y")], "profile string, tool string")
    profiles = spark.createDataFrame([("p", ["x"]), ("q", [])], "profile string, tools array<string>")
    assert [tuple(r) for r in links.allowed(req, "tool", profiles, "profile").collect()] == [("p", "x")]


def test_declared_types(spark):
    decl = notes.parse_yaml("extends: source::base\nfields:\n  name: String\n  note?: String\n  kind: [a, b]\n  urls: String[]\n  of?: source::base*\n")
    schema = declared.schema_of(decl)
    assert [(f.name, f.nullable) for f in schema] == [("name", False), ("note", True), ("kind", False), ("urls", False), ("of", True)]
    df = spark.createDataFrame([(1, "x", "a", ["u"], 5), (2, None, "z", None, 6)], "id int, name string, kind string, urls array<string>, extra int")
    got = {(r.id, r.field, r.problem) for r in declared.violations(df, schema, "id").collect()}
    assert got == {(2, "name", "missing"), (2, "kind", "outside_domain"), (2, "urls", "missing")}
    with pytest.raises(ValueError):
        declared.schema_of({"fields": {"x": "Number"}})
    assert len(declared.schema_of({"fields": {}})) == 0


def test_notes(spark, tmp_path):
    (tmp_path / "Note one.md").write_text('---\n"type": "t"\n"document_id": "d1"\n"extra": "e"\n---\n')
    (tmp_path / "Note+two.md").write_text("---\ntype: t\nstatus: failed:zero\n---\nbody [[x]]\n")
    (tmp_path / "bad.md").write_text("no front matter")
    got = {r.file_name: r for r in notes.scan_notes(spark, str(tmp_path), ["type", "document_id", "status"]).collect()}
    assert got["Note one.md"].document_id == "d1" and got["Note one.md"].status is None
    assert got["Note+two.md"].status == "failed:zero" and got["Note+two.md"].body == "body [[x]]\n"
    assert not got["bad.md"].well_formed and got["bad.md"].type is None


def test_catalog(spark):
    got = notes.catalog(spark, {"a": "type: o\nname: A # c\nlist:\n  - x\n  - y\n"}).first()
    assert (got.type, got.fields) == ("o", {"name": "A", "list": '["x", "y"]'})


@pytest.mark.parametrize(
    "text,want",
    [
        ('name: "A # B" # c', {"name": "A # B"}),
        ("x: ['a, b', c, \"d]e\"]", {"x": ["a, b", "c", "d]e"]}),
        ("x: 'it''s'\ny: it's # so\nz: a#b", {"x": "it's", "y": "it's", "z": "a#b"}),
        ('x: "a \\" b"', {"x": 'a " b'}),
        ("a:\n  - \"[[x::y]]\"\n  - [p, [q]]\n  - true\nb: []\nc: {}\nd: ~", {"a": ["[[x::y]]", ["p", ["q"]], True], "b": [], "c": {}, "d": None}),
        ("'k: 1': v:w", {"k: 1": "v:w"}),
        ("x: [[a]] and [[b]]", {"x": "[[a]] and [[b]]"}),
    ],
)
def test_yaml_quotes_lists_and_comments(text, want):
    assert notes.parse_yaml(text) == want


@pytest.mark.parametrize("text", ['x: "open', "x: [a, b", "x: 'a' b", "  - x\ny: 1", "just text"])
def test_yaml_refuses(text):
    with pytest.raises(ValueError):
        notes.parse_yaml(text)


def test_comments_go_to_metadata():
    text = "#: Of a party.\nfields:\n  #: Its name,\n  #: in public.\n  name: String\n  # no doc\n  role?: String\n  #: Limits.\n  boundary?: String\n"
    said = notes.doc_comments(text)
    assert said == {"": "Of a party.", "name": "Its name, in public.", "boundary": "Limits."}
    schema = declared.schema_of(notes.parse_yaml(text), comments=said)
    assert [f.metadata.get("comment") for f in schema] == ["Its name, in public.", None, "Limits."]


def test_profiles_allow_what_they_list(spark):
    texts = {"p": 'type: t\ntools:\n  - "[[tool.read::core]]"\n  - "[[tool.find]]"\nnativeToolAllowlist: []\n', "q": "tools: ~\n", "r": "nativeToolAllowlist: [sh]\n"}
    got = {r.profile: (r.tools, r.native_tools) for r in notes.profiles(spark, texts).collect()}
    assert got == {"p": (["tool.read", "tool.find"], []), "q": ([], []), "r": ([], ["sh"])}
    req = spark.createDataFrame([("p", "tool.read"), ("p", "tool.write"), ("q", "tool.read"), ("s", "tool.read")], "profile string, tool string")
    assert [tuple(r) for r in links.allowed(req, "tool", notes.profiles(spark, texts), "profile").collect()] == [("p", "tool.read")]


def test_outcomes_and_hints(spark):
    declared.check_no_outcome(declared.schema_of({"fields": {"status": "String", "window": "String", "postedHistory": "String"}}))
    for name in ("won", "isWin", "quote_lost", "Outcome"):
        with pytest.raises(ValueError):
            declared.check_no_outcome(declared.schema_of({"fields": {name: "String"}}))
    both = declared.schema_of({"fields": {"hint": "String", "basis": "String"}})
    declared.check_apart(both, "hint", "basis")
    for hint, basis in (("hint", "hint"), ("hint", "other")):
        with pytest.raises(ValueError):
            declared.check_apart(both, hint, basis)


def test_reconciled_only(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, ok boolean")
    assert [r.id for r in evidence.reconciled_only(df, df.ok).collect()] == [1]


def test_registers(spark, tmp_path):
    import gzip

    schema = "part string, qty int, price double"
    (tmp_path / "q.csv").write_text('part,qty,price\n"a, ""b""",1,2.5\nc,,3\n')
    with gzip.open(tmp_path / "q.json.gz", "wt") as f:
        f.write('[{"part": "a, \\"b\\"", "qty": 1, "price": 2.5}, {"part": "c", "qty": null, "price": 3.0}]')
    with gzip.open(tmp_path / "q.jsonl.gz", "wt") as f:
        f.write('{"part": "a, \\"b\\"", "qty": 1, "price": 2.5}\n{"part": "c", "price": 3.0}\n')
    want = [('a, "b"', 1, 2.5), ("c", None, 3.0)]
    for name in ("q.csv", "q.json.gz", "q.jsonl.gz"):
        assert sorted(tuple(r) for r in register.read_register(spark, str(tmp_path / name), schema).collect()) == want
    (tmp_path / "bad.csv").write_text("part,qty,price\na,x,1\n")
    with pytest.raises(Exception):
        register.read_register(spark, str(tmp_path / "bad.csv"), schema).collect()
    with pytest.raises(ValueError):
        register.read_register(spark, "q.parquet", schema)
    register.check_output(["/a/b", "/c"], "/a/out")
    for out in ("/a/b", "/a/b/c", "/a", "/c/."):
        with pytest.raises(ValueError):
            register.check_output(["/a/b", "/c"], out)


def test_converted_notes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(30):
        (tmp_path / "in" / f"n {k}.md").write_text(f"---\nid: {k}\n---\nbody {k}\n")
    got = notes.convert_notes(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["id"], files=2)
    assert sorted(int(r.id) for r in got.collect()) == list(range(30)) and len(list((tmp_path / "out").glob("part-*"))) <= 2


def test_null_targets_and_nodes(spark):
    edges = spark.createDataFrame([("a", "x"), ("b", None), ("c", "y")], "src string, target string")
    nodes = spark.createDataFrame([("x",), (None,)], "node string")
    assert [r.src for r in links.dangling_links(edges, "target", nodes, "node").collect()] == ["c"]
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", None), (None, "d")], "src string, target string")
    start = spark.createDataFrame([("a",), (None,), ("a",)], "node string")
    assert sorted((r.node, r.depth) for r in links.follow(loop, start, 4).collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_entry_hides_no_import_error(monkeypatch):
    import importlib

    import __spark_entry__ as e

    assert set(core.QUERIES) <= set(e.queries())
    for gone, want in (("veridoc.llm", None), ("veridoc.llm.registry", None), ("corpus_pipeline", None), ("xxhash", ModuleNotFoundError)):

        def missing(name, gone=gone):
            raise ModuleNotFoundError(name=gone)

        monkeypatch.setattr(importlib, "import_module", missing)
        if want:
            with pytest.raises(want):
                e._optional("veridoc.llm.registry")
        else:
            assert e._optional("veridoc.llm.registry") is None


@pytest.mark.parametrize("text", ["{'a':1}", '{"a":1} x', '{"a":1,}', "NaN", "", "[Infinity]"])
def test_strict_json_refuses(text):
    with pytest.raises(ValueError):
        request.strict_json(text)


def test_request(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text('{"a":1,"a":2}')
    seen = []
    assert request.request_exit(spark, str(p), [lambda r: seen.append(r["a"])], lambda r: r["a"] > 1) == (0, '{"requires_register":true}')
    assert seen == [2]

    def fail(r):
        raise RuntimeError

    assert request.request_exit(spark, str(p), [fail], lambda r: True) == (1, "")
    assert request.request_exit(spark, str(tmp_path / "none.json"), [], lambda r: True) == (1, "")
    assert json.loads(request.check_request({}, [], lambda r: False)) == {"requires_register": False}


def test_stream_counts_equal_batch(spark, tmp_path):
    from veridoc.streaming.ext_events import tumbling_counts

    events = core.table(spark, SF, "events").select("ts", "event_type")
    events.write.parquet(str(tmp_path / "in"))
    stream = tumbling_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(str(r.window_start), r.event_type, r.n_events) for r in spark.table("counts").collect()}
    assert got == {(str(r.window_start), r.event_type, r.n_events) for r in tumbling_counts(events).collect()}
