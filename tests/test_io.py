import json

import pytest

from quillstone.operators.validate import clean
from quillstone.schema import compile_table
from quillstone.sources import layout, xlsx
from quillstone.sources.read import ReadError, Strictness, model_of, read
from quillstone.sources.write import cell_rules, convert, template, write

HEAD = ("!Name", "!Type", "!Parent", "!Format")
SCHEMA = [dict(zip(HEAD, r)) for r in [
    ("Company", "Class", "", "column"), ("Name", "Attribute", "Company", "String(primary=True, unique=True)"), ("Address", "Attribute", "Company", "OneToOne('Address', related_name='company')"),
    ("Person", "Class", "", "row"), ("Name", "Attribute", "Person", "String(primary=True, unique=True)"), ("Age", "Attribute", "Person", "Integer"), ("Companies", "Attribute", "Person", "ManyToMany('Company', related_name='people')"),
    ("Address", "Class", "", "multiple_cells"), ("Street", "Attribute", "Address", "String(primary=True, unique=True)"), ("City", "Attribute", "Address", "String"),
]]
MULTI = """!!!Tables version='1'
!!Tables type='Data' tableFormat='column' class='Company'
,!Name,Alpha,Beta
!Address,!Street,1 Main,2 Side
!Address,!City,Here,There

!!Tables type='Data' class='Person'
%/ a comment /%
!Name,!Age,!Companies
Bo,7,"Alpha, Beta"
Al,,Alpha
"""


@pytest.fixture
def multi(tmp_path):
    p = tmp_path / "d.csv"
    p.write_text(MULTI)
    return str(p)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def content(data):
    return rows(data.tables["Company"], "name", "address"), rows(data.tables["Person"], "name", "age", "companies"), rows(data.tables["Address"], "street", "city")


WANT = ([("Alpha", "1 Main"), ("Beta", "2 Side")], [("Al", "", "Alpha"), ("Bo", "7", "Alpha, Beta")], [("1 Main", "Here"), ("2 Side", "There")])


def test_read(spark, multi):
    data = read(spark, multi, compile_table(SCHEMA))
    assert content(data) == WANT and data.document == {"version": "1"}
    assert {r["__row"] for r in data.tables["Person"].collect()} == {10, 11}


@pytest.mark.parametrize("name", ["x.csv", "x.tsv", "x-*.csv", "x.xlsx"])
def test_round_trip(spark, multi, tmp_path, name):
    c = compile_table(SCHEMA)
    data = read(spark, multi, c)
    to = str(tmp_path / name)
    write(to, {n: clean(d, c[n]) for n, d in data.tables.items()}, c, data.document, toc=True, schema=True)
    assert content(read(spark, to, c)) == WANT


def test_json(spark, multi, tmp_path):
    c = compile_table(SCHEMA)
    to = str(tmp_path / "x.json")
    convert(spark, multi, to, c)
    got = json.load(open(to))
    assert [p["name"] for p in got["Person"]] == ["Al", "Bo"]
    back = read(spark, to, c)
    assert rows(back.tables["Address"], "street", "city") == WANT[2] and rows(back.tables["Person"], "name", "companies") == [("Al", "Alpha"), ("Bo", "Alpha, Beta")]


def test_nested_json(spark, tmp_path):
    p = tmp_path / "n.json"
    p.write_text(json.dumps({"Person": [{"name": "Bo", "age": 7, "companies": [{"__type": "Company", "__id": 1, "name": "Alpha", "address": {"street": "1 Main", "city": "Here"}}]}, {"name": "Al", "companies": [{"__id": 1}]}]}))
    data = read(spark, str(p), compile_table(SCHEMA))
    assert rows(data.tables["Person"], "name", "companies") == [("Al", "Alpha"), ("Bo", "Alpha")] and rows(data.tables["Company"], "name", "address") == [("Alpha", "1 Main")]


@pytest.mark.parametrize(("old", "new", "flag"), [("!Age", "!Odd", "attributes"), ("class='Person'", "class='Odd'", "models"), ("!Name,!Age", "!Name,!Name", None), ("!!Tables type='Data' class='Person'\n", "!!Tables type='Data' class='Company'\n", None)])
def test_strictness(spark, tmp_path, old, new, flag):
    p = tmp_path / "b.csv"
    p.write_text(MULTI.replace(old, new))
    with pytest.raises(ReadError):
        read(spark, str(p), compile_table(SCHEMA))
    if flag:
        read(spark, str(p), compile_table(SCHEMA), Strictness(True, True, True, True, True))


def test_template_and_rules(spark, tmp_path):
    c = compile_table(SCHEMA)
    template(str(tmp_path / "t.csv"), spark, c)
    data = read(spark, str(tmp_path / "t.csv"), c)
    assert data.tables["Person"].count() == 0
    assert ("Person", "companies", "N-M", "0", "", "Company.name") in cell_rules(c)


def test_metadata():
    assert layout.metadata("!!X a='it\\'s' b=\"c d\"") == {"a": "it's", "b": "c d"}
    with pytest.raises(layout.LayoutError):
        layout.metadata("!!X a='1' a='2'")
    assert layout.metadata(layout.heading("!!", {"k": "it's \\ x"})) == {"k": "it's \\ x"}


def test_sheet_names():
    c = compile_table(SCHEMA)
    assert model_of(c, "!!person") == "Person" and model_of(c, "nobody") is None


def test_letters():
    assert [xlsx.letters(n) for n in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]
    with pytest.raises(ValueError):
        xlsx.letters(0)


def test_data_source(spark, multi, tmp_path):
    from quillstone.sources.datasource import register

    register(spark)
    s = tmp_path / "s.csv"
    s.write_text("!Name,!Type,!Parent,!Format\n" + "\n".join(",".join(f'"{v}"' for v in r.values()) for r in SCHEMA))
    (tmp_path / "more.csv").write_text("!!Tables type='Data' class='Person'\n!Name,!Age,!Companies\nCy,1,\n")
    df = spark.read.format("tables").option("schema", str(s)).option("model", "Person").load(str(tmp_path / "[dm]*.csv"))
    assert rows(df, "name", "age", "companies") == [*WANT[1], ("Cy", "1", "")]


def test_changes_file(tmp_path):
    from quillstone.operators.migrate import Changes
    from quillstone.schema import SchemaError

    p = tmp_path / "c.json"
    p.write_text('{"renamed_models": [["A", "B"]], "renamed_attributes": [[["A", "x"], ["B", "y"]]]}')
    assert Changes.load(str(p)) == Changes([("A", "B")], [(("A", "x"), ("B", "y"))])
    p.write_text('{"other": 1}')
    with pytest.raises(SchemaError):
        Changes.load(str(p))


def test_references_to_numbers_and_headings_by_words(spark, tmp_path):
    """`7.0` refers to the object 7; a heading may be the words of a name."""
    from quillstone.operators.validate import validate

    schema = [dict(zip(HEAD, r)) for r in [("place", "Class", "", "multiple_cells"), ("start", "Attribute", "place", "Integer(primary=True, unique=True)"), ("gene", "Class", "", "row"), ("id", "Attribute", "gene", "Slug"), ("first_place", "Attribute", "gene", "ManyToOne('place', related_name='genes')"), ("others", "Attribute", "gene", "ManyToMany('place', related_name='more')")]]
    p = tmp_path / "g.csv"
    p.write_text("!!Tables type='Data' class='gene'\n,!First place,\n!Id,!Start,!Others\ng1,7.0,\"7.0, 7\"\ng2,8.0,9\n")
    c = compile_table(schema)
    data = read(spark, str(p), c)
    assert rows(clean(data.tables["gene"], c["gene"], catalog=c), "id", "first_place", "others") == [("g1", "7", "7, 7"), ("g2", "8", "9")]
    assert [(r["pk"], r["attr"], r["value"]) for r in validate(data.tables, c, text=True).collect()] == [("g2", "others", "9")]


@pytest.fixture
def parts(monkeypatch):
    """Few rows on the driver at once."""
    from quillstone.sources import read as reading
    from quillstone.sources import write as writing

    monkeypatch.setattr(writing, "PART_ROWS", 300, raising=False)
    monkeypatch.setattr(reading, "HELD_ROWS", 300, raising=False)
    monkeypatch.setattr(reading, "READ_CHARS", 1 << 12, raising=False)


@pytest.mark.parametrize("name", ["x.csv", "x-*.csv", "x.xlsx", "x.json", "x.yaml"])
def test_round_trip_in_parts(spark, tmp_path, parts, name):
    c = compile_table(SCHEMA)
    people = [(f"p{k}", str(k % 90), ["", "Alpha", "Alpha, Beta"][k % 3]) for k in range(1000)]
    tables = {"Company": [("Alpha", "1 Main"), ("Beta", "2 Side")], "Person": people, "Address": [("1 Main", "Here"), ("2 Side", "Söder\n- \"x\": [1]")]}
    data = {m: clean(spark.createDataFrame(r, ", ".join(f"{x} string" for x in c[m].columns())), c[m]) for m, r in tables.items()}
    to = str(tmp_path / name)
    write(to, data, c, {"about": "it's a test"}, toc=True, schema=True, write_empty=False)
    back = read(spark, to, c)
    assert back.document == {"about": "it's a test"} and [p.name for p in tmp_path.iterdir()].count("x.xlsx") <= 1 and not [p for p in tmp_path.iterdir() if len(p.suffix) > 6]
    assert {m: rows(d, *c[m].columns()) for m, d in back.tables.items()} == {m: sorted(r) for m, r in tables.items()}
    order = [r["name"] for r in back.tables["Person"].orderBy("__row").collect()]
    assert order == [f"p{k}" for k in range(1000)] and back.tables["Person"].agg({"__row": "count"}).first()[0] == 1000


@pytest.mark.parametrize("name", ["n.json", "n.yaml"])
def test_last_values_of_repeated_objects_in_parts(spark, tmp_path, monkeypatch, name):
    import random

    import yaml

    from quillstone.sources import read as reading

    draw = random.Random(7)
    person = lambda k: {"name": f"p{k}"} | ({"age": draw.choice([None, draw.randrange(90)])} if draw.random() < 0.7 else {})
    company = lambda k: {"__id": f"c{k}", "name": f"c{k}", "people": [person(draw.randrange(40)) for _ in range(3)]} if draw.random() < 0.5 else {"name": f"c{k}", "address": {"street": f"s{k % 5}", "city": str(draw.random())}}
    tree = {"Person": [person(draw.randrange(80)) | {"companies": [company(draw.randrange(20))]} for _ in range(200)], "Company": company(3), "_documentMetadata": {"a": "1"}}
    p = tmp_path / name
    p.write_text(json.dumps(tree) if name == "n.json" else yaml.safe_dump(tree, sort_keys=False))
    c = compile_table(SCHEMA)
    seen = []
    for held in (1 << 20, 50):
        monkeypatch.setattr(reading, "HELD_ROWS", held, raising=False)
        data = read(spark, str(p), c)
        seen.append((data.document, {m: rows(d.na.fill("none"), "__row", *c[m].columns()) for m, d in data.tables.items()}))
    assert seen[0] == seen[1] and len(seen[0][1]["Person"]) > 60 and seen[0][0] == {"a": "1"}


@pytest.mark.parametrize("text", ['{"Person": [{"name": "a"}', '{"Person": [{"name": "a"}]} x', '{"Person": [{"name": "a" "age": 1}]}', '[1]', ""])
def test_broken_json(spark, tmp_path, text):
    (tmp_path / "b.json").write_text(text)
    with pytest.raises(ReadError):
        read(spark, str(tmp_path / "b.json"), compile_table(SCHEMA))


@pytest.mark.parametrize("name", ["x.xlsx", "x.json", "x.yaml"])
def test_the_driver_holds_a_part_of_a_file(spark, tmp_path, parts, name):
    """Python's memory on the driver while 6,000 rows are written and read."""
    import tracemalloc

    c = compile_table(SCHEMA)
    people = spark.range(6000).selectExpr("concat('p', id) AS name", "id AS age", "repeat('long name ', 30) AS companies")
    to = str(tmp_path / name)
    tracemalloc.start()
    try:
        write(to, {"Person": clean(people, c["Person"])}, c)
        data = read(spark, to, c, Strictness(ignore_missing_models=True))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert data.tables["Person"].count() == 6000 and peak < 4e6, peak
