import pytest

from quillstone.schema import SchemaError, compile_table, diagram, read_schema, schema_rows

HEAD = ("!Name", "!Type", "!Parent", "!Format")


def table(*rows):
    return [dict(zip(HEAD, r)) for r in rows]


FAMILY = table(
    ("Parent", "Class", "", "column"), ("Id", "Attribute", "Parent", "Slug"),
    ("Child", "Class", "", "row"), ("Id", "Attribute", "Child", "Slug"), ("Parents", "Attribute", "Child", "ManyToMany('Parent', related_name='children')"), ("Size", "Attribute", "Child", "Enum(['small', 'large'], default='small')"),
)


def test_compile():
    c = compile_table(FAMILY)
    assert c["Child"].columns() == ["id", "parents", "size"]
    assert c["Child"].primary == "id" and c["Child"].relations["parents"].kind == "N-M"
    assert c.related_models("Parent") == ["Child"] and c.serializable() == []
    assert compile_table(table(*[r[:4] for r in schema_rows(c)])).models.keys() == c.models.keys()
    assert "Child -> Parent" in diagram(c)


@pytest.mark.parametrize(
    "rows",
    [
        table(("A b", "Class", "", "row")),
        table(("A", "Class", "B", "row")),
        table(("A", "Class", "A", "row")),
        table(("A", "Class", "", "sideways")),
        table(("A", "Class", "", "row"), ("b", "Attribute", "A", "ManyToOne('B')")),
        table(("A", "Class", "", "row"), ("b", "Attribute", "A", "String"), ("b", "Attribute", "A", "String")),
        table(("A", "Class", "", "row"), ("b", "Attribute", "A", "Slug"), ("c", "Attribute", "A", "Slug")),
        table(("A", "Thing", "", "row")),
    ],
)
def test_contradictions(rows):
    with pytest.raises(SchemaError):
        compile_table(rows)


def test_types_are_never_evaluated():
    with pytest.raises(ValueError):
        compile_table(table(("A", "Class", "", "row"), ("b", "Attribute", "A", "String(min_length=__import__('os').getpid())")))


def test_inheritance():
    c = compile_table(table(("A", "Class", "", "row"), ("Id", "Attribute", "A", "Slug"), ("B", "Class", "A", "row"), ("X", "Attribute", "B", "Float")))
    assert set(c["B"].attributes) == {"id", "x"} and c.subclasses("A") == ["A", "B"] and c.lineage("B") == ["B", "A"]


def test_read(tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("!!Tables type='Schema'\n!Name,!Type,!Parent,!Format\n\nA,Class,,row\nId,Attribute,A,\"String(primary=True, unique=True)\"\n")
    assert read_schema(str(p))["A"].primary == "id"
