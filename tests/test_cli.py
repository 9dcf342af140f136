from quillstone.__main__ import run

SCHEMA = '!Name,!Type,!Parent,!Format\nA,Class,,row\nId,Attribute,A,Slug\nX,Attribute,A,Float(min=0)\n'
DATA = "!!Tables type='Data' class='A'\n!Id,!X\na10,1\na9,2\n"


def test_commands(spark, tmp_path, capsys):
    s, d, e, out = (str(tmp_path / n) for n in ("s.csv", "d.csv", "e.csv", "o.csv"))
    open(s, "w").write(SCHEMA)
    open(d, "w").write(DATA)
    open(e, "w").write(DATA.replace("a9,2", "a9,-3"))
    assert run(["validate", s, d], spark) == 0 and run(["validate", s, e], spark) == 1
    assert "at least 0" in capsys.readouterr().out
    assert run(["diff", s, "A", d, d], spark) == 0 and run(["diff", s, "A", d, e], spark) == 1
    assert capsys.readouterr().out.split() == ["a9", "changed", "x", "2.0", "-3.0"]
    assert run(["normalize", s, d, out], spark) == 0 and [r.split(",")[0] for r in open(out).read().splitlines()[-2:]] == ["a9", "a10"]
    assert run(["convert", s, d, str(tmp_path / "o.json")], spark) == 0 and run(["convert", s, str(tmp_path / "o.json"), str(tmp_path / "o.xlsx")], spark) == 0
    assert run(["diff", s, "A", d, str(tmp_path / "o.xlsx")], spark) == 0
    assert run(["template", s, out], spark) == 0 and run(["viz-schema", s, out], spark) == 0 and run(["init-schema", s], spark) == 0
