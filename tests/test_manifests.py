"""TOML manifests against Python's own reader."""

import tomllib

from treeline.sources import manifests

Q3, A3 = '"' * 3, "'" * 3

PYPROJECTS = {
    "long": f'[project]\nname = "a"\ndescription = {Q3}\nTwo lines,\nwith "quotes" and # no comment\n{Q3}\nversion = "1"\n',
    "comment in array": '[project]\nname = "b" # the "real" one\ndependencies = [\n  "x>=1", # the "old" one\n  # "gone",\n  "y[z]; python_version < \'3.9\'",\n]\n',
    "escapes": '[project]\nname = "q\\"uote"\nversion = "a\\\\b\\tc\\u00e9"\ndependencies = ["p\\"q", \'l\\it"eral\']\n',
    "literal": f"[project]\nname = 'c:\\dir'\ndescription = {A3}\nraw \\n 'text' \"x\"{A3}\n",
    "header in a string": f'[project]\nname = "d"\ndescription = {Q3}\n[tool.poetry]\nname = "wrong"\n{Q3}\nversion = "2"\n[tool.poetry]\nname = "poetry"\n',
    "hash": '[project]\nname = "e#1"\ndescription = \'#no comment\'#comment\nversion="3"\n',
    "line end": f'[project]\nname = "f"\ndescription = {Q3}one \\\n    two{Q3}\n',
    "nested arrays": '[project]\nname = "g"\n[tool.x]\nmatrix = [\n  [1, 2],\n  ["a", "b"],\n]\n[project.urls]\nhome = "h"\n[[tool.y]]\nname = "no"\n',
    "poetry": "[tool.poetry]\nname = 'po'\n[tool.poetry.dependencies]\npython = \"^3.11\" # x = 1\n\"quoted-key\" = { version = \"1\" }\n",
    "both": '[tool.poetry]\nname = "old"\nversion = "9"\n[tool.poetry.dependencies]\nz = "1"\n[project]\nname = "new"\n',
    "crlf": '[project]\r\nname = "h"\r\ndependencies = [\r\n"w",\r\n]\r\n',
    "empty strings": '[project]\nname = ""\ndescription = ""\ndependencies = []\n',
    "spaces": '  [ project ]  # head\n  name="i"\n\tversion = "\t4"\n',
    "many": '[project]\nname = "j"\ndependencies = [\n' + "".join(f'  "dep{i}>={i}", # {i}\n' for i in range(3000)) + "]\n",
    "long text": f'[project]\nname = "k"\ndescription = {Q3}' + ("word \"x\" \\\\ " * 4000) + f'{Q3}\nversion = "5"\n',
}


def wanted(text):
    data = tomllib.loads(text.replace("\r\n", "\n"))
    poetry, project = data.get("tool", {}).get("poetry", {}), data.get("project", {})
    both = {**poetry, **project}
    return tuple(both.get(k) for k in ("name", "version", "description")), sorted(both.get("dependencies", []))


def test_pyproject_values(spark):
    df = spark.createDataFrame([(k, "pyproject.toml", v) for k, v in PYPROJECTS.items()], "project string, name string, content string")
    got = {r.project: ((r.name, r.version, r.description), sorted(r.deps)) for r in manifests.toml_records(df).collect()}
    assert got == {k: wanted(v) for k, v in PYPROJECTS.items()}


def test_cargo_and_broken_files(spark):
    cargo = f'# top\n[package]\nname = "rs" # "x"\nversion = \'0.1\'\ndescription = {Q3}A "b".{Q3}\n[dependencies]\nname = "no"\n'
    rows = [("rs", "Cargo.toml", cargo), ("none", "Cargo.toml", None), ("other", "Cargo.toml", "[workspace]\nname = 'w'\n"), ("bad", "pyproject.toml", '[project\nname = "'), ("open", "pyproject.toml", '[project]\nname = "x')]
    got = {r.project: (r.name, r.version, r.description) for r in manifests.toml_records(spark.createDataFrame(rows, "project string, name string, content string")).collect()}
    assert got == {"rs": ("rs", "0.1", 'A "b".'), "open": (None, None, None)}
