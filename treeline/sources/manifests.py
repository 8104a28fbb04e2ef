"""Manifest ingestion (S4): package.json, pyproject.toml (PEP 621 before
poetry), setup.py marker, Cargo.toml, go.mod, Gemfile marker,
composer.json.

Input rows ``manifests(project, name, content)`` -- one per manifest file
at a project root.  JSON manifests are parsed with ``from_json``.  Of TOML
files only a few keys of known tables are needed: the text is cut into its
``[table]`` sections and those keys are read by pattern, all in the JVM.

Outputs:

* ``package_info(project, ecosystem, name, version, description, has_file)``
* ``dependencies(project, ecosystem, name, dep_type, is_dev, version)``,
  unique on (project, ecosystem, name, dep_type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NPM_SCHEMA = ("struct<name:string,version:string,description:string,"
              "dependencies:map<string,string>,devDependencies:map<string,string>>")

INFO_SCHEMA = "project string, ecosystem string, name string, version string, description string, has_file boolean"
DEPS_SCHEMA = "project string, ecosystem string, name string, dep_type string, is_dev boolean, version string"


def _valid_json(c):
    """Whole text is one JSON object (from_json alone would accept a
    truncated document and return the fields it read before the error)."""
    return F.try_parse_json(c).isNotNull() & F.ltrim(c).startswith("{")


def npm_dependencies(manifests: DataFrame) -> DataFrame:
    """package.json dependencies and devDependencies; unreadable JSON yields nothing."""
    p = manifests.where((F.col("name") == "package.json") & _valid_json(F.col("content"))).select(
        "project", F.from_json(F.col("content"), NPM_SCHEMA).alias("j"))
    p = p.where(F.col("j").isNotNull())
    deps = p.select("project", F.lit("dependencies").alias("dep_type"), F.lit(False).alias("is_dev"),
                    F.explode(F.coalesce(F.col("j.dependencies"), F.create_map().cast("map<string,string>"))))
    dev = p.select("project", F.lit("devDependencies").alias("dep_type"), F.lit(True).alias("is_dev"),
                   F.explode(F.coalesce(F.col("j.devDependencies"), F.create_map().cast("map<string,string>"))))
    u = deps.unionByName(dev).select("project", F.lit("npm").alias("ecosystem"), F.col("key").alias("name"),
                                     "dep_type", "is_dev", F.col("value").alias("version"))
    return u


def json_package_info(manifests: DataFrame) -> DataFrame:
    """package.json and composer.json name / version / description."""
    m = manifests.where(F.col("name").isin("package.json", "composer.json") & _valid_json(F.col("content")))
    j = F.from_json(F.col("content"), NPM_SCHEMA)
    eco = F.when(F.col("name") == "package.json", F.lit("npm")).otherwise(F.lit("composer"))
    return (m.select("project", eco.alias("ecosystem"), j.alias("j")).where(F.col("j").isNotNull())
            .select("project", "ecosystem", F.col("j.name").alias("name"),
                    F.when(F.col("ecosystem") == "npm", F.col("j.version")).alias("version"),
                    F.col("j.description").alias("description"), F.lit(True).alias("has_file")))


def go_module(manifests: DataFrame) -> DataFrame:
    """go.mod: the module path from the first line starting with 'module '."""
    g = manifests.where(F.col("name") == "go.mod").select(
        "project", F.regexp_extract(F.col("content"), r"(?m)^module (\S+)", 1).alias("module"))
    return g.where(F.col("module") != "").select(
        "project", F.lit("go").alias("ecosystem"), F.col("module").alias("name"),
        F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("description"),
        F.lit(True).alias("has_file"))


# TOML is brought into a plain form first: no comments, every string on one
# line in double quotes.  The patterns loop over runs of characters, so that
# long texts don't deepen the matcher's stack.
_BASIC = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
_LITERAL = r"'[^'\n]*+'"
_LONG_BASIC = r'"""[^"\\]*+(?:(?:\\.|"{1,2}(?!"))[^"\\]*+)*+"""'
_LONG_LITERAL = r"'''[^']*+(?:'{1,2}(?!')[^']*+)*+'''"
_COMMENT = rf"(?s)({_LONG_BASIC}|{_LONG_LITERAL}|{_BASIC}|{_LITERAL})|#[^\n]*+"
# A [table] or [[table]] header line, then everything up to the next one.
_TOML_TABLE = (r"(?s)\n[ \t]*\[\[?[ \t]*([^\[\]\n]+?)[ \t]*\]\]?[ \t]*(?=\n)"
               r"(.*?)(?=\n[ \t]*\[\[?[^\[\]\n]+\]\]?[ \t]*\n|\z)")
_TOML_ARRAY = rf'\[((?:[^\]"]++|{_BASIC})*+)\]'


def _doubled(c: Column, what: str) -> Column:
    """``c`` with a backslash before every ``what``."""
    return F.replace(c, F.lit(what), F.lit("\\" + what))


def _long_strings(text: Column, quotes: str, literal: bool) -> Column:
    """Strings in triple quotes as strings in double quotes on one line (a
    quotation mark right beside the triple ones is not told from them)."""
    def one(part: Column, i: Column) -> Column:
        inside = F.regexp_replace(part, r"\A\n", "")
        if literal:
            inside = _doubled(_doubled(inside, "\\"), '"')
        else:
            inside = F.regexp_replace(inside, r"(?<!\\)((?:\\\\)*)\\[ \t]*\n[ \t\n]*", "$1")  # a backslash ends the line
            inside = F.regexp_replace(inside, r'(?<!\\)((?:\\\\)*)"', r'$1\\"')
        inside = F.replace(inside, F.lit("\n"), F.lit("\\n"))
        return F.when(i % 2 == 1, F.concat(F.lit('"'), inside, F.lit('"'))).otherwise(part)
    return F.array_join(F.transform(F.split(text, quotes, -1), one), "")


def plain_toml(content: Column) -> Column:
    """The text without comments, all strings in double quotes on one line."""
    text = F.concat(F.lit("\n"), F.regexp_replace(F.coalesce(content, F.lit("")), "\r\n?", "\n"), F.lit("\n"))
    text = F.regexp_replace(text, _COMMENT, "$1")
    text = _long_strings(_long_strings(text, '"""', False), "'''", True)
    # 'literal' strings, one by one: what is special between double quotes is escaped
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)({_BASIC}|{_LITERAL}|[^\"']++|[\"'])"), F.lit(1))

    def one(piece: Column) -> Column:
        inside = _doubled(_doubled(F.substring(piece, F.lit(2), F.length(piece) - 2), "\\"), '"')
        return F.when(piece.startswith("'") & (F.length(piece) > 1), F.concat(F.lit('"'), inside, F.lit('"'))).otherwise(piece)
    return F.array_join(F.transform(pieces, one), "")


def _unquoted(text: Column) -> Column:
    """The value of a string in double quotes: TOML's escapes are JSON's, beside raw tabs and ``\\U``."""
    safe = F.regexp_replace(F.replace(text, F.lit("\t"), F.lit("\\t")), r"\\U0000([0-9A-Fa-f]{4})", r"\\u$1")
    value = F.get(F.from_json(F.concat(F.lit("["), safe, F.lit("]")), "array<string>"), F.lit(0))
    return F.coalesce(value, F.substring(text, F.lit(2), F.length(text) - 2))


def _toml_table(table: str) -> Column:
    """The body of a table of the column ``toml``, null without it."""
    rows = F.filter("toml", lambda t: t["0"] == table)
    return F.when(F.size(rows) > 0, F.concat(F.lit("\n"), F.get(rows, F.lit(0))["1"]))


def _toml_text(body: Column, key: str) -> Column:
    """A string value of a table's body, null without it."""
    rx = rf'\n[ \t]*"?{key}"?[ \t]*=[ \t]*({_BASIC})'
    return F.when(F.regexp_like(body, F.lit(rx)), _unquoted(F.regexp_extract(body, rx, 1)))


def _toml_sections(manifests: DataFrame, name: str) -> DataFrame:
    """project, toml: array of (table, body) of the files of that name."""
    own = manifests.where(F.col("name") == name).select("project", plain_toml(F.col("content")).alias("text"))
    rx = F.lit(_TOML_TABLE)
    tables = F.transform(F.regexp_extract_all("text", rx, F.lit(1)), lambda t: F.regexp_replace(t, r'[ \t"]', ""))
    return own.select("project", F.arrays_zip(tables.alias("0"), F.regexp_extract_all("text", rx, F.lit(2)).alias("1")).alias("toml"))


def toml_records(manifests: DataFrame) -> DataFrame:
    """``project, ecosystem, name, version, description, deps`` of
    pyproject.toml (a field of [project] before the same of [tool.poetry])
    and Cargo.toml ([package]); files without these tables give nothing."""
    none = F.array().cast("array<string>")
    py = _toml_sections(manifests, "pyproject.toml").select("project", _toml_table("project").alias("pep"), _toml_table("tool.poetry").alias("poetry"),
                                                            _toml_table("tool.poetry.dependencies").alias("listed"))
    py = py.where("pep is not null or poetry is not null or listed is not null")
    array = rf'\n[ \t]*"?dependencies"?[ \t]*=[ \t]*{_TOML_ARRAY}'
    items = F.transform(F.regexp_extract_all(F.regexp_extract("pep", array, 1), F.lit(f"({_BASIC})"), F.lit(1)), _unquoted)
    keys = F.regexp_extract_all("listed", F.lit(r"\n[ \t]*[\"']?([A-Za-z0-9_.-]+)[\"']?[ \t]*="), F.lit(1))
    deps = F.when(F.regexp_like("pep", F.lit(array)), items).otherwise(F.coalesce(keys, none))
    py = py.select("project", F.lit("python").alias("ecosystem"),
                   *[F.coalesce(_toml_text(F.col("pep"), k), _toml_text(F.col("poetry"), k)).alias(k) for k in ("name", "version", "description")], deps.alias("deps"))
    cargo = _toml_sections(manifests, "Cargo.toml").select("project", _toml_table("package").alias("pkg")).where("pkg is not null")
    cargo = cargo.select("project", F.lit("cargo").alias("ecosystem"), *[_toml_text(F.col("pkg"), k).alias(k) for k in ("name", "version", "description")], none.alias("deps"))
    return py.unionByName(cargo)


def package_info(manifests: DataFrame) -> DataFrame:
    """All ecosystems' package records, plus the setup.py / Gemfile markers."""
    toml = toml_records(manifests)
    info = toml.select(
        "project", "ecosystem", "name", "version", "description", F.lit(True).alias("has_file"))
    markers = manifests.where(F.col("name").isin("setup.py", "Gemfile")).select(
        "project", F.when(F.col("name") == "setup.py", F.lit("python")).otherwise(F.lit("ruby")).alias("ecosystem"),
        F.when(F.col("name") == "setup.py", F.col("project")).alias("name"),
        F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("description"),
        F.lit(True).alias("has_file"))
    # setup.py only counts when no pyproject record exists for the project
    markers = markers.join(info.where(F.col("ecosystem") == "python").select("project", "ecosystem"),
                           ["project", "ecosystem"], "left_anti")
    return (json_package_info(manifests).unionByName(go_module(manifests))
            .unionByName(info).unionByName(markers))


def dependencies(manifests: DataFrame) -> DataFrame:
    """Dependency rows of all manifests, unique per (project, ecosystem, name, dep_type)."""
    toml = toml_records(manifests).select(
        "project", "ecosystem", F.explode("deps").alias("name"), F.lit("dependencies").alias("dep_type"),
        F.lit(False).alias("is_dev"), F.lit(None).cast("string").alias("version"))
    u = npm_dependencies(manifests).unionByName(toml)
    return u.groupBy("project", "ecosystem", "name", "dep_type").agg(
        F.max("is_dev").alias("is_dev"), F.max("version").alias("version"))
