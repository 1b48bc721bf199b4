"""Imports resolved to files, and the degrees of the graph that they make.

Every file's module path stands in a table under all its endings, and under every
folder above it: that is a trie of path endings, flattened, which keeps for each
ending and folder the one file that is meant there. An import looks its ending up
in the folders above the importer, and the deepest folder that knows it wins, so
a name such as ``utils`` that many packages have is that of the nearest package.
Relative imports name one whole path. Neither the files that share a name nor
their importers are ever paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions import paths
from corpusaudit.functions.once import let
from corpusaudit.operators.grouping import file_key

# Suffixes of files that import one another, and the names that stand for their folder.
PYTHON, SCRIPT = [".py", ".pyw", ".pyx"], [".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx"]
FOLDER_MODULES = ["__init__", "index"]

_FROM = r"(?m)^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import[ \t]+\(?[ \t]*([\w, \t]+)"
_IMPORT = r"(?m)^[ \t]*import[ \t]+([\w.]+)"
_SCRIPT_IMPORT = r"(?:\bfrom|\bimport|\brequire[ \t]*\()[ \t]*[\"'](\.{1,2}/[\w/.-]+)[\"']"


def _kind(path: Column) -> Column:
    return F.when(paths.suffix(path).isin(*PYTHON), "python").when(paths.suffix(path).isin(*SCRIPT), "script")


def _parts(path: Column) -> Column:
    """The parts of a module's path: without suffix, a folder's own module as the folder."""
    bare = F.substring(path, F.lit(1), F.length(path) - F.length(paths.suffix(path)))
    parts = F.split(bare, "/")
    return F.when(F.element_at(parts, -1).isin(*FOLDER_MODULES), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def _folder(path: Column) -> Column:
    return let(F.split(path, "/"), lambda p: F.slice(p, 1, F.size(p) - 1))


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "/")


def _python_wants(source: Column, folder: Column) -> Column:
    """(whole, ways): for each import the module paths that it may mean, the likelier first; whole paths start at the root."""

    def of_from(m: Column, names: Column) -> Column:
        dots = F.length(F.regexp_extract(m, r"^(\.*)", 1))
        module = F.replace(F.substr(m, dots + 1), F.lit("."), F.lit("/"))
        above = F.size(folder) - dots + 1
        base = F.when(dots > 0, F.when(above >= 0, F.slice(folder, 1, F.greatest(above, F.lit(0))))).otherwise(F.array().cast("array<string>"))
        path = _joined(F.filter(F.concat(base, F.array(module)), lambda x: x != ""))
        each = F.filter(F.transform(F.split(names, ","), lambda n: F.regexp_extract(n, r"^\s*(\w+)", 1)), lambda n: n != "")
        slash = F.when(path == "", "").otherwise("/")
        return F.transform(each, lambda n: F.struct((dots > 0).alias("whole"), F.array(F.concat(path, slash, n), path).alias("ways")))

    matches = F.arrays_zip(
        F.regexp_extract_all(source, F.lit(_FROM), F.lit(1)).alias("m"), F.regexp_extract_all(source, F.lit(_FROM), F.lit(2)).alias("names")
    )
    plain = F.regexp_extract_all(source, F.lit(_IMPORT), F.lit(1))
    return F.concat(
        F.flatten(F.transform(matches, lambda x: of_from(x["m"], x["names"]))),
        F.transform(plain, lambda m: F.struct(F.lit(False).alias("whole"), F.array(F.replace(m, F.lit("."), F.lit("/"))).alias("ways"))),
    )


def _script_wants(source: Column, folder: Column) -> Column:
    def one(m: Column) -> Column:
        parts = F.filter(F.split(F.regexp_replace(m, r"\.(jsx?|tsx?|[mc]js)$", ""), "/"), lambda x: (x != ".") & (x != ""))
        ups = F.size(F.filter(parts, lambda x: x == ".."))
        rest = F.filter(parts, lambda x: x != "..")
        rest = F.when(F.element_at(rest, -1).isin(*FOLDER_MODULES), F.slice(rest, 1, F.size(rest) - 1)).otherwise(rest)
        base = F.when(F.size(folder) >= ups, F.slice(folder, 1, F.greatest(F.size(folder) - ups, F.lit(0))))
        return F.struct(F.lit(True).alias("whole"), F.array(_joined(F.concat(base, rest))).alias("ways"))

    return F.transform(F.regexp_extract_all(source, F.lit(_SCRIPT_IMPORT), F.lit(1)), one)


def _meant(files: DataFrame, repo: list[str]) -> DataFrame:
    """(repo, kind, ending, folder, target): for each ending of a module path and each folder above it, the file that is meant.

    Of several, the one with the shortest path, then the first. Whole paths are
    endings that begin with a slash, under no folder.
    """
    path = F.col("file_path")
    own = files.select(*repo, "file_path", _kind(path).alias("kind"), _parts(path).alias("parts"), _folder(path).alias("above")).where("kind IS NOT NULL AND size(parts) > 0")
    n = F.size("parts")
    endings = F.transform(F.sequence(F.lit(1), n), lambda i: _joined(F.slice("parts", i, n - i + 1)))
    folders = F.transform(F.sequence(F.lit(0), F.size("above")), lambda i: _joined(F.slice("above", 1, i)))
    loose = own.select(*repo, "kind", "file_path", F.explode(endings).alias("ending"), folders.alias("folders")).select(*repo, "kind", "file_path", "ending", F.explode("folders").alias("folder"))
    whole = own.select(*repo, "kind", "file_path", F.concat(F.lit("/"), _joined(F.col("parts"))).alias("ending"), F.lit("").alias("folder"))
    first = F.min(F.struct(F.length("file_path").alias("n"), F.col("file_path").alias("target")))
    return loose.unionByName(whole).groupBy(*repo, "kind", "ending", "folder").agg(first.alias("m")).select(*repo, "kind", "ending", "folder", "m.target")


def resolved_imports(files: DataFrame, column: str = "source_code") -> DataFrame:
    """(repo if there is one, file_path, target): each file with the files of its repository that its imports mean, once each.

    ``from a.b import c`` means the module ``a/b/c`` if there is one, else
    ``a/b``; dots count folders up; scripts import by relative paths. An absolute
    module is any file whose path ends so, the one in the nearest folder above
    the importer that has one. Imports of no file, and of the file itself, are
    left out; a null text imports nothing.
    """
    key = file_key(files)
    repo = [c for c in key if c != "file_path"]
    path, source = F.col("file_path"), F.coalesce(F.col(column), F.lit(""))
    kind, folder = _kind(path), _folder(path)
    wants = F.when(kind == "python", _python_wants(source, folder)).when(kind == "script", _script_wants(source, folder))
    each = files.select(*key, kind.alias("kind"), folder.alias("above"), F.posexplode(F.array_distinct(wants)).alias("import_no", "w"))
    ways = each.select(*key, "kind", "above", "import_no", F.col("w.whole").alias("whole"), F.posexplode("w.ways").alias("way", "path")).where("path <> ''")
    folders = F.transform(F.sequence(F.lit(0), F.size("above")), lambda i: _joined(F.slice("above", 1, i)))
    asked = ways.select(
        *key, "kind", "import_no", "way", F.when(F.col("whole"), F.concat(F.lit("/"), "path")).otherwise(F.col("path")).alias("ending"),
        F.posexplode(F.when(F.col("whole"), F.array(F.lit(""))).otherwise(folders)).alias("depth", "folder"),
    )
    found = asked.join(_meant(files, repo), [*repo, "kind", "ending", "folder"])
    best = found.groupBy(*key, "import_no").agg(F.min_by("target", F.struct("way", (-F.col("depth")).alias("up"))).alias("target"))
    return best.where("target <> file_path").select(*key, "target").distinct()


def resolved_degrees(files: DataFrame, column: str = "source_code") -> DataFrame:
    """Of every file, how many files it depends on and how many depend on it, by ``resolved_imports``."""
    key = file_key(files)
    repo = [c for c in key if c != "file_path"]
    edges = resolved_imports(files, column)
    out = edges.groupBy(*key).agg(F.count("*").alias("depends_on"))
    into = edges.groupBy(*repo, F.col("target").alias("file_path")).agg(F.count("*").alias("depended_on_by"))
    degree = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return files.select(*key).join(out, key, "left").join(into, key, "left").select(*key, degree("depends_on"), degree("depended_on_by"))
