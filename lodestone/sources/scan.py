"""File scans and predicates over paths."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import file_name

#: Folders that hold no sources of interest.
SKIP = """node_modules .git vendor build dist .gradle target tmp log coverage .worktrees test tests spec specs
__tests__ contrib .claude .husky .github .vscode .idea .serverless .turbo .nx .next .nuxt __pycache__""".split()

#: Language by extension.
LANGUAGES = {"rb": "ruby", "rake": "ruby", "groovy": "groovy", "gradle": "groovy", "py": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "rs": "rust", "java": "java", "go": "go"}
RUBY_NAMES = ["Rakefile", "Gemfile", "Capfile"]

#: Parts of names of configuration files, as they are written.
CONFIG = """Config Bootstrap Application. .config.ts .config.js .config.mjs .module.ts build.gradle build.gradle.kts pom.xml
webpack.config. vite.config. jest.config. application.rb application.properties application.yml""".split()

#: What is indexed of a folder of documents by default.
DOCUMENT_GLOBS = ["*.md", "*.txt", "*.rst", "README*", "CHANGELOG*"]


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def skipped(path: Column) -> Column:
    """Some part of the relative path, the file name included, is a skipped folder's name."""
    return F.arrays_overlap(parts(path), F.array(*[F.lit(s) for s in SKIP]))


def plugin(path: Column) -> Column:
    """The first part looks like name-1.2."""
    return F.coalesce(F.get(parts(path), 0).rlike(r"^.+-\d+\.\d+"), F.lit(False))


def depth(path: Column) -> Column:
    return F.size(parts(path))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def language(path: Column) -> Column:
    """Language by extension or, for Ruby, by name; null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(file_name(path).isin(RUBY_NAMES), "ruby").otherwise(F.try_element_at(table, extension(path)))


def config_file(path: Column) -> Column:
    """The file's name holds a part that only names of configuration files have."""
    return file_name(path).rlike("|".join(re.escape(c) for c in CONFIG))


def below_worktrees(files: DataFrame, path: str, git_files: DataFrame) -> DataFrame:
    """Files not below a first-level folder that holds a ``.git`` file (``git_files``: path)."""
    roots = git_files.filter(F.col("path").rlike(r"^[^/]+/\.git$")).select(F.split("path", "/")[0].alias("_root")).dropDuplicates()
    return files.withColumn("_root", F.split(path, "/")[0]).join(roots, "_root", "left_anti").drop("_root")


def glob_regex(pattern: str) -> str | None:
    """Regex of a glob whose stars cross slashes; null for a malformed one, which matches nothing."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            while i + 1 < len(pattern) and pattern[i + 1] == "*":
                i += 1
            if pattern[i + 1 : i + 2] == "/" and pattern[i - 1 : i] == "*":
                i += 1
                out += "(?:.*/)?"
            else:
                out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                return None
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def included(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Full path or file name matches an include pattern (or there is none) and no exclude pattern."""

    def hit(patterns: list[str]) -> Column:
        regexes = [r for r in map(glob_regex, patterns) if r]
        any_ = "|".join(f"(?:{r})" for r in regexes)
        return path.rlike(any_) | file_name(path).rlike(any_) if regexes else F.lit(False)

    return (hit(include) if include else F.lit(True)) & ~hit(exclude)


def hidden_files(root: str, max_depth: int = 15) -> list[str]:
    """Relative paths below ``root`` with a part that begins with a dot or an underscore, which
    Spark's readers pass over. Skipped folders are not entered; the names alone are listed."""
    files, base = fs.FileSystem.from_uri(root)
    out, todo = [], [("", 1, False)]
    while todo:
        folder, level, below = todo.pop()
        for info in files.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True)):
            name, hidden = info.base_name, below or info.base_name[:1] in "._"
            if name in SKIP or level == 1 and re.match(r"^.+-\d+\.\d+", name):
                continue
            if info.type == fs.FileType.Directory:
                if level < max_depth:
                    todo.append((f"{folder}{name}/", level + 1, hidden))
            elif hidden:
                out.append(f"{folder}{name}")
    return sorted(out)


def _open(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        for b in batches:
            paths = b.column(0).to_pylist()
            contents = [files.open_input_stream(f"{base}/{p}").read() for p in paths]
            times = [files.get_file_info(f"{base}/{p}").mtime for p in paths]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(contents, pa.binary()), pa.array(times, pa.timestamp("us", "UTC"))], ["path", "content", "modificationTime"])

    return work


def read_texts(spark: SparkSession, roots: list[str], max_depth: int = 15, extensions: list[str] | None = None) -> DataFrame:
    """(path, content, modificationTime, root) of all text files below ``roots``, hidden ones too, by
    the path predicates above; ``root`` numbers the roots. A file comes with each root that it
    is below; (root, path) is the order of a walk.

    The path filter comes before content is decoded; ignore files aren't followed.
    """
    out = None
    for number, root in enumerate(roots):
        base = root.rstrip("/")
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
        rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(re.sub("^file:/*", "/", base)) + "/", "")
        rows = files.select(rel.alias("path"), "content", "modificationTime")
        if hidden := hidden_files(base, max_depth):
            names = spark.createDataFrame([(h,) for h in hidden], "path string")
            rows = rows.unionByName(names.mapInArrow(_open(base), "path string, content binary, modificationTime timestamp"))
        p = F.col("path")
        rows = rows.filter(~skipped(p) & ~plugin(p) & (depth(p) <= max_depth))
        rows = rows.filter(extension(p).isin(extensions) | file_name(p).isin(RUBY_NAMES)) if extensions else rows
        rows = rows.select("path", F.decode("content", "UTF-8").alias("content"), "modificationTime", F.lit(number).alias("root"))
        out = rows if out is None else out.unionByName(rows)
    return out


def ignore_rules(root: str) -> list[tuple[str, bool]]:
    """(regex over relative paths, whether it ignores) of all ignore files below a folder, outer
    ones first; the last rule that matches a path decides. These files are few and small."""
    files, base = fs.FileSystem.from_uri(root.rstrip("/"))
    rules = []
    for path in sorted((h for h in hidden_files(root.rstrip("/")) if h.rpartition("/")[2] == ".gitignore"), key=lambda p: (p.count("/"), p)):
        text = files.open_input_stream(f"{base}/{path}").read().decode("utf-8", "replace")
        folder = path[: -len(".gitignore")]
        for line in text.splitlines():
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            ignores, line = not line.startswith("!"), line.lstrip("!")
            anchored = "/" in line.rstrip("/")
            body = "".join("(?:.*/)?" if x == "**/" else ".*" if x == "**" else "[^/]*" if x == "*" else "[^/]" if x == "?" else re.escape(x) for x in re.split(r"(\*\*/|\*\*|\*|\?)", line.strip("/")))
            rules.append((f"^{re.escape(folder)}{'' if anchored else '(?:.*/)?'}{body}{'/.*' if line.endswith('/') else '(?:/.*)?'}$", ignores))
    return rules


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    out = F.lit(False)
    for regex, ignores in rules:
        out = F.when(path.rlike(regex), ignores).otherwise(out)
    return out


def read_documents(spark: SparkSession, root: str, include: list[str] = DOCUMENT_GLOBS, exclude: list[str] = []) -> DataFrame:
    """(path, content) of documents below a folder, each path once, without ignored files."""
    kept = included(F.col("path"), include, exclude) & ~ignored(F.col("path"), ignore_rules(root))
    return read_texts(spark, [root]).filter(kept).dropDuplicates(["path"])


def stack(files: DataFrame, path: str = "path", text: str = "text", by: list[str] = []) -> DataFrame:
    """What the root folder's file names say about a workspace, a row per ``by`` (or one row).

    Flags rust, node, react, rails, jvm, python, monorepo, has_docs, has_readme, and
    ``subprojects``: the sorted folders below apps and packages of a monorepo, else empty.
    A null path or text (or no column of texts) says nothing. Flags and sets are combined map-side.
    """
    at, content = F.col(path), F.col(text) if text in files.columns else F.lit(None).cast("string")
    has = lambda *names: F.coalesce(F.bool_or(at.isin(*names)), F.lit(False))
    package = lambda word: F.coalesce(F.bool_or((at == "package.json") & content.contains(word)), F.lit(False))
    below = F.coalesce(F.bool_or(at.startswith("docs/")), F.lit(False))
    rows = files.groupBy(*by).agg(
        has("Cargo.toml").alias("rust"),
        has("package.json").alias("node"),
        package('"react"').alias("react"),
        has("Gemfile").alias("rails"),
        has("build.gradle", "build.gradle.kts", "pom.xml").alias("jvm"),
        has("requirements.txt", "pyproject.toml").alias("python"),
        (has("turbo.json", "nx.json") | package('"workspaces"')).alias("monorepo"),
        below.alias("has_docs"),
        has("README.md", "README.rst").alias("has_readme"),
        F.sort_array(F.collect_set(F.nullif(F.regexp_extract(at, "^((?:apps|packages)/[^/]+)/", 1), F.lit("")))).alias("subprojects"),
    )
    return rows.withColumn("subprojects", F.when(F.col("monorepo"), F.col("subprojects")).otherwise(F.array().cast("array<string>")))
