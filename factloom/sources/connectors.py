"""Source connectors: a Python syntax-tree extractor, source walks and scan scope."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PY_FACTS = "file_id bigint, fact string, name string, line int, detail string"


def _python_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    warnings.simplefilter("ignore")
    for b in batches:
        rows = []
        for fid, text in zip(b.column("file_id").to_pylist(), b.column("text").to_pylist()):
            try:
                tree = ast.parse(text or "")
            except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                rows.append((fid, "parse-error", None, getattr(e, "lineno", None), type(e).__name__))
                continue
            for node in tree.body:
                if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    rows.append((fid, "function", node.name, node.lineno, str(len(node.args.args) + len(node.args.kwonlyargs))))
                elif isinstance(node, ast.ClassDef):
                    rows.append((fid, "class", node.name, node.lineno, None))
                    rows += [(fid, "method", f"{node.name}.{m.name}", m.lineno, None) for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
                elif isinstance(node, ast.Import):
                    rows += [(fid, "import", a.name, node.lineno, a.asname) for a in node.names]
                elif isinstance(node, ast.ImportFrom):
                    rows += [(fid, "import-from", a.name, node.lineno, "." * node.level + (node.module or "")) for a in node.names]
        cols = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string()))], names=[c.split()[0] for c in PY_FACTS.split(", ")])


def python_facts(files: DataFrame) -> DataFrame:
    """Definitions and imports of Python files(file_id, text); files that do not parse give one row of their own."""
    return files.select("file_id", "text").mapInArrow(_python_facts, PY_FACTS)


def walk(spark: SparkSession, root: str, patterns: tuple[str, ...] = ("*.ts", "*.js", "*.py", "*.rs", "*.go", "*.json")) -> DataFrame:
    """path, modified, length, text of every file below root that fits a pattern; bytes that are no UTF-8 are replaced."""
    glob = "{" + ",".join(patterns) + "}" if len(patterns) > 1 else patterns[0]
    out = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return out.select("path", F.col("modificationTime").alias("modified"), "length", F.decode("content", "UTF-8").alias("text"))


def scan_scope(path: Column) -> Column:
    """Why a path is out of scope, or 'included'; first reason wins."""
    return (
        F.when(path.rlike("(^|/)(node_modules|vendor|dist|build|target|[.]git)(/|$)"), "excluded:dependency-or-output")
        .when(path.rlike("(^|/)_gen/|[.]generated[.]|[.]min[.]js$"), "excluded:generated")
        .when(path.rlike("(^|/)tests?/|[.](test|spec)[.][a-z]+$"), "included:test")
        .when(~path.rlike("[.](ts|js|mjs|py|rs|go|json)$"), "excluded:language")
        .otherwise("included")
    )


def mentions(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Newest document that mentions each name. Names of four bytes and more that are ASCII identifiers are eligible; texts are cut into
    identifiers once and joined by equality."""
    n = names.select("name").distinct().where(F.col("name").rlike("^[A-Za-z_][A-Za-z0-9_]{3,}$"))
    t = docs.select("doc_id", "created_at", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("name"))
    g = t.join(n, "name", "left_semi").groupBy("name").agg(F.count("*").alias("documents"), F.max("created_at").alias("last_mention"))
    return n.join(g, "name", "left").withColumn("documents", F.coalesce("documents", F.lit(0).cast("bigint")))


def markdown_tables(docs: DataFrame) -> DataFrame:
    """Body rows of pipe tables in documents(doc_id, text): doc_id, first and second cell, trimmed; header and ruler lines are no rows."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(r"^[|].*[|]$"))
    cells = F.split(F.expr("substring(line, 2, length(line) - 2)"), "[|]")
    ruler = F.col("line").rlike("^[|][-:| ]+[|]$")
    rows = lines.select("doc_id", "pos", cells.alias("c"), ruler.alias("ruler"))
    # the line before a ruler is the header
    rulers = rows.where("ruler").select("doc_id", (F.col("pos") - 1).alias("pos"))
    body = rows.where("NOT ruler").join(rulers, ["doc_id", "pos"], "left_anti")
    return body.select("doc_id", "pos", F.trim(F.col("c")[0]).alias("first"), F.trim(F.get(F.col("c"), F.lit(1))).alias("second"))


def component_uses(files: DataFrame) -> DataFrame:
    """Uses of single-file components and of Markdown with components, files(file_id, ext, text): imports in script blocks, sources of
    scripts, style assets, and component tags in templates."""
    patterns = {
        "import": "import [^;\n]* from ['\"]([^'\"]+)['\"]",
        "script-src": "<script[^>]* src=['\"]([^'\"]+)['\"]",
        "style-asset": "@import ['\"]([^'\"]+)['\"]",
        "component-tag": "<([A-Z][A-Za-z0-9]*)[ />]",
    }
    f = files.where(F.col("ext").isin("vue", "svelte", "astro", "mdx"))

    def of(kind: str, rx: str) -> Column:
        return F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(rx), F.lit(1))), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("target")))

    rows = F.flatten(F.array(*[of(k, rx) for k, rx in patterns.items()]))
    return f.select("file_id", F.explode(rows).alias("u")).select("file_id", "u.*")


TOOLS = "id bigint, tool string, words int"
#: fixed values: package runners, runners whose next word is the tool, subcommands before a tool, and those before a script
PACKAGE_RUNNERS = ("npm", "pnpm", "yarn", "bun")
DIRECT_RUNNERS = ("bunx", "npx")
EXEC_SUBCOMMANDS = ("exec", "x", "dlx")
SCRIPT_SUBCOMMANDS = ("run", "run-script")


def _tool_of(words: list[str]) -> str | None:
    """The tool that the words of one command start, without their assignments; None where that is a script of the package."""
    name = lambda i: words[i].replace("\\", "/").rpartition("/")[2] if i < len(words) else ""
    if name(0) in DIRECT_RUNNERS:
        return name(1) or None
    if name(0) not in PACKAGE_RUNNERS:
        return name(0) or None
    if not name(1) or name(1) in SCRIPT_SUBCOMMANDS:
        return None
    if name(1) in EXEC_SUBCOMMANDS:
        return name(2) or None
    return None if name(0) == "npm" else name(1)


def _tools(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import shlex

    for b in batches:
        rows = []
        for i, command in zip(b.column("id").to_pylist(), b.column("command").to_pylist()):
            lexer = shlex.shlex(command or "", posix=True, punctuation_chars=";&|")
            lexer.whitespace_split = True
            try:
                words = list(lexer)
            except ValueError:  # a quote that does not close
                words = (command or "").split()
            own: list[str] = []
            for w in [*words, ";"]:
                if w and set(w) <= set(";&|"):
                    tool = _tool_of([x for x in own if not x.startswith("-")])
                    if tool is not None:
                        rows.append((i, tool, len(own)))
                    own = []
                elif own or "=" not in w or w.startswith("-"):  # no environment assignment
                    own.append(w)
        cols = list(zip(*rows)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32()))], names=["id", "tool", "words"])


def script_tools(commands: DataFrame) -> DataFrame:
    """Tools that shell commands(id, command) start, one row each: quoting, separators, assignments and package runners are seen through."""
    return commands.select("id", "command").mapInArrow(_tools, TOOLS)


def glob_pattern(glob: str) -> str:
    """A glob of one level (*) and any depth (**) as a regular expression over whole paths; braces are alternatives."""
    import re

    out = []
    for part in re.findall(r"\*\*/|\*\*|\*|\?|\{[^}]*\}|[^*?{]+|\{", glob):
        if part in ("**/", "**"):
            out.append("(?:.*/)?" if part == "**/" else ".*")
        elif part == "*":
            out.append("[^/]*")
        elif part == "?":
            out.append("[^/]")
        elif part.startswith("{") and part.endswith("}"):
            out.append("(?:" + "|".join(re.escape(x) for x in part[1:-1].split(",")) + ")")
        else:
            out.append(re.escape(part))
    return "^" + "".join(out) + "$"
