"""Source texts: file collections, import lines, tokens, and line search."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import names
from quern.session import ship

#: Characters of a source token: fixed values, apart from letters and digits.
TOKEN_MARKS = "_-'!?<>=+*/#$%&^~|:"
#: Characters that an occurrence must not touch to count as a whole token.
BOUNDARY_MARKS = "_'<>=+*/!?#$%&^~|:.-"
ELIDED = "⋯"
_TOKEN = regex.compile(rf"[A-Za-z0-9{regex.escape(TOKEN_MARKS)}\x80-\U0010FFFF]+")
_MODULE = regex.compile(r"[A-Za-z0-9._'\-\x80-\U0010FFFF]*")
_COMMENT = regex.compile(r"\{-|-\}")
_SKIPPED = {"module", "renaming", "hiding", "to", "public"}
SCAN = "struct<imports: array<struct<line: int, module: string, using: array<string>, public: boolean, scope: int>>, tokens: array<struct<token: string, in_body: boolean>>>"


def read_files(spark: SparkSession, path: str, keep: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """``path, text`` of whole files under a path or pattern; globs keep or exclude paths."""
    f = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    anywhere = lambda globs: [names.glob_match(F.col("path"), g if g.startswith(("/", "file:", "**")) else f"**/{g}") for g in globs]
    if keep:
        cond = F.lit(False)
        for c in anywhere(keep):
            cond = cond | c
        f = f.where(cond)
    for c in anywhere(exclude or []):
        f = f.where(~c)
    return f


def search_lines(files: DataFrame, pattern: str, limit: int | None = None) -> DataFrame:
    """``path, line, text``: the lines that a pattern matches, by path and line."""
    lines = files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    found = lines.where(F.col("text").rlike(pattern)).orderBy("path", "line")
    return found if limit is None else found.limit(limit)


def without_blocks(text: str) -> str:
    """Block comments, nested ones too, out; their line breaks stay, so that lines keep their numbers."""
    out, depth, at = [], 0, 0
    for m in _COMMENT.finditer(text):
        if m.start() < at:
            continue
        if depth == 0 and m[0] == "-}":
            continue
        piece = text[at : m.start()]
        out.append(piece if depth == 0 else "\n" * piece.count("\n"))
        depth += 1 if m[0] == "{-" else -1
        at = m.end()
    rest = text[at:]
    out.append(rest if depth == 0 else "\n" * rest.count("\n"))
    return "".join(out)


def _using(words: list[str]) -> list[str] | None:
    """The names of a ``using (...)`` clause on the line; None without one."""
    if "using" not in words:
        return [] if any(ELIDED in w for w in words) else None
    rest = " ".join(words[words.index("using") + 1 :])
    if not rest.startswith("("):
        return []
    depth, inner = 0, None
    for i, c in enumerate(rest):
        depth += (c == "(") - (c == ")")
        if depth == 0:
            inner = rest[1:i]
            break
    return [] if inner is None else [w for w in regex.split(r"[;,\s]+", inner) if w and w not in _SKIPPED]


def scan(text: str) -> dict:
    """Import statements, each with the header line of the block it is in (0 at the top), and all tokens, ``in_body`` where
    they also occur outside import statements."""
    imports, everywhere, body = [], set(), set()
    open_blocks: list[tuple[int, int]] = []
    for n, line in enumerate(without_blocks(text).split("\n"), 1):
        line = line.split("--", 1)[0]
        words = line.split()
        found = set(_TOKEN.findall(line))
        everywhere |= found
        statement = words[:2] == ["open", "import"] and len(words) > 2 or words[:1] == ["import"] and len(words) > 1
        if not statement:
            body |= found
        if not words:
            continue
        indent = len(line) - len(line.lstrip(" "))
        while open_blocks and open_blocks[-1][0] >= indent:
            open_blocks.pop()
        if statement:
            opened = words[0] == "open"
            args = words[3:] if opened else words[2:]
            imports.append((n, _MODULE.match(words[2] if opened else words[1])[0], _using(args), opened and "public" in args, open_blocks[-1][1] if open_blocks else 0))
        elif words[0] == "module" and "where" in words:
            open_blocks.append((indent, n))
    return {"imports": imports, "tokens": [(t, t in body) for t in sorted(everywhere)]}


def scanned(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(imports(path, line, module, using, public, scope), tokens(path, token, in_body))`` of ``files(path, text)``."""
    from quern.session import materialise

    ship(files.sparkSession)

    @F.pandas_udf(SCAN)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scan(x or "") for x in s], columns=["imports", "tokens"])

    got = materialise(files.select("path", run("text").alias("s")), "scanned")
    imports = got.select("path", F.explode("s.imports").alias("i")).select("path", "i.*")
    return imports, got.select("path", F.explode("s.tokens").alias("t")).select("path", "t.*")


def count_tokens(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """``path, token, n``: whole-token occurrences of ``wanted(path, token)`` in each file's text."""
    ship(files.sparkSession)
    mark = rf"[A-Za-z0-9{regex.escape(BOUNDARY_MARKS)}\x7f-\U0010FFFF]"

    @F.pandas_udf("array<struct<token: string, n: long>>")
    def run(texts: pd.Series, tokens: pd.Series) -> pd.Series:
        count = lambda t, w: len(regex.findall(rf"(?<!{mark}){regex.escape(w)}(?!{mark})", t or ""))
        return pd.Series([[(w, count(t, w)) for w in ws] for t, ws in zip(texts, tokens)])

    per = wanted.where("token <> ''").groupBy("path").agg(F.collect_set("token").alias("ws"))
    got = files.join(per, "path").select("path", F.explode(run("text", "ws")).alias("c"))
    return got.select("path", "c.token", "c.n")
