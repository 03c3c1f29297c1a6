"""What a repository says about itself: a few named files and its outermost shape, hashed so that edits inside it don't count.

Surfaces are found by shallow globs, in order; a surface's content is its files one after the other, each behind a marker. The
manifest lists surfaces with their hashes and then their contents: the text that is captured as the repository's source.
Named files are few by definition; their contents are read by executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import hashing as H
from attesta.functions import text as T

#: Surfaces and where they are looked for.
SURFACES = [
    ("readme", ["README.md", "README.rst", "README.txt", "README"]),
    ("agent_contract", ["CLAUDE.md", "AGENTS.md", "GEMINI.md", ".github/copilot-instructions.md"]),
    ("architecture", ["ARCHITECTURE.md", "docs/ARCHITECTURE.md", "docs/*/ARCHITECTURE.md", "ARCHITECTURE"]),
    ("adrs", ["docs/decisions/*.md", "docs/adr/*.md", "docs/adrs/*.md"]),
    ("contract", ["openapi.yaml", "openapi.json", "openapi/*.yaml", "api/*.proto", "proto/*.proto", "*.proto", "schema.graphql"]),
    ("manifest", [
        "package.json", "pyproject.toml", "Cargo.toml", "go.mod", "setup.py", "setup.cfg", "composer.json", "Gemfile",
        "CODEOWNERS", ".github/CODEOWNERS", "docs/CODEOWNERS",
    ]),
    ("deploy", [
        "docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml", "*/docker-compose.yml", "*/docker-compose.yaml", "*/compose.yml", "*/compose.yaml",
        "Chart.yaml", "*/Chart.yaml", "charts/*/Chart.yaml", "kustomization.yaml", "kustomization.yml", "*/kustomization.yaml", "*/kustomization.yml",
        "serverless.yml", "serverless.yaml", "*.tf", "*/main.tf", "fly.toml", "render.yaml", "render.yml", "Procfile",
    ]),
]
#: Entries that say nothing about a repository's shape.
NOISE = [
    ".git", ".odin", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", ".mypy_cache", ".pytest_cache", "dist", "build",
    ".DS_Store", ".idea", ".vscode", ".ruff_cache", ".tox",
]
SHAPE = "(top-level shape)"


def surfaces(spark: SparkSession, repo: str, more: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """(place, label, paths, content, hash) of the surfaces a repository has, in order; its shape is the last."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = jvm.Path(repo)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.getFileStatus(root).getPath().toString().rstrip("/") + "/"
    found: dict[tuple[int, str], list[str]] = {}
    for place, (label, globs) in enumerate([*SURFACES, *(more or [])]):
        for g in globs:
            for path in sorted(x.getPath().toString() for x in (fs.globStatus(jvm.Path(root, g)) or []) if x.isFile()):
                own = found.setdefault((place, label), [])
                if path not in own:
                    own.append(path)
    top = sorted((x.getPath().getName(), x.isDirectory()) for x in fs.listStatus(root) if x.getPath().getName() not in NOISE)
    shape = "".join(f"{name}{'/' * folder}\n" for name, folder in top) or "\n"
    last = spark.createDataFrame([(len(SURFACES) + len(more or []), "topology", [SHAPE], shape)], "place int, label string, paths array<string>, content string")
    if not found:
        return last.withColumn("hash", H.bytes_hash(F.col("content")))
    rows = [(place, label, k, path, path.removeprefix(base)) for (place, label), own in found.items() for k, path in enumerate(own)]
    named = spark.createDataFrame(rows, "place int, label string, at int, path string, own string")
    files = spark.read.format("binaryFile").load(sorted({r[3] for r in rows})).select("path", T.newlines(F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))
    marked = named.join(files, "path").withColumn("part", F.concat(F.lit("<!-- file: "), "own", F.lit(" -->\n"), "text"))
    groups = marked.groupBy("place", "label").agg(F.array_sort(F.collect_list(F.struct("at", "own", "part"))).alias("all"))
    groups = groups.select("place", "label", F.col("all.own").alias("paths"), F.array_join("all.part", "\n").alias("content"))
    return groups.unionByName(last).withColumn("hash", H.bytes_hash(F.col("content")))


def manifest(own: DataFrame, head: str | None = None) -> DataFrame:
    """(text), one row: the manifest of surfaces()."""
    line = F.concat(F.lit("- "), "label", F.lit(": "), F.array_join("paths", ", "), F.lit(" — "), "hash")
    part = F.concat(F.lit("<!-- ═════ constitution surface: "), "label", F.lit(" ═════ -->\n"), F.regexp_replace("content", r"\n+$", ""), F.lit("\n"))
    every = own.agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line"), part.alias("part")))).alias("x"))
    opening = F.concat(F.lit("# Repository constitution\n\n" + (f"inferred-at-commit: {head}\n" if head else "") + "surfaces: "), F.size("x").cast("string"), F.lit("\n\n"))
    return every.select(F.concat(opening, F.array_join("x.line", "\n"), F.lit("\n\n---\n\n"), F.array_join("x.part", "\n"), F.lit("\n")).alias("text"))


def named_surfaces(text: Column) -> Column:
    """array<struct<label, path, hash>> from the head of a manifest: lines up to the first `---`."""
    lines = F.transform(F.split(T.newlines(text), "\n"), lambda x: F.rtrim(x))
    stop = F.array_position(lines, "---")
    head = F.slice(lines, F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size(lines)).cast("int"))
    pattern = r"^- ([^:]+): (.*) — (sha256:\S*)$"
    cut = lambda x, k: F.regexp_extract(x, pattern, k)
    each = F.transform(
        F.filter(head, lambda x: x.rlike(pattern)),
        lambda x: F.transform(F.split(cut(x, 2), ","), lambda p: F.struct(T.strip(cut(x, 1)).alias("label"), T.strip(p).alias("path"), cut(x, 3).alias("hash"))),
    )
    return F.filter(F.flatten(each), lambda s: s["path"] != "")
