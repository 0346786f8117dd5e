"""Reports over a table of tracked files (path, size): audit, cleanup, listing, tree."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
BINARY = "png jpg jpeg gif ico svg woff woff2 eot ttf otf pdf zip gz tar exe dll so dylib bin dat a lib obj pdb o pyc class jar".split()
GENERATED_NAMES = ("lock", "bundle", "chunk")
LARGE = 100 * 1024
REMOVABLE = "png jpg jpeg gif dylib dll exe pdb so ico a lib obj o pyc class jar".split()
BUILD_FOLDERS = ("bin/", "obj/", "node_modules/", "target/", "__pycache__/", "packages/")
LOCKS = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "gemfile.lock")
#: A project's kind, and the pattern of a path that shows it.
KINDS = (("dotnet", r"\.(sln|csproj)$"), ("node", r"^package\.json$"), ("python", r"\.py$"), ("swift", r"\.(swift|xcodeproj)$"), ("rust", r"^Cargo\.toml$"), ("ruby", r"^Gemfile$"))
COMMON_RULES = ("Thumbs.db", "*.DS_Store", "Desktop.ini", "*.swp", "*.swo", "*~", ".idea/", ".vs/", ".vscode/", "*.sln.iml", "*.user", "*.suo")
RULES = {
    "dotnet": ("bin/", "obj/", "*.dll", "*.exe", "*.pdb", "*.so", "*.dylib", "packages/", "*.nupkg", "[Dd]ebug/", "[Rr]elease/", ".vs/"),
    "node": ("node_modules/", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "*.tgz", "npm-debug.log*", "yarn-error.log*"),
    "python": ("__pycache__/", "*.py[cod]", "*.egg-info/", "dist/", "build/", "*.egg", ".venv/", "venv/"),
    "swift": ("*.png", "*.jpg", "*.jpeg", "*.dylib", "*.ipa", "*.dSYM.zip", "*.dSYM", "DerivedData/", "build/"),
    "rust": ("target/", "Cargo.lock"),
    "ruby": ("vendor/bundle/", ".bundle", "Gemfile.lock"),
}


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The last suffix in lower case with its dot; a leading dot begins a name, not a suffix."""
    return F.lower(F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1))


def flags(files: DataFrame) -> DataFrame:
    """files with is_binary, is_generated and is_large."""
    path = F.col("path")
    ext = extension(path)
    named = ext == ".lock"
    for x in GENERATED_NAMES:
        named = named | path.contains(x)
    return files.withColumns({"is_binary": ext.isin(*[f".{x}" for x in BINARY]), "is_generated": named, "is_large": F.col("size") > LARGE})


def audit(files: DataFrame) -> DataFrame:
    """One row of totals. A generated file counts half a token again for each of its tokens in total_waste."""
    quarter = F.ceil(F.col("size") / 4)
    own = flags(files).agg(
        F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
        F.count_if("is_binary").alias("n_binary"), F.count_if("is_generated").alias("n_generated"), F.count_if("is_large").alias("n_large"),
        F.coalesce(F.sum(F.when(F.col("is_binary"), quarter)), F.lit(0)).alias("binary_tokens"),
        F.coalesce(F.sum(F.when(F.col("is_generated"), quarter / 2)), F.lit(0.0)).alias("generated_half"),
        F.coalesce(F.sum(F.when(F.col("is_generated"), F.col("size"))), F.lit(0)).alias("generated_size"),
    )
    waste = F.col("binary_tokens") + F.col("generated_half")
    out = own.withColumns({"total_tokens": F.ceil(F.col("total_size") / 4).cast("long"), "waste_tokens": F.ceil(waste).cast("long"), "total_waste": F.ceil(waste + F.col("generated_size") / 8).cast("long")})
    share = F.when(F.col("total_tokens") > 0, F.round(F.col("total_waste") / F.col("total_tokens") * 100, 1)).otherwise(0.0)
    return out.withColumn("waste_pct", share).drop("generated_half", "generated_size", "binary_tokens")


def top_files(files: DataFrame, k: int = 10) -> DataFrame:
    """The k largest files that aren't binary: path, size, tokens."""
    return flags(files).where("not is_binary").orderBy(F.desc("size"), "path").limit(k).select("path", "size", F.ceil(F.col("size") / 4).cast("long").alias("tokens"))


def removable(files: DataFrame) -> DataFrame:
    """Binary, built and lock files."""
    path = F.col("path")
    built = F.lit(False)
    for x in BUILD_FOLDERS:
        built = built | path.startswith(x)
    return files.where(extension(path).isin(*[f".{x}" for x in REMOVABLE]) | built | F.lower(base_name(path)).isin(*LOCKS))


def top_removable(files: DataFrame, k: int = 15) -> DataFrame:
    return removable(files).orderBy(F.desc("size"), "path").limit(k)


def project_kinds(files: DataFrame) -> DataFrame:
    """kind: those that some path shows, in one pass."""
    seen = files.agg(*[F.coalesce(F.bool_or(F.col("path").rlike(p)), F.lit(False)).alias(k) for k, p in KINDS])
    return seen.select(F.explode(F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k, _ in KINDS]))).alias("kind"))


def ignore_rules(files: DataFrame) -> DataFrame:
    """section, rule: what should be ignored; common rules, those of the project's kinds, and what was seen."""
    spark = files.sparkSession
    common = spark.createDataFrame([("common", r) for r in COMMON_RULES], "section string, rule string")
    table = spark.createDataFrame([(k, r) for k, rules in RULES.items() for r in rules], "section string, rule string")
    own = table.join(F.broadcast(project_kinds(files)), F.col("section") == F.col("kind")).select("section", "rule")  # six rows at most
    seen = files.where(extension(F.col("path")).isin(*[f".{x}" for x in REMOVABLE])).select(F.lit("binary").alias("section"), F.concat(F.lit("*"), extension(F.col("path"))).alias("rule"))
    folder = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1))
    built = files.select(folder.alias("f")).where(F.col("f").isin("bin", "obj", "build", "target", "node_modules", "packages", "__pycache__")).select(F.lit("folder").alias("section"), F.concat("f", F.lit("/")).alias("rule"))
    return common.unionByName(own).unionByName(seen.unionByName(built).distinct())


def glob_pattern(glob: str | None) -> str:
    """A pattern for base names: * and ? only; folders before the name are left out."""
    if not glob or glob == "*":
        return "(?s).*"
    name = re.sub(r"^\*+/", "", glob)
    return "(?i)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in name) + "$"


def matching(files: DataFrame, glob: str | None = None, limit: int | None = 500) -> DataFrame:
    """Files whose base name matches, outside dot folders and node_modules."""
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    found = files.where(~folder.rlike(r"(^|/)(\.[^/]*|node_modules)/") & base_name(F.col("path")).rlike(glob_pattern(glob)))
    return found if limit is None else found.orderBy("path").limit(limit)


def tree(files: DataFrame, depth: int = 3) -> DataFrame:
    """path, level, line: an indented listing to be read in order of path; folders come from their files' paths."""
    own = files.where(~F.col("path").rlike(r"(^|/)(\.|node_modules/)"))
    parts = F.split("path", "/")
    folders = own.where(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))).alias("path"))
    folders = folders.distinct().withColumn("level", F.size(F.split("path", "/")) - 1)
    kilo = F.format_string("%.1f", F.bround(F.col("size") / 1024, 1))  # halves go to the even tenth, as in SQL; Java's format takes them up
    shown = F.when(F.col("size") < 1024, F.concat(F.col("size").cast("string"), F.lit("B"))).otherwise(F.concat(kilo, F.lit("KB")))
    leaf = F.concat(F.repeat(F.lit("  "), F.size(parts)), F.lit("📄 "), base_name(F.col("path")), F.lit(" ("), shown, F.lit(", ~"), F.ceil(F.col("size") / 4).cast("string"), F.lit(" tok)"))
    files_ = own.select("path", F.size(parts).alias("level"), leaf.alias("line"))
    name = F.regexp_extract("path", r"([^/]+)/$", 1)
    folders = folders.select("path", "level", F.concat(F.expr("repeat('  ', level)"), F.lit("📁 "), name, F.lit("/")).alias("line"))
    return folders.unionByName(files_).where(F.col("level") <= depth)
