"""Repository trees: which paths are sources or manifests, what is read of them, and what a layout says.

A tree has a row (repo, path, size) for each file, with ``content`` where it is to be read. Lists are fixed values of the
service.
"""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditspark.functions import text
from auditspark.operators import external, inventory

#: Fixed values.
IGNORED_DIRS = ("vendor", "venv", ".venv", "env", "virtualenv", "site-packages", "__pycache__", ".next", ".nuxt", "out", "target", "obj", "bin", "bower_components", ".terraform", ".idea", ".vscode", "storage")
MANIFESTS = {
    "package.json": "npm", "requirements.txt": "pip", "pyproject.toml": "pip", "Pipfile": "pip", "Pipfile.lock": "pip", "poetry.lock": "pip", "pom.xml": "maven", "build.gradle": "gradle",
    "build.gradle.kts": "gradle", "composer.json": "composer", "Gemfile": "bundler", "Gemfile.lock": "bundler", "go.mod": "go", "Cargo.toml": "cargo", "Cargo.lock": "cargo",
}
MOST_BYTES, MOST_FILES, MOST_LINES, MOST_ENTRIES = 256 * 1024, 150, 4000, 100_000
HISTOGRAM = {
    "py": "Python", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript", "java": "Java", "go": "Go", "rb": "Ruby", "rs": "Rust", "php": "PHP", "cs": "C#",
}
FRAMEWORKS = (
    ("fastapi", "FastAPI", "Backend framework"), ("flask", "Flask", "Backend framework"), ("django", "Django", "Backend framework"), ("express", "Express", "Backend framework"), ("next", "Next.js", "Frontend framework"),
    ("nextjs", "Next.js", "Frontend framework"), ("react", "React", "Frontend framework"), ("vue", "Vue.js", "Frontend framework"), ("@angular/core", "Angular", "Frontend framework"), ("svelte", "Svelte", "Frontend framework"),
    ("spring-boot-starter-web", "Spring Boot", "Backend framework"), ("sqlalchemy", "SQLAlchemy", "Database layer"), ("psycopg2", "PostgreSQL driver (psycopg2)", "Database layer"), ("asyncpg", "PostgreSQL driver (asyncpg)", "Database layer"),
    ("pymongo", "MongoDB driver (PyMongo)", "Database layer"), ("redis", "Redis client", "Cache/Datastore"), ("mongoose", "Mongoose (MongoDB)", "Database layer"), ("pg", "PostgreSQL driver (node-postgres)", "Database layer"),
    ("mysql2", "MySQL driver", "Database layer"), ("sqlite3", "SQLite driver", "Database layer"), ("prisma", "Prisma ORM", "Database layer"), ("typeorm", "TypeORM", "Database layer"), ("sequelize", "Sequelize ORM", "Database layer"),
    ("celery", "Celery", "Background jobs"), ("bullmq", "BullMQ", "Background jobs"), ("sidekiq", "Sidekiq", "Background jobs"), ("kafka-python", "Kafka client", "Message broker"), ("groq", "Groq client", "AI/LLM"),
    ("openai", "OpenAI client", "AI/LLM"), ("anthropic", "Anthropic client", "AI/LLM"), ("langchain", "LangChain", "AI/LLM"), ("langsmith", "LangSmith", "AI/LLM"), ("transformers", "HuggingFace Transformers", "AI/ML"),
)
INFRA = (
    ("dockerfile", "Docker", "Containerization"), ("docker-compose.yml", "Docker Compose", "Containerization"), ("docker-compose.yaml", "Docker Compose", "Containerization"), ("render.yaml", "Render", "Deployment config"),
    ("vercel.json", "Vercel", "Deployment config"), ("nginx.conf", "nginx", "Web server config"), (".github/workflows", "GitHub Actions", "CI/CD"),
)
TEST_TOOLS = ((r"(^|/)(pytest\.ini|conftest\.py|pytest[^/]*\.cfg)$", "pytest"), (r"jest\.config", "Jest"), (r"vitest\.config\.(ts|js)$", "Vitest"))
HOTSPOT = r"(?i)\b(auth|login|password|secret|key|token|db|database|config|credential|jwt|sign|verify)\b"
EXEMPT = ("setup", "manage", "wsgi", "asgi", "__init__", "app", "main")


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    """path (below ``folder``), size and content of all files; readers that do not ask for the content do not load it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/").split("://")[-1]
    return files.select(F.regexp_replace("path", rf"^[a-z]*:/*\Q/{root.lstrip('/')}/\E|^[a-z]+:\Q{root}/\E", "").alias("path"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("content"))


def tree_summary(tree: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """repo, files, bytes, truncated (more entries than a listing returns)."""
    return tree.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")).withColumn("truncated", F.col("files") > most)


def is_ignored(path: Column) -> Column:
    dirs = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    name = inventory.basename(path)
    return inventory.should_skip(path) | F.exists(dirs, lambda x: x.isin(*IGNORED_DIRS) | x.startswith(".")) | name.endswith(".min.js") | name.endswith(".min.css") | name.endswith(".map")


def source_paths(tree: DataFrame) -> DataFrame:
    """Sources that are not ignored, with their place by size."""
    kept = tree.where((inventory.file_type(F.col("path")) == "source") & ~is_ignored(F.col("path")))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy("size", "path")))


def ecosystem_of(path: Column) -> Column:
    """By the exact name of the file; null where it is no manifest."""
    known = F.create_map(*[F.lit(x) for pair in MANIFESTS.items() for x in pair])
    return F.try_element_at(known, F.substring_index(path, "/", -1))


def manifests(tree: DataFrame, ignored: bool = False) -> DataFrame:
    """Manifests and their ecosystem; ``ignored`` keeps those on ignored paths too."""
    own = tree.withColumn("ecosystem", ecosystem_of(F.col("path"))).where(F.col("ecosystem").isNotNull())
    return own if ignored else own.where(~is_ignored(F.col("path")))


def by_glob(tree: DataFrame, pattern: str) -> DataFrame:
    """Paths whose name or whole path matches a shell pattern."""
    form = "^" + fnmatch.translate(pattern).replace(r"\z", r"\Z")
    return tree.where(F.col("path").rlike(form) | F.substring_index("path", "/", -1).rlike(form))


def fetched_sources(tree: DataFrame, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES, most_lines: int = MOST_LINES) -> DataFrame:
    """repo, path, lines of the sources read: smallest first within the budget of files, no large and no blank ones, each cut
    to its first lines."""
    lines = F.slice(text.split_lines(F.col("content")), 1, most_lines)
    own = source_paths(tree.where(F.col("size") <= most_bytes)).withColumn("lines", lines).where(F.exists("lines", lambda x: text.strip(x) != ""))
    return own.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy("size", "path"))).where(F.col("place") <= most_files)


def languages(tree: DataFrame) -> DataFrame:
    """repo, language, files by extension."""
    known = F.create_map(*[F.lit(x) for pair in HISTOGRAM.items() for x in pair])
    ext = F.when(F.col("path").contains("."), F.lower(F.substring_index("path", ".", -1)))
    return tree.where(~is_ignored(F.col("path"))).select("repo", F.try_element_at(known, ext).alias("language")).where(F.col("language").isNotNull()).groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"))


def components(tree: DataFrame, most: int = 12) -> DataFrame:
    """The ``most`` largest top directories, files at the root counting as one, and of these those of two files or more."""
    top = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise("(root)")
    counts = tree.where(~is_ignored(F.col("path"))).groupBy("repo", top.alias("name")).agg(F.count(F.lit(1)).alias("file_count"))
    place = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("file_count"), "name"))
    return counts.withColumn("place", place).where((F.col("place") <= most) & ((F.col("file_count") >= 2) | (F.col("name") == "(root)")))


def entry_points(tree: DataFrame, most: int = 15) -> DataFrame:
    found = external.entry_points(tree.where(~is_ignored(F.col("path"))))
    place = F.row_number().over(Window.partitionBy("repo").orderBy(F.when(F.col("level") == "root", 0).otherwise(1), "path"))
    return found.withColumn("place", place).where(F.col("place") <= most)


def mixed_stack(tree: DataFrame) -> DataFrame:
    """Repositories with Python and TypeScript or JSX files, but neither a frontend nor a backend directory."""
    own = tree.where(~is_ignored(F.col("path")))
    p = F.col("path")
    counts = own.groupBy("repo").agg(F.count_if(p.endswith(".ts") | p.endswith(".tsx") | p.endswith(".jsx")).alias("scripts"), F.count_if(p.endswith(".py")).alias("pythons"))
    split = external.layers(own).where(F.col("layer").isin("frontend/ui", "backend/api")).select("repo").distinct()
    return counts.where((F.col("scripts") > 0) & (F.col("pythons") > 0)).join(split, "repo", "left_anti")


def folder_tree(tree: DataFrame, most: int = 20) -> DataFrame:
    """repo, place, name, is_dir, files: the first ``most`` names at the root."""
    own = tree.where(~inventory.should_skip(F.col("path"))).select("repo", F.substring_index("path", "/", 1).alias("name"), F.col("path").contains("/").alias("nested"))
    names = own.groupBy("repo", "name").agg(F.max("nested").alias("is_dir"), F.count(F.lit(1)).alias("files"))
    return names.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy("name"))).where(F.col("place") <= most)


def stem_of(path: Column) -> Column:
    """The name without its extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=[^.])\.[^.]*$", "")


def untested_sources(tree: DataFrame) -> DataFrame:
    """repo, path of sources whose stem neither contains a test's stem nor is contained in one.

    All pieces of the distinct stems, which are short, are joined by equality in both directions."""
    p = F.col("path")
    own = tree.where(~inventory.should_skip(p)).select("repo", "path", stem_of(p).alias("stem"), inventory.is_test(p).alias("is_test"), (inventory.file_type(p) == "source").alias("is_source"))
    sources = own.where(F.col("is_source") & ~F.col("is_test") & ~F.col("stem").isin(*EXEMPT))
    pieces = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("stem")), lambda i: F.transform(F.sequence(F.lit(1), F.length("stem") - i + 1), lambda n: F.substring("stem", i, n)))))
    stems = lambda rows: rows.select("repo", "stem").where(F.col("stem") != "").distinct()
    tests, wanted = stems(own.where("is_test")), stems(sources)
    within = tests.select("repo", F.explode(pieces).alias("stem")).distinct()
    around = wanted.select("repo", "stem", F.explode(pieces).alias("piece")).join(tests.withColumnRenamed("stem", "piece"), ["repo", "piece"], "left_semi").select("repo", "stem").distinct()
    return sources.join(within.unionByName(around).distinct(), ["repo", "stem"], "left_anti").select("repo", "path")


def docstring_coverage(tree: DataFrame, samples: int = 5) -> DataFrame:
    """repo, checked, percent: the share of the first sources that hold a documentation mark, rounded half to even."""
    p = F.col("path")
    own = tree.where(~inventory.should_skip(p) & (inventory.file_type(p) == "source") & ~inventory.is_test(p))
    first = own.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy("path"))).where(F.col("place") <= samples)
    marked = external.has_any(F.col("content"), ('"""', "'''", "/**", "/*"))
    return first.groupBy("repo").agg(F.count(F.lit(1)).alias("checked"), F.bround(F.avg(marked.cast("int")) * 100, 0).cast("int").alias("percent"))


def hotspots(tree: DataFrame) -> DataFrame:
    p = F.col("path")
    return tree.where(~inventory.should_skip(p) & (inventory.file_type(p) == "source") & ~inventory.is_test(p) & p.rlike(HOTSPOT)).select("repo", "path", F.round(F.col("size") / 1024, 2).alias("size_kb"))


def file_metadata(tree: DataFrame) -> DataFrame:
    """Imports, exports, functions and classes of each source by the first words of its lines, with caps, lines and bytes."""
    lang, lines = inventory.language(F.col("path")), F.transform(text.split_lines(F.col("content")), text.strip)
    own = tree.where(inventory.file_type(F.col("path")) == "source").select("repo", "path", lang.alias("language"), F.octet_length("content").alias("size_bytes"), F.explode(F.array(lines)).alias("lines"))
    script, python, java, go = (F.col("language").isin(*x) for x in (("JavaScript", "TypeScript"), ("Python",), ("Java",), ("Go",)))

    def named(pattern: str) -> Column:
        return F.filter(F.transform("lines", lambda s: F.regexp_extract(s, pattern, 1)), lambda x: x != "")

    def starting(*words: str) -> Column:
        return F.transform(F.filter("lines", lambda s: s.rlike("^(" + "|".join(words) + ")")), lambda s: F.substring(s, 1, 120))

    nothing = F.array().cast("array<string>")
    # a script line names a function in one of two ways, never both
    functions = F.when(python, named(r"^def\s+(\w+)\s*\(")).when(script, named(r"^(?:export\s+)?(?:(?:async\s+)?function\s+(?=\w)|(?:const|let|var)\s+(?=\w+\s*=\s*(?:async\s*)?\())(\w+)")).when(go, named(r"^func\s+(\w+)\s*\(")).otherwise(nothing)
    classes = F.when(python, named(r"^class\s+(\w+)")).when(script, named(r"^(?:export\s+)?class\s+(\w+)")).when(java, named(r"^(?:public|private|protected)?\s*(?:abstract|final)?\s*class\s+(\w+)")).otherwise(nothing)
    imports = F.when(python, starting("import ", "from ")).when(script, starting("import ", r"require\(")).when(java | go, starting("import ")).otherwise(nothing)
    exports = F.when(script, F.transform(F.filter("lines", lambda s: s.contains("export ")), lambda s: F.substring(s, 1, 120))).otherwise(nothing)
    return own.select("repo", "path", "language", F.size("lines").alias("line_count"), "size_bytes", F.slice(imports, 1, 20).alias("imports"), F.slice(exports, 1, 10).alias("exports"), F.slice(functions, 1, 30).alias("functions"), F.slice(classes, 1, 20).alias("classes"))


def frameworks(tree: DataFrame, packages: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """repo, name, category, evidence: technologies by declared packages, by config files, and by compose contents.

    ``packages`` (repo, path, pos, name) are the manifests' packages, a name counting for the first manifest by path;
    ``given`` (repo, path, content) are the contents that compose files are sought in. Of equal names the first stays."""
    spark, p = tree.sparkSession, F.lower("path")
    dims = spark.createDataFrame([(k, *row) for k, row in enumerate(FRAMEWORKS)], "ord int, package string, name string, category string")
    first = packages.groupBy("repo", F.lower("name").alias("package")).agg(F.min("path").alias("path"))
    declared = first.join(F.broadcast(dims), "package").select("repo", "ord", "name", "category", F.concat(F.lit("Declared in "), "path").alias("evidence"))
    own = tree.where(~is_ignored(F.col("path")))
    marks = [F.when((p == m) | p.endswith("/" + m) | p.startswith(m), F.struct(F.lit(100 + k).alias("ord"), F.lit(n).alias("name"), F.lit(c).alias("category"))) for k, (m, n, c) in enumerate(INFRA)]
    config = own.select("repo", p.alias("p"), F.explode(F.filter(F.array(*marks), lambda x: x.isNotNull())).alias("m")).groupBy("repo", "m.ord", "m.name", "m.category").agg(F.concat(F.lit("Found config file: "), F.min("p")).alias("evidence"))
    tools = [F.when(p.rlike(form), F.struct(F.lit(300 + k).alias("ord"), F.lit(n).alias("name"), F.lit("Testing").alias("category"))) for k, (form, n) in enumerate(TEST_TOOLS)]
    said = F.when(F.col("m.name") == "pytest", F.concat(F.lit("Found: "), F.min("path"))).otherwise(F.concat(F.lit("Found "), F.lower("m.name"), F.lit(".config")))
    tests = own.select("repo", "path", F.explode(F.filter(F.array(*tools), lambda x: x.isNotNull())).alias("m")).groupBy("repo", "m.ord", "m.name", "m.category").agg(said.alias("evidence"))
    found = declared.unionByName(config).unionByName(tests)
    if given is not None:
        compose = given.where(F.lower("path").contains("docker-compose"))
        pairs = (("postgres", 200, "PostgreSQL", "Database"), ("redis", 201, "Redis", "Cache/Broker"))
        services = [F.when(F.lower("content").contains(w), F.struct(F.lit(o).alias("ord"), F.lit(n).alias("name"), F.lit(c).alias("category"), F.concat(F.lit(f"{w} service in "), "path").alias("evidence"))) for w, o, n, c in pairs]
        found = found.unionByName(compose.select("repo", F.explode(F.filter(F.array(*services), lambda x: x.isNotNull())).alias("m")).select("repo", "m.*"))
    place = F.row_number().over(Window.partitionBy("repo", F.lower("name")).orderBy("ord", "evidence"))
    return found.withColumn("place", place).where(F.col("place") == 1).select("repo", "name", "category", "evidence")
