"""Queries over files: lines, clones, inventory, smells that need no parser."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditspark.functions import text
from auditspark.operators import clones, inventory, tree
from auditspark.sources.adapters import files, sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LINES = r""", split AS (SELECT repo, file_id, CASE WHEN content[-1:] = chr(10) THEN string_split(content[:-2], chr(10)) WHEN content = '' THEN [] ELSE string_split(content, chr(10)) END AS ls FROM files),
lines AS (SELECT repo, file_id, i AS line_no, ls[i] AS line, trim(ls[i], ' ' || chr(9) || chr(13)) AS stripped FROM (SELECT repo, file_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM split))"""
NORM = LINES + r""", cut AS (SELECT *, regexp_replace(CASE WHEN regexp_matches(stripped, '^#') THEN '' ELSE regexp_replace(stripped, '([^:''"])#.*$', '\1') END, '//.*$', '') AS bare FROM lines),
norm AS (SELECT repo, file_id, line_no, norm, row_number() OVER (PARTITION BY repo, file_id ORDER BY line_no) - 1 AS pos FROM (SELECT repo, file_id, line_no,
  CASE WHEN stripped[1:1] IN ('#', '*') OR stripped[1:2] IN ('//', '/*', '--') OR stripped[1:4] = '<!--' THEN '' ELSE trim(rtrim(trim(regexp_replace(bare, '\s+', ' ', 'g')), ';')) END AS norm FROM cut) WHERE norm <> '')"""
WINDOWS = NORM + """, win AS (SELECT repo, file_id, pos, line_no AS start_line, lead(line_no, 5) OVER w AS end_line,
  concat_ws(chr(10), norm, lead(norm) OVER w, lead(norm, 2) OVER w, lead(norm, 3) OVER w, lead(norm, 4) OVER w, lead(norm, 5) OVER w) AS block FROM norm WINDOW w AS (PARTITION BY repo, file_id ORDER BY pos)),
windows AS (SELECT repo, file_id, CAST(pos AS INTEGER) AS pos, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, sha1(block) AS token_hash FROM win WHERE end_line IS NOT NULL)"""


def query(oracle: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = sql(oracle)
        return f

    return add


@query(LINES + " SELECT repo, file_id, CAST(line_no AS INTEGER) AS line_no, line FROM lines")
def lines_exploded(spark: SparkSession, d: str) -> DataFrame:
    return clones.numbered_lines(files(spark, d))


@query(NORM + " SELECT repo, file_id, CAST(line_no AS INTEGER) AS line_no, norm FROM norm")
def normalized_lines(spark: SparkSession, d: str) -> DataFrame:
    return clones.normalized_lines(files(spark, d)).select("repo", "file_id", F.explode("lines").alias("l")).select("repo", "file_id", "l.*")


@query(WINDOWS + " SELECT * FROM windows")
def clone_windows(spark: SparkSession, d: str) -> DataFrame:
    return clones.windows(files(spark, d))


@query(WINDOWS + """, seeds AS (SELECT a.repo, a.token_hash, a.file_id AS file_id_a, b.file_id AS file_id_b, a.start_line AS start_line_a, b.start_line AS start_line_b, a.pos AS at_a, b.pos - a.pos AS gap
  FROM windows a JOIN windows b ON a.repo = b.repo AND a.token_hash = b.token_hash AND a.file_id < b.file_id),
g AS (SELECT *, at_a - row_number() OVER (PARTITION BY repo, file_id_a, file_id_b, gap ORDER BY at_a) AS g FROM seeds)
SELECT repo, file_id_a, file_id_b, start_line_a, start_line_b, CAST(least(200, 6 + max(at_a) OVER (PARTITION BY repo, file_id_a, file_id_b, gap, g) - at_a) AS INTEGER) AS duplicated_lines, token_hash FROM g""")  # fmt: skip
def clone_pairs(spark: SparkSession, d: str) -> DataFrame:
    return clones.clone_pairs(files(spark, d))


#: Windows that always follow each other, by counts of neighbours: a row for each place of a class.
RUNS = WINDOWS + """, e AS (SELECT *, lag(token_hash) OVER (PARTITION BY repo, file_id ORDER BY pos) AS before FROM windows), n AS (SELECT repo, token_hash, count(*) AS n, count(DISTINCT file_id) AS files FROM windows GROUP BY ALL),
inner_ AS (SELECT e.repo, e.before, e.token_hash FROM e JOIN n x ON x.repo = e.repo AND x.token_hash = e.before JOIN n y ON y.repo = e.repo AND y.token_hash = e.token_hash GROUP BY ALL HAVING count(*) = any_value(x.n) AND count(*) = any_value(y.n)),
placed AS (SELECT e.*, sum(CASE WHEN i.before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY e.repo, e.file_id ORDER BY e.pos) AS run FROM e JOIN n ON n.repo = e.repo AND n.token_hash = e.token_hash AND n.files > 1
  LEFT JOIN inner_ i ON i.repo = e.repo AND i.before = e.before AND i.token_hash = e.token_hash),
runs AS (SELECT repo, arg_min(token_hash, pos) AS clone, file_id, min(pos) AS pos, min(start_line) AS start_line, max(end_line) AS end_line, count(*) + 5 AS lines FROM placed GROUP BY repo, file_id, run)"""


@query(RUNS + " SELECT * FROM runs")
def clone_members(spark: SparkSession, d: str) -> DataFrame:
    return clones.clone_runs(files(spark, d))


@query(RUNS + " SELECT repo, clone, any_value(lines) AS lines, count(*) AS places, count(DISTINCT file_id) AS files, min(file_id) AS first_file, arg_min(start_line, (file_id, start_line)) AS first_line FROM runs GROUP BY repo, clone")
def clone_classes(spark: SparkSession, d: str) -> DataFrame:
    return clones.clone_classes(clones.clone_runs(files(spark, d)))


@query(WINDOWS + " SELECT repo, token_hash, count(DISTINCT file_id) AS files, count(*) AS places FROM windows GROUP BY repo, token_hash HAVING count(DISTINCT file_id) > 1")
def clone_groups(spark: SparkSession, d: str) -> DataFrame:
    return clones.clone_groups(files(spark, d))


@query(WINDOWS + """, s AS (SELECT repo, token_hash FROM windows GROUP BY ALL HAVING count(DISTINCT file_id) > 1)
SELECT w.repo, file_id, count(*) AS windows, count(s.token_hash) AS shared FROM windows w LEFT JOIN s ON s.repo = w.repo AND s.token_hash = w.token_hash GROUP BY ALL""")
def duplicated_lines_by_file(spark: SparkSession, d: str) -> DataFrame:
    return clones.file_clones(files(spark, d))


@query(LINES + """, code AS (SELECT repo, file_id, line_no, stripped, row_number() OVER (PARTITION BY repo, file_id ORDER BY line_no) AS pos FROM lines WHERE stripped <> '' AND NOT (stripped[1:1] = '#' OR stripped[1:2] IN ('//', '--', '/*'))),
b AS (SELECT repo, file_id, line_no, md5(concat_ws('|', stripped, lead(stripped) OVER w, lead(stripped, 2) OVER w)) AS block, lead(line_no, 2) OVER w AS last FROM code WINDOW w AS (PARTITION BY repo, file_id ORDER BY pos)),
g AS (SELECT repo, file_id, min(line_no) AS line_no, count(*) AS n FROM b WHERE last IS NOT NULL AND (repo, file_id) IN (SELECT (repo, file_id) FROM split WHERE len(ls) >= 6) GROUP BY repo, file_id, block HAVING count(*) > 1)
SELECT repo, file_id, CAST(line_no AS INTEGER) AS line_no, n, CAST(row_number() OVER (PARTITION BY repo, file_id ORDER BY line_no) AS INTEGER) AS place FROM g QUALIFY place <= 3""")  # fmt: skip
def duplicate_blocks_in_file(spark: SparkSession, d: str) -> DataFrame:
    return clones.repeated_blocks(files(spark, d))


@query(LINES + """, n AS (SELECT repo, file_id, len(ls) AS n, greatest(1, (len(ls) + 399) // 400) AS total FROM split)
SELECT repo, file_id, CAST(k AS INTEGER) AS chunk, CAST(total AS INTEGER) AS total, CAST(400 * k - 399 AS INTEGER) AS start_line, CAST(greatest(400 * k - 399, least(400 * k, n)) AS INTEGER) AS end_line, CAST(400 * k - 399 + 20 - 1 AS INTEGER) AS line_of_20
FROM (SELECT *, unnest(range(1, total + 1)) AS k FROM n)""")  # fmt: skip
def chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 400 lines with their place in the file, and the file's line for line 20 of each."""
    n = files(spark, d).select("repo", "file_id", F.size(text.split_lines(F.col("content"))).alias("n")).withColumn("total", F.greatest(F.lit(1), F.ceil(F.col("n") / 400)).cast("int"))
    k = F.col("chunk")
    rows = n.withColumn("chunk", F.explode(F.sequence(F.lit(1), F.col("total"))))
    start = 400 * k - 399
    return rows.select("repo", "file_id", "chunk", "total", start.alias("start_line"), F.greatest(start, F.least(400 * k, F.col("n"))).alias("end_line"), (start + 20 - 1).alias("line_of_20"))


def paths(spark: SparkSession, d: str) -> DataFrame:
    """Parts as paths of repository files: directory by size, name by part, extension by brand."""
    dirs = ["src/app", "tests", "node_modules/x", "docs", ".github/workflows", "src/build", "lib/vendor", "app/services", "test/unit", "pkg/out"]
    exts = [".py", ".js", ".min.js", ".ts", ".java", ".md", ".json", ".png", ".go", ".yaml", ".map", ".rs", ""]
    pick = lambda xs, c: F.get(F.array(*map(F.lit, xs)), (c % len(xs)).cast("int"))
    key = F.col("p_partkey")
    return table(spark, d, "part").select(key.alias("file_id"), F.concat(pick(dirs, F.col("p_size")), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.when(key % 7 == 0, "_spec").otherwise(""), F.when(key % 11 == 0, "_generated").otherwise(""), key.cast("string"), pick(exts, key)).alias("path"))


PATHS = r""", paths AS (SELECT p_partkey AS file_id, (['src/app', 'tests', 'node_modules/x', 'docs', '.github/workflows', 'src/build', 'lib/vendor', 'app/services', 'test/unit', 'pkg/out'])[p_size % 10 + 1] || '/' || replace(p_name, ' ', '_')
  || CASE WHEN p_partkey % 7 = 0 THEN '_spec' ELSE '' END || CASE WHEN p_partkey % 11 = 0 THEN '_generated' ELSE '' END || p_partkey || (['.py', '.js', '.min.js', '.ts', '.java', '.md', '.json', '.png', '.go', '.yaml', '.map', '.rs', ''])[p_partkey % 13 + 1] AS path FROM part),
named AS (SELECT *, lower(parse_filename(path, false, '/')) AS name, lower(regexp_extract(parse_filename(path, false, '/'), '(\.[^.]*)$', 1)) AS ext FROM paths),
typed AS (SELECT *, CASE WHEN ext IN ('.py', '.js', '.ts', '.java', '.go', '.rs') THEN 'source' WHEN ext IN ('.json', '.yaml') THEN 'config' WHEN ext = '.md' THEN 'doc' ELSE 'other' END AS type FROM named),
seen AS (SELECT *, type IN ('source', 'other') AND (contains(name, 'test') OR contains(name, 'spec') OR starts_with(path, 'tests/') OR starts_with(path, 'test/')) AS is_test,
  regexp_matches(lower(path), 'node_modules|dist|build|\.git|coverage|package-lock\.json|yarn\.lock|pnpm-lock\.yaml') OR contains(name, '.min.') OR contains(name, 'generated') OR contains(name, 'webpack') OR ends_with(name, '.map') OR ext = '.png' AS skip,
  regexp_matches(path, '(^|/)(node_modules|dist|build|vendor|out|\.[^/]*)/') AS excluded FROM typed)"""


@query(PATHS + """ SELECT file_id, path, type, is_test, CASE type WHEN 'config' THEN 'Config' WHEN 'doc' THEN 'Documentation' WHEN 'other' THEN 'Other' ELSE CASE ext WHEN '.py' THEN 'Python' WHEN '.js' THEN 'JavaScript' WHEN '.ts' THEN 'TypeScript' WHEN '.java' THEN 'Java' WHEN '.go' THEN 'Go' ELSE 'Rust' END END AS language,
CASE WHEN excluded THEN 'excluded: directory' WHEN skip THEN 'excluded: generated or binary' WHEN type = 'source' AND NOT is_test THEN 'to_analyze' ELSE 'inventoried' END AS status FROM seen""")  # fmt: skip
def inventory_classify(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return paths(spark, d).select("file_id", "path", inventory.file_type(p).alias("type"), inventory.is_test(p).alias("is_test"), inventory.language(p).alias("language"), inventory.status(p).alias("status"))


@query(PATHS + " SELECT split_part(path, '/', 1) AS component, CASE WHEN contains(path, '/') THEN count(*) ELSE 0 END AS files, count(*) FILTER (type = 'source') AS sources, count(*) FILTER (is_test) AS tests FROM seen GROUP BY 1, contains(path, '/')")
def components(spark: SparkSession, d: str) -> DataFrame:
    """Files by top-level directory."""
    p = F.col("path")
    return paths(spark, d).groupBy(F.substring_index(p, "/", 1).alias("component")).agg(F.count(F.lit(1)).alias("files"), F.count_if(inventory.file_type(p) == "source").alias("sources"), F.count_if(inventory.is_test(p)).alias("tests"))


@query(PATHS + """, node AS (SELECT path, array_to_string(parts[:i], '/') AS node, i AS depth, i < len(parts) AS is_dir FROM (SELECT path, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT path, string_split(path, '/') AS parts FROM paths)))
SELECT node, CAST(depth AS INTEGER) AS depth, is_dir, count(*) AS files FROM node WHERE is_dir GROUP BY ALL""")
def explorer_tree(spark: SparkSession, d: str) -> DataFrame:
    """Directories of all paths, with the files below them."""
    parts = F.split("path", "/")
    nodes = paths(spark, d).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("node"), i.alias("depth")))).alias("n"))
    return nodes.groupBy("n.node", "n.depth").agg(F.count(F.lit(1)).alias("files")).select("node", "depth", F.lit(True).alias("is_dir"), "files")


@query(PATHS + """, st AS (SELECT *, regexp_replace(parse_filename(path, false, '/'), '\\.[^.]*$', '') AS stem FROM seen WHERE NOT skip)
SELECT path FROM st s WHERE type = 'source' AND NOT is_test AND NOT EXISTS (SELECT 1 FROM st t WHERE t.is_test AND (contains(t.stem, s.stem) OR contains(s.stem, t.stem)))""")  # fmt: skip
def missing_tests(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose stem contains no test's and is in none."""
    return tree.untested_sources(paths(spark, d).withColumn("repo", F.lit(0))).select("path")


@query(""", h AS (SELECT sha256(content) AS content_hash, repo, file_id, octet_length(encode(content)) AS size FROM files) SELECT content_hash, count(*) AS files, count(DISTINCT repo) AS repos, min(file_id) AS first_id, max(size) AS size FROM h GROUP BY 1""")
def content_hash_reuse(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).groupBy(F.sha2("content", 256).alias("content_hash")).agg(F.count(F.lit(1)).alias("files"), F.count_distinct("repo").alias("repos"), F.min("file_id").alias("first_id"), F.max(F.octet_length("content")).cast("long").alias("size"))


@query(" SELECT repo, count(*) AS files, CAST(sum(length(content)) AS BIGINT) AS chars, CAST(sum(length(content) // 4) AS BIGINT) AS tokens FROM files GROUP BY repo")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return files(spark, d).groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum(F.length(c)).alias("chars"), F.sum(text.token_estimate(c)).alias("tokens"))


@query(LINES + r""", n AS (SELECT *, length(line) - length(ltrim(line, ' ' || chr(9))) AS indent FROM lines WHERE stripped <> ''), depth AS (SELECT repo, file_id, line_no, CASE WHEN indent >= 4 THEN indent // 4 WHEN contains(line[:indent], chr(9)) THEN indent ELSE 0 END AS depth FROM n)
SELECT repo, file_id, CAST(max(depth) AS INTEGER) AS depth, CAST(arg_min(line_no, (-depth, line_no)) AS INTEGER) AS first_line, count(*) AS code_lines FROM depth GROUP BY ALL""")
def nesting_by_file(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("line")
    indent = text.indent_of(line)
    depth = F.when(indent >= 4, F.floor(indent / 4)).when(F.substring(line, F.lit(1), indent).contains("\t"), indent).otherwise(0)
    rows = clones.numbered_lines(files(spark, d)).where(text.strip(line) != "")
    return rows.groupBy("repo", "file_id").agg(F.max(depth).cast("int").alias("depth"), F.min(F.struct((-depth).alias("back"), "line_no"))["line_no"].alias("first_line"), F.count(F.lit(1)).alias("code_lines"))


@query(LINES + r""", m AS (SELECT repo, file_id, line_no, regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(stripped, '"[^"]*"', '""', 'g'), '''[^'']*''', '''''', 'g'), '#[^#]*$', ''), '(?:^|[^A-Za-z_])(\d+\.?\d*)', 1) AS nums FROM lines WHERE NOT (stripped[1:1] IN ('#', '*') OR stripped[1:2] IN ('//', '--', '/*')))
SELECT repo, count(*) AS lines, count(*) FILTER (len(nums) > 0) AS with_numbers FROM m GROUP BY repo""")
def numeric_literal_lines(spark: SparkSession, d: str) -> DataFrame:
    """Code lines of a repository, and those with a numeric literal outside strings."""
    s = text.strip(F.col("line"))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r'"[^"]*"', '""'), "'[^']*'", "''"), r"#[^#]*$", "")
    rows = clones.numbered_lines(files(spark, d)).where(~text.is_comment(s, ("#", "//", "--", "*", "/*")))
    return rows.groupBy("repo").agg(F.count(F.lit(1)).alias("lines"), F.count_if(bare.rlike(r"(^|[^A-Za-z_])\d+\.?\d*")).alias("with_numbers"))


@query(LINES + r""" SELECT repo, file_id, CAST(line_no AS INTEGER) AS line_no, regexp_replace(regexp_extract(line, '[Tt]oken = "([0-9a-f]{40})"', 1), '^(.{4}).*$', '\1***') AS masked FROM lines WHERE regexp_matches(line, '[Tt]oken = "[0-9a-f]{40}"')""")
def bare_token_secrets(spark: SparkSession, d: str) -> DataFrame:
    """Extension of the secret rules: forty hexadecimal digits given to a bare ``token``; the value is masked."""
    line = F.col("line")
    hits = clones.numbered_lines(files(spark, d)).where(line.rlike(r'[Tt]oken = "[0-9a-f]{40}"'))
    return hits.select("repo", "file_id", "line_no", F.regexp_replace(F.regexp_extract(line, r'[Tt]oken = "([0-9a-f]{40})"', 1), r"^(.{4}).*$", "$1***").alias("masked"))


def versions(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    part = lambda n, m: (F.floor(key / n) % m).cast("string")
    return table(spark, d, "part").select(key.alias("id"), F.concat(F.when(key % 3 == 0, "^").otherwise(""), part(1, 7), F.lit("."), part(7, 13), F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("."), part(3, 9)))).alias("spec"))


@query(r""", s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '^' ELSE '' END || (p_partkey % 7) || '.' || (p_partkey // 7 % 13) || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '.' || (p_partkey // 3 % 9) END AS spec FROM part),
v AS (SELECT id, spec, CAST(regexp_extract(spec, '(\d+)', 1) AS INTEGER) AS a, CAST(regexp_extract(spec, '\d+\.(\d+)', 1) AS INTEGER) AS b, coalesce(TRY_CAST(regexp_extract(spec, '\d+\.\d+\.(\d+)', 1) AS INTEGER), 0) AS c FROM s)
SELECT id, spec, a || '.' || b || '.' || c AS version, (a, b, c) < (3, 4, 0) AS below_3_4, (a, b, c) >= (2, 0, 0) AS from_2, false AS odd FROM v""")  # fmt: skip
def version_in_range(spark: SparkSession, d: str) -> DataFrame:
    rows = versions(spark, d).withColumn("v", text.version_triple(F.col("spec")))
    v = F.col("v")
    return rows.select("id", "spec", F.concat_ws(".", *[F.col(f"v.{x}").cast("string") for x in ("major", "minor", "patch")]).alias("version"), text.version_in_range(v, F.lit("<3.4")).alias("below_3_4"), text.version_in_range(v, F.lit(">=2")).alias("from_2"), text.version_in_range(v, F.lit("<1.3.0b3")).alias("odd"))


@query(r""", s AS (SELECT event_id, 'Authorization: Bearer ' || md5(CAST(event_id AS VARCHAR)) || ' ' || props || ' bearer abc' || event_id || ' gsk_' || md5(CAST(user_id AS VARCHAR)) AS msg FROM events)
SELECT event_id, regexp_replace(regexp_replace(regexp_replace(msg, 'gsk_[a-zA-Z0-9_]{30,200}', 'gsk_***[MASKED]***', 'g'), 'Authorization:\s*Bearer\s+[a-zA-Z0-9_\-.~]+', 'Authorization: Bearer ***[MASKED]***', 'gi'), 'Bearer\s+[a-zA-Z0-9_\-.~]+', 'Bearer ***[MASKED]***', 'gi') AS masked FROM s""")  # fmt: skip
def secret_masking(spark: SparkSession, d: str) -> DataFrame:
    digest = lambda c: F.md5(F.col(c).cast("string").cast("binary"))
    message = F.concat(F.lit("Authorization: Bearer "), digest("event_id"), F.lit(" "), F.col("props"), F.lit(" bearer abc"), F.col("event_id").cast("string"), F.lit(" gsk_"), digest("user_id"))
    return table(spark, d, "events").select("event_id", text.mask_secrets(message).alias("masked"))
