"""Clone detection over lines: windows of normalised lines, and matches that run on from them.

A window that many files share would make pairs with the square of its files. ``clone_pairs`` is the report of the pairs
as such; ``clone_runs`` has one row for each place of a class of clones, ``clone_groups`` one for each shared window with
its files counted, and ``file_clones`` one for each file, so these grow with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.functions import text

MIN_LINES, LONGEST = 6, 200


def once(array: Column) -> Column:
    """An array that later projections read instead of computing it anew in each use: a generator of one row."""
    return F.explode(F.array(array))


def numbered_lines(files: DataFrame) -> DataFrame:
    """repo, file_id, line_no, line of all files."""
    return files.select("repo", "file_id", F.posexplode(text.split_lines(F.col("content"))).alias("at", "line")).select("repo", "file_id", (F.col("at") + 1).alias("line_no"), "line")


def normalized_lines(files: DataFrame) -> DataFrame:
    """repo, file_id, lines: array of (line_no, norm) of the lines that normalise to something."""
    lines = F.transform(text.split_lines(F.col("content")), lambda x, i: F.struct((i + 1).alias("line_no"), text.normalize_line(x).alias("norm")))
    return files.select("repo", "file_id", once(F.filter(lines, lambda x: x["norm"] != "")).alias("lines"))


def windows(files: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """repo, file_id, pos (place among the file's normalised lines), start_line, end_line, token_hash."""
    own = normalized_lines(files).where(F.size("lines") >= min_lines)
    starts = F.sequence(F.lit(1), F.size("lines") - (min_lines - 1))
    block = lambda i: F.slice("lines", i, min_lines)
    made = F.transform(
        starts,
        lambda i: F.struct((i - 1).alias("pos"), F.get("lines", i - 1)["line_no"].alias("start_line"), F.get("lines", i + (min_lines - 2))["line_no"].alias("end_line"), F.sha1(F.array_join(F.transform(block(i), lambda x: x["norm"]), "\n").cast("binary")).alias("token_hash")),
    )
    return own.select("repo", "file_id", F.explode(made).alias("w")).select("repo", "file_id", "w.*")


def shared_windows(files: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Windows whose hash stands in at least two files of the repository. The filter is an aggregate of one row for each
    hash, combined before the shuffle."""
    made = windows(files, min_lines)
    shared = made.groupBy("repo", "token_hash").agg(F.min("file_id").alias("low"), F.max("file_id").alias("high")).where(F.col("low") < F.col("high")).select("repo", "token_hash")
    return made.join(shared, ["repo", "token_hash"])


def clone_pairs(files: DataFrame, min_lines: int = MIN_LINES, longest: int = LONGEST) -> DataFrame:
    """All pairs of equal windows in different files, each with the length that the match runs on to.

    Equal windows at equal distance continue each other: the length comes from the run that a seed stands in."""
    shared = shared_windows(files, min_lines)
    a = shared.select("repo", "token_hash", *[F.col(c).alias(f"{c}_a") for c in ("file_id", "pos", "start_line")])
    b = shared.select("repo", "token_hash", *[F.col(c).alias(f"{c}_b") for c in ("file_id", "pos", "start_line")])
    seeds = a.join(b, ["repo", "token_hash"]).where(F.col("file_id_a") < F.col("file_id_b"))
    line = Window.partitionBy("repo", "file_id_a", "file_id_b", F.col("pos_b") - F.col("pos_a")).orderBy("pos_a")
    island = seeds.withColumn("island", F.col("pos_a") - F.row_number().over(line)).withColumn("offset", F.col("pos_b") - F.col("pos_a"))
    last = F.max("pos_a").over(Window.partitionBy("repo", "file_id_a", "file_id_b", "offset", "island"))
    return island.withColumn("duplicated_lines", F.least(F.lit(longest), min_lines + last - F.col("pos_a")).cast("int")).select("repo", "file_id_a", "file_id_b", "start_line_a", "start_line_b", "duplicated_lines", "token_hash")


def similarity_pct(a: Column, b: Column) -> Column:
    """Whole per cent of places where two arrays of lines agree, of the longer one's; halves go to the even number."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)).cast("int")), F.lit(0), lambda n, x: n + x)
    return F.bround(100 * same / F.greatest(F.size(a), F.size(b), F.lit(1)), 0).cast("int")


def clone_report(files: DataFrame, least_similarity: int = 50, most: int = 60, shown: int = 12, min_lines: int = MIN_LINES) -> DataFrame:
    """The longest clones of each repository by path and line range, with their first lines and the counts of all.

    Seeds are equal windows, so every clone is similar by 100; the filter is what a caller may ask for. ``most`` is the
    report's length."""
    pairs = clone_pairs(files, min_lines).withColumn("similarity", F.lit(100)).where(F.col("similarity") >= least_similarity)
    whole = Window.partitionBy("repo")
    ranked = pairs.withColumn("total", F.count(F.lit(1)).over(whole)).withColumn("total_lines", F.sum("duplicated_lines").over(whole))
    order = whole.orderBy(F.desc("duplicated_lines"), F.desc("similarity"), "file_id_a", "start_line_a", "file_id_b", "start_line_b")
    kept = ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    named = normalized_lines(files).join(files.select("repo", "file_id", "path"), ["repo", "file_id"])
    a = named.select("repo", F.col("file_id").alias("file_id_a"), F.col("path").alias("path_a"), "lines")
    b = files.select("repo", F.col("file_id").alias("file_id_b"), F.col("path").alias("path_b"))
    joined = kept.join(a, ["repo", "file_id_a"]).join(b, ["repo", "file_id_b"])
    own = F.slice(F.filter("lines", lambda x: x["line_no"] >= F.col("start_line_a")), 1, F.col("duplicated_lines"))
    snippet = F.array_join(F.transform(F.slice(own, 1, shown), lambda x: x["norm"]), "\n")
    return joined.select("repo", "place", "path_a", "path_b", "start_line_a", F.element_at(own, -1)["line_no"].alias("end_line_a"), "start_line_b", "duplicated_lines", "similarity", "token_hash", snippet.alias("snippet"), "total", "total_lines")


def clone_runs(files: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """repo, clone, file_id, pos, start_line, end_line, lines: where each class of clones stands.

    A class is a longest run of windows that different files share and that always follow each other: wherever one of
    them stands, the whole run does. ``clone`` is the hash of its first window, ``lines`` its normalised lines. A place
    is one row, so n copies of a file give n rows for each run, not one for each pair. Hot windows are counted before
    the shuffle; whether a window always follows another is known from the least and greatest of its neighbours."""
    own = Window.partitionBy("repo", "file_id").orderBy("pos")
    before, after = F.lag("token_hash").over(own).alias("before"), F.lead("token_hash").over(own).alias("after")
    made = windows(files, min_lines).select("*", before, after)
    ends = [f(c).alias(f"{c}_{name}") for c in ("before", "after") for name, f in (("low", F.min), ("high", F.max), ("n", F.count))]
    known = made.groupBy("repo", "token_hash").agg(F.min("file_id").alias("low"), F.max("file_id").alias("high"), F.count(F.lit(1)).alias("n"), *ends)
    shared = known.where(F.col("low") < F.col("high"))
    always = lambda c: F.when((F.col(f"{c}_low") == F.col(f"{c}_high")) & (F.col(f"{c}_n") == F.col("n")), F.col(f"{c}_low"))
    followed = shared.select("repo", F.col("token_hash").alias("before"), always("after").alias("token_hash")).where(F.col("token_hash").isNotNull())
    inner = shared.select("repo", "token_hash", always("before").alias("before")).join(followed, ["repo", "token_hash", "before"])
    marks = shared.select("repo", "token_hash").join(inner.select("repo", "token_hash", F.lit(False).alias("first")), ["repo", "token_hash"], "left")
    placed = made.select("repo", "file_id", "pos", "start_line", "end_line", "token_hash").join(marks, ["repo", "token_hash"])
    run = placed.withColumn("run", F.count(F.when(F.coalesce("first", F.lit(True)), 1)).over(own))
    place = F.struct("pos", "start_line", "token_hash")
    runs = run.groupBy("repo", "file_id", "run").agg(F.min(place).alias("p"), F.max("end_line").alias("end_line"), (F.count(F.lit(1)) + (min_lines - 1)).alias("lines"))
    return runs.select("repo", F.col("p.token_hash").alias("clone"), "file_id", F.col("p.pos").alias("pos"), F.col("p.start_line").alias("start_line"), "end_line", "lines")


def clone_classes(runs: DataFrame) -> DataFrame:
    """repo, clone, lines, places, files, first_file, first_line of each class of ``clone_runs``; its first place stands for it."""
    first = F.min(F.struct("file_id", "start_line")).alias("p")
    made = runs.groupBy("repo", "clone").agg(F.first("lines").alias("lines"), F.count(F.lit(1)).alias("places"), F.count_distinct("file_id").alias("files"), first)
    return made.select("repo", "clone", "lines", "places", "files", F.col("p.file_id").alias("first_file"), F.col("p.start_line").alias("first_line"))


def clone_groups(files: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """repo, token_hash, files, places: one row for each window that different files share."""
    return windows(files, min_lines).groupBy("repo", "token_hash").agg(F.count_distinct("file_id").alias("files"), F.count(F.lit(1)).alias("places")).where(F.col("files") > 1)


def file_clones(files: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """repo, file_id, windows, shared: how many windows of a file stand in another file too."""
    made = windows(files, min_lines)
    df = made.groupBy("repo", "token_hash").agg(F.min("file_id").alias("low"), F.max("file_id").alias("high")).where(F.col("low") < F.col("high"))
    marked = made.join(df, ["repo", "token_hash"], "left")
    return marked.groupBy("repo", "file_id").agg(F.count(F.lit(1)).alias("windows"), F.count("low").alias("shared"))


def blocks_of(lines: Column, size: int = 3, cap: int = 3) -> Column:
    """Array of (line_no, n) of the first ``cap`` blocks of code lines that a text repeats; ``lines`` is its ``text.lined``."""
    none = F.array().cast("array<struct<line_no:int,n:int>>")

    def runs(made: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(made) - 1), lambda i: (i == 0) | (F.get(made, i)["block"] != F.get(made, i - 1)["block"]))
        counted = text.let(starts, lambda s: F.transform(s, lambda p, j: F.struct(F.get(made, p)["line_no"].alias("line_no"), (F.coalesce(F.get(s, j + 1), F.size(made)) - p).alias("n"))))
        return F.slice(F.sort_array(F.filter(counted, lambda x: x["n"] > 1)), 1, cap)

    def repeated(kept: Column) -> Column:
        block = lambda i: F.md5(F.array_join(F.transform(F.slice(kept, i, size), lambda x: x["s"]), "|").cast("binary"))
        made = F.transform(F.sequence(F.lit(1), F.size(kept) - (size - 1)), lambda i: F.struct(block(i).alias("block"), F.get(kept, i - 1)["no"].alias("line_no")))
        some_again = F.size(F.array_distinct(F.transform(kept, lambda x: x["s"]))) < F.size(kept)
        return F.when((F.size(kept) >= size) & some_again, text.let(F.sort_array(made), runs)).otherwise(none)

    code = F.filter(lines, lambda x: (x["s"] != "") & ~text.is_comment(x["s"], ("#", "//", "--", "/*")))
    return F.when(F.size(lines) >= 6, text.let(code, repeated)).otherwise(none)


def repeated_blocks(files: DataFrame, size: int = 3, cap: int = 3) -> DataFrame:
    """Blocks of a file's code lines that it repeats: the first ``cap`` of each file, with their first line and count."""
    own = files.select("repo", "file_id", once(text.lined(F.col("content"))).alias("lines")).select("repo", "file_id", once(blocks_of(F.col("lines"), size, cap)).alias("blocks"))
    return own.select("repo", "file_id", F.posexplode("blocks").alias("at", "b")).select("repo", "file_id", "b.line_no", F.col("b.n").cast("long").alias("n"), (F.col("at") + 1).alias("place"))
