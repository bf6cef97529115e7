"""What collecting from services leaves behind: stored answers, what is still to be asked, files by their names and signatures.

The calls themselves are not made here; their answers are rows of a landing table (key, asked_at, status, body).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The first bytes of workbooks, old and new.
WORKBOOK_MAGIC = ("D0CF11E0", "504B0304")


def is_good(status: Column, body: Column) -> Column:
    """An answer that counts: 200, not empty, and not an error that is told in a remark."""
    remark = F.coalesce(F.get_json_object(body, "$.remark"), F.lit(""))
    return F.coalesce((status == 200) & (F.trim(body) != "") & ~F.lower(remark).contains("error"), F.lit(False))


def newest_answers(answers: DataFrame) -> DataFrame:
    """(key, asked_at, body): of each key the newest answer that counts."""
    good = answers.where(is_good(F.col("status"), F.col("body")))
    return good.groupBy("key").agg(F.max(F.struct("asked_at", "body")).alias("m")).select("key", "m.asked_at", "m.body")


def still_to_ask(wanted: DataFrame, answers: DataFrame, fresh_since: str | None = None) -> DataFrame:
    """Wanted rows (key, ...) without an answer that counts, or, with `fresh_since`, without one that new."""
    have = newest_answers(answers)
    if fresh_since is not None:
        have = have.where(F.col("asked_at") >= F.lit(fresh_since).cast("timestamp"))
    return wanted.join(have.select("key"), "key", "left_anti")


def within_quota(todo: DataFrame, answers: DataFrame, today: str, quota: int, order: list[str]) -> DataFrame:
    """The first rows of `todo`, in order, that a daily quota still allows after all calls of the day, failed ones too."""
    spent = answers.where(F.col("asked_at").cast("date") == F.lit(today).cast("date")).agg(F.count(F.lit(1)).alias("spent"))
    first = todo.orderBy(*order).limit(quota)
    numbered = first.withColumn("turn", F.row_number().over(W.orderBy(*order)))  # a day's quota of rows
    return numbered.crossJoin(F.broadcast(spent)).where(F.col("turn") <= quota - F.col("spent")).drop("turn", "spent")


def pairs_to_ask(ids: DataFrame, answers: DataFrame, symmetric: bool) -> DataFrame:
    """(key, a, b) of pairs of ids that have no answer: one direction where the service is symmetric, else both. The key is
    'a|b'; a symmetric answer counts for both directions. ids are one campus's buildings."""
    pairs = ids.select(F.col("id").alias("a")).join(ids.select(F.col("id").alias("b")), F.col("a") < F.col("b") if symmetric else F.col("a") != F.col("b"))
    keyed = pairs.select(F.concat_ws("|", "a", "b").alias("key"), "a", "b")
    out = still_to_ask(keyed, answers)
    if symmetric:
        back = newest_answers(answers).select("key")
        out = out.join(back, F.concat_ws("|", out["b"], out["a"]) == back["key"], "left_anti")
    return out


def next_server(servers: list[str], failures: Column, first_wait: float = 5.0, most: float = 120.0) -> Column:
    """struct<server, wait_s>: which server to ask after so many failures in a row, and how long to wait before: servers
    take turns, and each full round doubles the wait."""
    n = len(servers)
    rounds = F.floor(failures / n)
    wait = F.when(failures == 0, F.lit(0.0)).otherwise(F.least(F.lit(most), F.lit(first_wait) * F.pow(F.lit(2.0), rounds)))
    return F.struct(F.element_at(F.array(*map(F.lit, servers)), (failures % n + 1).cast("int")).alias("server"), wait.alias("wait_s"))


def workbooks(spark: SparkSession, folder: str) -> DataFrame:
    """(path, ok): files of a folder, and whether their first bytes are a workbook's (an error page is not); empty files don't appear."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select("path", F.hex(F.substring("content", 1, 4)).isin(*WORKBOOK_MAGIC).alias("ok"))


def html_rows(body: Column) -> Column:
    """array<array<string>>: the cells of all table rows of a page, without tags and with single spaces."""
    rows = F.regexp_extract_all(body, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)))
    clean = lambda c: F.trim(F.regexp_replace(F.replace(F.regexp_replace(c, "(?s)<[^>]*>", " "), F.lit("&nbsp;"), F.lit(" ")), r"\s+", " "))
    return F.transform(cells, lambda r: F.transform(r, clean))


#: Codes of a topographic map's layers in file names, and where its sheets' numbers begin and end.
LAYER_CODES = {"F0010000": "contour", "F0020000": "spot", "B0010000": "building"}
SHEET = r"(?<!\d)(3[3-8]\d{6,8})(?!\d)"


def map_file(name: Column) -> Column:
    """struct<layer, sheet, scale> of a map file's path: the layer by its code, the last sheet number in it, and the scale
    by how long that is: 8 digits 1:5,000, more 1:1,000; nulls for what the path doesn't say."""
    layer = F.lit(None).cast("string")
    for code, kind in LAYER_CODES.items():
        layer = F.when(F.contains(F.upper(name), F.lit(code)), kind).otherwise(layer)
    sheets = F.regexp_extract_all(name, F.lit(SHEET), F.lit(1))
    sheet = F.get(sheets, F.size(sheets) - 1)
    scale = F.when(F.length(sheet) >= 9, 1000).when(F.length(sheet) == 8, 5000)
    return F.struct(layer.alias("layer"), sheet.alias("sheet"), scale.alias("scale"))


def scale_by_extent(width: Column, height: Column, small: float = 1200.0) -> Column:
    """The scale of a sheet without a number: 1:1,000 where it spans less than `small` metres either way, else 1:5,000."""
    return F.when(F.greatest(width, height) < small, 1000).otherwise(5000)


def stamped(text: Column, version: Column, names: list[str]) -> Column:
    """A page whose references to the named assets carry ?v=version, in place of any version they had."""
    out = text
    for name in names:
        plain = name.replace(".", r"\.")
        out = F.regexp_replace(out, F.lit(rf"(?<=[\"'/]){plain}(?:\?v=[0-9a-f]+)?(?=[\"'])"), F.concat(F.lit(f"{name}?v="), version))
    return out


def assets_version(contents: Column, digits: int = 8) -> Column:
    """The version of assets (array<string>, in order): a hash of their contents without the versions in them."""
    return F.substring(F.sha2(F.array_join(F.transform(contents, lambda c: F.regexp_replace(c, r"\?v=[0-9a-f]+", "")), "").cast("binary"), 256), 1, digits)


def markdown_rows(rows: DataFrame, columns: dict[str, str], order: list[str]) -> DataFrame:
    """(line, text): a report's table as Markdown, heads first; columns: name -> head. Reports are short."""
    heads = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(columns.values()) + " |"), (1, "|" + " --- |" * len(columns))], "line long, text string")
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in columns]
    body = rows.select((F.row_number().over(W.orderBy(*order)) + 1).cast("long").alias("line"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("text"))
    return heads.unionByName(body)
