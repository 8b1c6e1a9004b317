"""Validation, quality and presentation (W4)."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as X

#: fixed values: bounds of images that vision models take, in bytes and pixels
MIN_BYTES, MAX_BYTES, MIN_PIXELS, MAX_PIXELS, GOOD_PIXELS = 10 * 1024, 20 * 1024 * 1024, 100, 8192, 4096
#: fixed values: keys that front matter may have; what packages leave out
ALLOWED_KEYS = ("name", "description", "license", "allowed-tools", "metadata", "compatibility")
PACKAGE_DIRS, PACKAGE_ROOT_DIRS, PACKAGE_FILES = ("__pycache__", "node_modules"), ("evals",), (".DS_Store",)
#: fixed values: extensions shown as text and as images, and media types that go before the common table
TEXTS = (".txt", ".md", ".json", ".csv", ".py", ".js", ".ts", ".tsx", ".jsx", ".yaml", ".yml", ".xml", ".html", ".css", ".sh", ".rb", ".go", ".rs", ".java", ".c", ".cpp", ".h", ".hpp", ".sql", ".r", ".toml")
IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp")
MEDIA = {
    ".svg": "image/svg+xml", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}


def image_issues(size: Column, width: Column, height: Column) -> Column:
    """PRJ16: what makes an image unsuitable."""
    low, high = F.least(width, height), F.greatest(width, height)
    return F.array_compact(F.array(F.when(size < MIN_BYTES, "too_small"), F.when(size > MAX_BYTES, "too_large"), F.when(low < MIN_PIXELS, "dimensions_small"), F.when(high > MAX_PIXELS, "dimensions_large")))


def image_warnings(width: Column, height: Column) -> Column:
    """PRJ16: kept apart from the issues."""
    return F.array_compact(F.array(F.when(F.greatest(width, height) > GOOD_PIXELS, "may_be_downscaled")))


def image_header(content: Column) -> Column:
    """UDF11: struct(readable, width, height) of PNG and GIF files from their first bytes; other contents aren't readable here."""
    head = F.hex(F.substring(content, 1, 24))
    number = lambda digits: F.conv(digits, 16, 10).cast("long")
    little = lambda at: number(F.concat(F.substring(head, at + 2, 2), F.substring(head, at, 2)))
    png = (F.length(head) == 48) & F.startswith(head, F.lit("89504E470D0A1A0A")) & (F.substring(head, 25, 8) == "49484452")
    gif = (F.length(head) >= 20) & F.startswith(head, F.lit("474946383")) & F.substring(head, 10, 3).isin("761", "961")
    size = F.when(png, F.struct(number(F.substring(head, 33, 8)).alias("width"), number(F.substring(head, 41, 8)).alias("height"))).when(gif, F.struct(little(13).alias("width"), little(17).alias("height")))
    return F.struct(F.coalesce(png | gif, F.lit(False)).alias("readable"), size["width"].alias("width"), size["height"].alias("height"))


def verify_images(images: DataFrame) -> DataFrame:
    """PRJ16, UDF11: adds issues, warnings, suitable. An unreadable image is unsuitable whatever its size."""
    rows = images.withColumn("issues", image_issues(F.col("size_bytes"), F.col("width"), F.col("height"))).withColumn("warnings", image_warnings(F.col("width"), F.col("height")))
    return rows.withColumn("suitable", (F.size("issues") == 0) & F.coalesce("readable", F.lit(False)))


def image_summary(checked: DataFrame, *by: str) -> DataFrame:
    """AGG10, AGG11, SNK05: total, suitable, issues, success percent (0 of none), by document where asked."""
    g = checked.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("suitable").alias("suitable"), F.count_if(~F.col("suitable")).alias("issues"))
    return g.withColumn("success", F.when(F.col("total") > 0, 100.0 * F.col("suitable") / F.col("total")).otherwise(0.0))


def image_document(path: Column) -> Column:
    """AGG11: the directory above the image's."""
    return F.get(F.split(path, "/"), F.size(F.split(path, "/")) - 3)


def first_error(*rules: tuple[Column, str], ok: str = "valid") -> Column:
    """PRJ17: the message of the first rule that is broken."""
    out = F.lit(ok)
    for broken, message in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), message).otherwise(out)
    return out


def frontmatter_error(matter: Column) -> Column:
    """PRJ17, STR17: first broken rule of a map of keys to text, or valid."""
    get = lambda k: X.strip(F.coalesce(F.try_element_at(matter, F.lit(k)), F.lit("")))
    has = lambda k: F.map_contains_key(matter, k)
    name, text, compat = get("name"), get("description"), get("compatibility")
    return first_error(
        (matter.isNull(), "no_frontmatter"),
        (F.size(F.array_except(F.map_keys(matter), F.array(*[F.lit(k) for k in ALLOWED_KEYS]))) > 0, "unexpected_keys"),
        (~has("name"), "missing_name"),
        (~has("description"), "missing_description"),
        ((name != "") & ~name.rlike("^[a-z0-9-]+$"), "name_not_kebab"),
        (name.rlike("^-|-$|--"), "name_hyphens"),
        (F.length(name) > 64, "name_too_long"),
        (text.rlike("[<>]"), "description_brackets"),
        (F.length(text) > 1024, "description_too_long"),
        (F.length(compat) > 500, "compatibility_too_long"),
    )


def left_out_of_package(path: Column) -> Column:
    """PRJ18: path is relative to the directory that holds the package's."""
    parts = F.split(path, "/")
    any_ = lambda names, c: F.arrays_overlap(c, F.array(*[F.lit(n) for n in names]))
    root = F.coalesce(F.get(parts, F.lit(1)).isin(*PACKAGE_ROOT_DIRS), F.lit(False))
    return any_(PACKAGE_DIRS, parts) | root | X.basename(path).isin(*PACKAGE_FILES) | F.endswith(path, F.lit(".pyc"))


def too_long(description: Column, most: int = 1024) -> Column:
    """PRJ22."""
    return F.char_length(description) > most


def media_types() -> dict[str, str]:
    """STR12: media types by extension: the standard library's table, without the machine's own files, under MEDIA."""
    return mimetypes.MimeTypes(()).types_map[True] | MEDIA


def media_type(path: Column) -> Column:
    """STR12: by the extension; of a compressed file by the one before, as the standard library does."""
    known = mimetypes.MimeTypes(())
    table = F.create_map(*[F.lit(x) for p in media_types().items() for x in p])
    whole = F.create_map(*[F.lit(x) for p in known.suffix_map.items() for x in p])
    last = F.lower(X.suffix(path))
    inner = F.concat(X.stem(path), F.coalesce(F.try_element_at(whole, last), X.suffix(path)))  # .tgz stands for .tar.gz
    packed = F.lower(X.suffix(inner)).isin(*[e.lower() for e in known.encodings_map])
    name = F.when(packed, X.stem(inner)).otherwise(inner)
    kind = F.when(last.isin(*MEDIA), F.try_element_at(table, last)).otherwise(F.try_element_at(table, F.lower(X.suffix(name))))
    return F.coalesce(kind, F.lit("application/octet-stream"))


def embed_kind(path: Column) -> Column:
    """SRC20."""
    e = F.lower(X.suffix(path))
    return F.when(e.isin(*TEXTS), "text").when(e.isin(*IMAGES), "image").when(e == ".pdf", "pdf").when(e == ".xlsx", "xlsx").otherwise("binary")


def embed(files: DataFrame) -> DataFrame:
    """SRC20, STR13: path, kind, text of text files, data URI of the others."""
    kind, mime = embed_kind(F.col("path")), media_type(F.col("path"))
    return files.select("path", kind.alias("kind"), F.when(kind == "text", F.col("content").cast("string")).alias("text"), F.when(kind != "text", X.data_uri(mime, F.col("content"))).alias("uri"))


def first_text(*columns: Column) -> Column:
    """SRC19, SRC23, WIN05: the first that isn't blank."""
    return F.coalesce(*[F.when(X.strip(c) != "", c) for c in columns])


def merge_feedback(runs: DataFrame, feedback: DataFrame, key: str = "run_id") -> DataFrame:
    """JON10, SNK08: runs and non-blank feedback; either side may stand alone."""
    return runs.join(feedback.where(X.strip(F.col("feedback")) != ""), key, "full")


def pivot_report(results: DataFrame, rows: str, columns: str, values: list, cell: Column) -> DataFrame:
    """SNK06, JON09: a line per iteration, a column per query of the given list; missing cells stay null."""
    return results.groupBy(rows).pivot(columns, values).agg(cell)


def export_evals(items: DataFrame) -> DataFrame:
    """SNK10, SRT03: trimmed queries without blanks, those that should trigger first."""
    return items.withColumn("query", X.strip(F.col("query"))).where("query != ''").orderBy(F.desc("should_trigger"), "position")


def converter_gaps(first: DataFrame, second: DataFrame) -> DataFrame:
    """JON21: document, term, only_in for terms that one converter's text has and the other's lacks."""
    terms = lambda d, n: d.select("doc", F.explode(F.array_distinct(F.split(F.lower("text"), r"\W+"))).alias("term")).where("term != ''").withColumn(n, F.lit(True))
    both = terms(first, "a").join(terms(second, "b"), ["doc", "term"], "full")
    return both.where("a IS NULL OR b IS NULL").select("doc", "term", F.when(F.col("b").isNull(), "first").otherwise("second").alias("only_in"))


def skill_audit(files: DataFrame, sections: tuple[str, ...]) -> DataFrame:
    """PRJ53: path, missing sections, long (over 500 lines), has_version, has_tags."""
    body = F.col("text")
    absent = F.array_compact(F.array(*[F.when(~body.rlike(rf"(?im)^#+ .*{s}"), s) for s in sections]))
    return files.select("path", absent.alias("missing"), (F.size(F.split(body, "\n")) > 500).alias("long"), body.rlike(r"(?m)^\s*version:").alias("has_version"), body.rlike(r"(?m)^\s*tags:").alias("has_tags"))


def ordered_runs(runs: DataFrame) -> DataFrame:
    """SRT02: runs without an eval id last."""
    return runs.orderBy(F.asc_nulls_last("eval_id"), "run_id")


def placed_runs(runs: DataFrame, bins: int = 64) -> DataFrame:
    """SRT02: adds place, from 1, by eval id (none last) and run id. Ranges by quantiles of eval ids sort on their own; equal eval ids share a range."""
    cuts = F.coalesce(F.percentile_approx("eval_id", F.array(*[F.lit(i / bins) for i in range(1, bins)]), F.lit(1000)), F.array().cast("array<long>"))
    ranged = runs.join(F.broadcast(runs.agg(cuts.alias("cuts"))), how="cross").withColumn("range", F.when(F.col("eval_id").isNull(), bins).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("eval_id"))))).drop("cuts")
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # at most bins + 1 rows
    place = F.row_number().over(Window.partitionBy("range").orderBy("eval_id", "run_id"))
    return ranged.withColumn("place", place).join(F.broadcast(before), "range").select(*runs.columns, (F.col("place") + F.col("before")).cast("long").alias("place"))


def valid_feedback(body: Column) -> Column:
    """SNK08: a JSON object with reviews."""
    return F.coalesce(F.get_json_object(body, "$.reviews").isNotNull() & F.startswith(F.trim(body), F.lit("{")), F.lit(False))


def numbered(rows: DataFrame, category: str, priority: Column, prefix: Column, *order: str) -> DataFrame:
    """WIN11, PRJ47: adds number and id (prefix and number) within the category, by priority."""
    w = Window.partitionBy(category).orderBy(priority, *order)
    return rows.withColumn("number", F.row_number().over(w)).withColumn("id", F.concat(prefix, F.col("number").cast("string")))
