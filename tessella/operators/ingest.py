"""Incremental document ingestion: classify, diff, roll up, name, window and clean up (W1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.session import stored

#: fixed values: kinds of documents by extension
KINDS = {
    ".pdf": "pdf", ".docx": "word", ".doc": "word", ".pptx": "powerpoint", ".ppt": "powerpoint", ".xlsx": "excel", ".xls": "excel", ".xlsm": "excel",
    ".drawio": "diagram", ".mp4": "video", ".mkv": "video", ".avi": "video", ".mov": "video", ".webm": "video", ".m4v": "video", ".wmv": "video",
}
#: fixed values: archives, directories that scans leave out, and directories that video scans leave out
ARCHIVES = (".zip", ".tar", ".tar.gz", ".tgz", ".7z")
PRUNED = ("__FRAGMENTS__", ".venv", "venv", ".env", "node_modules", ".git", ".svn", ".hg", ".tmp", ".cache", "__pycache__", ".mypy_cache", ".pytest_cache", "dist", "build", ".tox", ".idea", ".vscode")
PRUNED_FOR_VIDEO = (".git", ".svn", "node_modules", "__pycache__", ".venv", "venv", "__FRAGMENTS__", ".tmp", ".tox", ".mypy_cache", ".pytest_cache")
#: fixed values: states that are processed again, for documents and for videos, and states that count as success
RETRIED = ("error", "failed", "pending", "markdown_only")
RETRIED_VIDEO = ("error", "failed", "pending")
SUCCESS = ("complete", "markdown_only", "images_only")


def is_archive(path: Column) -> Column:
    """SRC05."""
    low = F.lower(X.basename(path))
    out = F.lit(False)
    for e in ARCHIVES:
        out = out | F.endswith(low, F.lit(e))
    return out


def kind(path: Column) -> Column:
    """SRC04, SRC05: archive, one of six kinds, or null for what isn't a document."""
    table = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.when(is_archive(path), "archive").otherwise(F.try_element_at(table, F.lower(X.suffix(path))))


def pruned(path: Column, names: tuple[str, ...] = PRUNED, dot_directories: bool = True) -> Column:
    """SRC02, SRC08: whether a directory on the path is left out of scans. The file's own name doesn't count."""
    dirs = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    out = F.arrays_overlap(dirs, F.array(*[F.lit(n) for n in names]))
    return out | F.exists(dirs, lambda d: F.startswith(d, F.lit("."))) if dot_directories else out


def scan(files: DataFrame, video: bool = False) -> DataFrame:
    """SRC01-SRC05, SRC08: the documents and archives of a listing (path), with kind."""
    rows = files.withColumn("kind", kind(F.col("path"))).where("kind IS NOT NULL")
    if video:
        return rows.where((F.col("kind") == "video") & ~pruned(F.col("path"), PRUNED_FOR_VIDEO, False))
    return rows.where(~pruned(F.col("path")))


def manifest_key(path: Column, root: Column) -> Column:
    """PRJ01: relative to the root, else the bare name."""
    base = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(X.basename(path))


def needs_processing(known: Column, old_hash: Column, new_hash: Column, status: Column, force: bool = False, retried: tuple[str, ...] = RETRIED) -> Column:
    """PRJ02, PRJ03: new, changed, or left in a state that is tried again."""
    return F.lit(force) | ~known | ~old_hash.eqNullSafe(new_hash) | F.coalesce(status.isin(*retried), F.lit(False))


def manifest_diff(current: DataFrame, manifest: DataFrame, force: bool = False, retried: tuple[str, ...] = RETRIED) -> DataFrame:
    """JON01, JON02: key, action of (key, hash) against (key, hash, status): new, changed, retry, forced, unchanged or orphan.

    One full outer join on the key, so both sides move once.
    """
    c = current.select("key", F.col("hash").alias("new"), F.lit(True).alias("here"))
    m = manifest.select("key", F.col("hash").alias("old"), "status", F.lit(True).alias("known"))
    action = (
        F.when(F.col("here").isNull(), "orphan").when(F.col("known").isNull(), "new").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
        .when(F.col("status").isin(*retried), "retry").when(F.lit(force), "forced").otherwise("unchanged")
    )
    return c.join(m, "key", "full").select("key", action.alias("action"))


def current_keys(*listings: DataFrame) -> DataFrame:
    """SET01, SET02: the distinct keys of several listings, documents and archives."""
    out = listings[0].select("key")
    for more in listings[1:]:
        out = out.unionByName(more.select("key"))
    return out.distinct()


def orphans(manifest: DataFrame, current: DataFrame, existing: DataFrame) -> DataFrame:
    """JON02: entries whose key isn't current and whose source is gone."""
    return manifest.join(current.select("key"), "key", "left_anti").join(existing.select("source"), "source", "left_anti")


def orphan_closure(manifest: DataFrame, orphan: DataFrame, compat: bool = False) -> DataFrame:
    """JON03: orphans with the children of orphaned archives, and theirs, to any depth; a child alone is no orphan unless compat.

    manifest: key, archive_contents. Set-based, so cleaning twice does no harm. Levels are stored and go on until one has
    nothing new, so archives that hold each other end as well.
    """
    edges = stored(manifest.select(F.col("key").alias("parent"), F.explode("archive_contents").alias("child")), "members")
    found = orphan.select("key") if compat else orphan.select("key").join(edges.select(F.col("child").alias("key")), "key", "left_anti")
    found = stored(found.distinct(), "orphans")
    levels = [found]
    while not levels[-1].isEmpty():
        new = levels[-1].join(edges, F.col("key") == F.col("parent")).select(F.col("child").alias("key")).distinct().join(found, "key", "left_anti")
        levels.append(stored(new, "orphans"))
        found = found.unionByName(levels[-1])
    return found


def document_status(has_text: Column, has_images: Column) -> Column:
    """PRJ04."""
    return F.when(has_text & has_images, "complete").when(has_text, "markdown_only").when(has_images, "images_only").otherwise("failed")


def video_status(has_transcript: Column, has_frames: Column) -> Column:
    """PRJ05."""
    return F.when(has_transcript & has_frames, "complete").when(has_transcript, "vtt_only").when(has_frames, "images_only").otherwise("failed")


def archive_status(contents: Column) -> Column:
    """PRJ06."""
    return F.when(F.coalesce(F.size(contents), F.lit(0)) > 0, "complete").otherwise("empty")


def is_success(status: Column) -> Column:
    """PRJ07: vtt_only counts as a failure."""
    return F.coalesce(status.isin(*SUCCESS), F.lit(False))


def counters(rows: DataFrame) -> DataFrame:
    """AGG09: outcome, n from rows with an outcome."""
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))


def sliding_windows(pages: DataFrame, doc: str = "doc", page: str = "page", width: int = 3) -> DataFrame:
    """WIN01: windows of `width` pages at stride 1, up to the first that reaches the last page: doc, first, last, name."""
    by = Window.partitionBy(doc).orderBy(page)
    rows = pages.select(doc, page).distinct()
    rows = rows.withColumn("first", F.row_number().over(by)).withColumn("total", F.count("*").over(Window.partitionBy(doc)))
    rows = rows.where(F.col("first") <= F.greatest(F.lit(1), F.col("total") - (width - 1)))
    last = F.least(F.col("first") + (width - 1), F.col("total"))
    return rows.select(doc, F.col("first").cast("long").alias("first"), last.cast("long").alias("last"), X.window_name(F.col("first"), last).alias("name"))


def display_names(files: DataFrame, stem: Column, prefix: Column, name: Column) -> DataFrame:
    """AGG12, STR06: adds display: the name, or prefix-name where several files share a stem."""
    clash = F.count("*").over(Window.partitionBy(stem)) > 1
    return files.withColumn("display", F.when(clash, F.concat(prefix, F.lit("-"), name)).otherwise(name))


def index_listing(images: DataFrame, by: str, image: str, n: int = 3) -> DataFrame:
    """SNK03, LIM01: by, listed (the first n images) and more (how many follow). Only the first n of each task's rows move."""
    rows = images.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(image))).where(F.col("place") <= n)
    listed = rows.groupBy(by).agg(F.array_sort(F.collect_list(image)).alias("listed"))
    counts = images.groupBy(by).agg(F.greatest(F.lit(0), F.count("*") - n).cast("long").alias("more"))
    return listed.join(counts, by)


def companions(videos: DataFrame, subtitles: DataFrame, prefix: int = 40) -> DataFrame:
    """SRC22: subtitles of the same directory with the video's stem, or beginning with its first 40 characters.

    Both are one equi-join: a subtitle is listed under each of its beginnings of up to so many characters, a video under
    its own beginning, so a flat directory isn't compared with itself.
    """
    v = videos.select("dir", F.col("stem").alias("video"), F.substring("stem", 1, prefix).alias("start")).distinct()
    s = subtitles.select("dir", F.col("stem").alias("subtitle")).distinct()
    beginnings = F.transform(F.sequence(F.lit(0), F.least(F.lit(prefix), F.length("subtitle"))), lambda n: F.substring("subtitle", F.lit(1), n))
    return v.join(s.withColumn("start", F.explode(beginnings)), ["dir", "start"]).select("dir", "video", "subtitle")


def missing_transcripts(videos: DataFrame, companion: DataFrame, transcripts: DataFrame) -> DataFrame:
    """JON11, SRC24: videos without companion subtitles and without a transcript in their fragment."""
    return videos.join(companion.select("video").distinct(), "video", "left_anti").join(transcripts.select("video"), "video", "left_anti")


def transcript_source(manual: Column, generated: Column, allow_generation: Column) -> Column:
    """UDF13, UDF14: companion subtitles, else the fragment's transcript, else generation if allowed."""
    return F.when(manual, "manual").when(generated, "fragment").when(allow_generation, "generate").otherwise("none")


def pick_named(documents: DataFrame, archives: DataFrame, name: str) -> DataFrame:
    """PRJ08: the documents of that name, and only without any the archives of that name. Few rows have a name, so they may meet in one task."""
    rows = documents.where(F.col("name") == name).withColumn("rank", F.lit(1)).unionByName(archives.where(F.col("name") == name).withColumn("rank", F.lit(2)))
    return rows.withColumn("best", F.min("rank").over(Window.partitionBy("name"))).where("rank = best").drop("rank", "best")


def fragment(frontmatter: Column, body: Column) -> Column:
    """SNK02: front matter lines between rules, then the body."""
    lines = F.transform(F.map_entries(frontmatter), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n\n"), body)
