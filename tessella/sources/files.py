"""File listings, archives, front matter, diagrams, manifests and evaluation workspaces (SRC, SNK)."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators.ingest import ARCHIVES, KINDS

#: explicit schemas: inference would make strings of fields whose type varies
GRADING = """expectations ARRAY<STRUCT<id STRING, text STRING, passed BOOLEAN, evidence STRING>>,
summary STRUCT<passed INT, failed INT, total INT, pass_rate DOUBLE>,
execution_metrics STRUCT<tool_calls MAP<STRING,BIGINT>, total_tool_calls BIGINT, total_steps BIGINT, errors_encountered BIGINT, output_chars BIGINT, transcript_chars BIGINT, total_tokens BIGINT, note STRING>,
timing STRUCT<executor_duration_seconds DOUBLE, grader_duration_seconds DOUBLE, total_duration_seconds DOUBLE, total_tokens BIGINT, duration_ms BIGINT>,
claims ARRAY<STRUCT<claim STRING, type STRING, verified BOOLEAN, evidence STRING>>, user_notes_summary VARIANT,
eval_feedback STRUCT<suggestions ARRAY<STRUCT<assertion STRING, reason STRING>>, overall STRING>, _corrupt_record STRING"""
TIMING = "total_tokens BIGINT, duration_ms BIGINT, total_duration_seconds DOUBLE, executor_start STRING, executor_end STRING, executor_duration_seconds DOUBLE, grader_start STRING, grader_end STRING, grader_duration_seconds DOUBLE, note STRING, _corrupt_record STRING"
METADATA = "eval_id BIGINT, eval_name STRING, prompt STRING, assertions VARIANT, _corrupt_record STRING"
ENTRY = "STRUCT<source STRING, hash STRING, processed_at STRING, type STRING, markitdown STRING, docling STRING, drawio_parsed STRING, vtt STRING, manual_subtitles ARRAY<STRING>, images ARRAY<STRING>, archive_contents ARRAY<STRING>, status STRING, error STRING>"
MANIFEST = f"files MAP<STRING, {ENTRY}>, last_updated STRING"


def scan_root(*candidates: str | None) -> str:
    """SRC07: the first root that is given."""
    return next((c for c in candidates if c), ".")


def put_files(files: DataFrame, folder: str) -> str:
    """Writes files (path below the folder, content) one by one to any file system that Spark knows: for reports, packages and fixtures, whose number is small.

    They pass through the driver a partition at a time. Larger sets are written as tables.
    """
    spark = files.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for r in files.select("path", F.col("content").cast("binary").alias("content")).toLocalIterator():
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(root, r.path), True)
        try:
            out.write(r.content)
        finally:
            out.close()
    return folder


def relative_to(path: Column, folder: str) -> Column:
    """A path as listings give it (a URI) below a folder; escapes of the URI stay."""
    return F.regexp_replace(path, "^" + _uri_pattern(folder), "")


def _uri_pattern(folder: str) -> str:
    bare = re.sub(r"^[a-z]+:/+", "", folder).strip("/")
    return r"(?:[a-z]+:)?/*" + re.escape(bare) + "/*"


def flat_scan(spark: SparkSession, folder: str) -> DataFrame:
    """SRC03: documents that stand in the folder itself, by extensions in lower or in upper case; mixed case isn't found."""
    ends = sorted({*KINDS, *ARCHIVES})
    return read_files(spark, [folder], "*{" + ",".join(x for e in ends for x in (e, e.upper())) + "}", recursive=False)


def read_files(spark: SparkSession, roots: list[str], pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """SRC01, SRC03: path, modificationTime, length, content.

    Recursive listings skip children whose names begin with _ or ., so such directories are given as roots of their own.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(roots)


def read_texts(spark: SparkSession, roots: list[str], pattern: str = "*.md") -> DataFrame:
    """SRC21: path, text of whole files."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(roots, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC09, MAP03: key, entry; no rows where the file is missing or broken."""
    try:
        raw = spark.read.schema(MANIFEST).json(path, multiLine=True)
        raw.schema  # noqa: B018
        return raw.select(F.explode("files").alias("key", "entry"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"key STRING, entry {ENTRY}")


def write_manifest(rows: DataFrame, path: str) -> None:
    """SNK01: a snapshot of its own per call; readers switch to the new path when it is complete."""
    rows.write.mode("errorifexists").parquet(path)


def read_gradings(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SRC12: gradings with workspace parts from the path; broken files are dropped."""
    p = F.col("_metadata.file_path")
    rows = spark.read.schema(GRADING).option("recursiveFileLookup", "true").option("pathGlobFilter", "grading.json").json(paths, multiLine=True).select("*", p.alias("path"))
    part = lambda i: F.regexp_extract("path", r"/([^/]+)/([^/]+)/(?:run-([^/]+)/)?grading\.json$", i)
    return rows.where("_corrupt_record IS NULL").drop("_corrupt_record").withColumns({"eval_dir": part(1), "configuration": part(2), "run_number": F.coalesce(F.expr(r"try_cast(regexp_extract(path, 'run-([^/]+)/grading', 1) AS INT)"), F.lit(1))})


def workspace_runs(listing: DataFrame, root: str) -> DataFrame:
    """SRC10, SRC11: layout, eval_dir, configuration, run, graded of a benchmark workspace, from a listing of its files (path).

    Evaluations stand below runs/ where there is such a directory, else below the root; a configuration is a directory
    that holds run-* directories, whatever its name.
    """
    rows = listing.select(relative_to(F.col("path"), root).alias("p")).withColumn("below", F.startswith("p", F.lit("runs/")))
    rows = rows.join(F.broadcast(rows.agg(F.coalesce(F.bool_or("below"), F.lit(False)).alias("has_runs"))), how="cross").where("NOT has_runs OR below")
    rows = rows.withColumn("q", F.when(F.col("below"), F.substring("p", 6, 1 << 30)).otherwise(F.col("p")))
    part = lambda i: F.regexp_extract("q", r"^(eval-[^/]*)/([^/]+)/(run-[^/]*)/(.+)$", i)
    rows = rows.select(F.when(F.col("has_runs"), "runs").otherwise("flat").alias("layout"), part(1).alias("eval_dir"), part(2).alias("configuration"), part(3).alias("run"), part(4).alias("file")).where("run <> ''")
    return rows.groupBy("layout", "eval_dir", "configuration", "run").agg(F.bool_or(F.col("file") == "grading.json").alias("graded"))


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """SRC13, SRC19, SRC23, STR16, SRT02, WIN05: id, run, eval_id, prompt, outputs, grading of each run directory below the root.

    The prompt is that of the metadata beside the outputs or above, else of a transcript, the first that isn't blank; the
    grading is the first that is a JSON object with fields.
    """
    files = read_files(spark, [root])
    runs = run_directories(files, listing_root(files, root))
    small = F.col("path").rlike(r"/(eval_metadata\.json|transcript\.md|grading\.json)$")
    texts = files.where(small).select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), X.basename(F.col("path")).alias("file"), F.col("content").cast("string").alias("text"))
    up = F.when(F.col("relative") != "", X.parent(F.col("run"))).otherwise(F.col("run"))
    places = runs.select("run", "relative", F.explode(F.array(F.struct(F.lit(0).alias("at"), F.col("run").alias("dir")), F.struct(F.lit(1).alias("at"), up.alias("dir")), F.struct(F.lit(2).alias("at"), F.concat("run", F.lit("/outputs")).alias("dir")))).alias("w")).select("run", "relative", "w.at", "w.dir")
    found = places.join(texts, "dir", "left")
    is_file = lambda name: F.col("file") == name
    meta = F.when(is_file("eval_metadata.json") & (F.col("at") < 2), F.col("text"))
    said = F.when(is_file("transcript.md") & (F.col("at") != 1), X.transcript_prompt(F.col("text")))
    grading = F.when(is_file("grading.json") & (F.col("at") < 2) & F.get_json_object("text", "$").rlike(r"^\s*\{\s*\""), F.col("text"))
    first = lambda value: F.min_by(F.when(X.strip(value) != "", value), F.when(X.strip(value) != "", F.col("at")))
    facts = found.groupBy("run", "relative").agg(first(F.get_json_object(meta, "$.prompt")).alias("stated"), F.min_by(F.get_json_object(meta, "$.eval_id"), F.when(F.get_json_object(meta, "$.eval_id").isNotNull(), F.col("at"))).alias("eval_id"), first(said).alias("transcribed"), first(grading).alias("grading"))
    outputs = files.select(F.regexp_extract("path", "^(.*)/outputs/[^/]+$", 1).alias("run")).where("run <> ''").groupBy("run").agg(F.count("*").alias("outputs"))
    from tessella.operators.validate import first_text

    prompt = first_text(F.col("stated"), F.col("transcribed"), F.lit("(No prompt found)"))
    return facts.join(outputs, "run", "left").select(X.run_id(F.col("relative")).alias("id"), "run", F.col("eval_id").cast("long").alias("eval_id"), prompt.alias("prompt"), F.coalesce("outputs", F.lit(0)).alias("outputs"), "grading")


def listing_root(files: DataFrame, root: str) -> str:
    """The root as listings spell it."""
    spark = files.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def read_timings(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = spark.read.schema(TIMING).json(paths, multiLine=True).select("*", F.col("_metadata.file_path").alias("path"))
    return rows.where("_corrupt_record IS NULL").drop("_corrupt_record")


#: fixed values: directories in which no runs are looked for
NO_RUNS = ("node_modules", ".git", "__pycache__", "skill", "inputs")


def run_directories(listing: DataFrame, root: str, left_out: tuple[str, ...] = NO_RUNS) -> DataFrame:
    """SRC13: run, relative: directories below root with an outputs directory, by their files' paths.

    The walk ends at the first such directory, so runs within a run's outputs don't count, nor do those below
    a directory of `left_out`. Only parts below the root are looked at, whatever the root's own path is. An empty relative
    path is the root itself.
    """
    base = root.rstrip("/") + "/"
    parts = F.split(F.substring("path", len(base) + 1, 1 << 30), "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    depth = F.array_position(dirs, "outputs") - 1
    walked = F.slice(dirs, F.lit(1), F.greatest(F.lit(0), depth).cast("int"))
    rows = listing.where(F.startswith("path", F.lit(base))).where(depth >= 0).where(~F.arrays_overlap(walked, F.array(*[F.lit(x) for x in left_out])))
    relative = F.array_join(walked, "/")
    return rows.select(F.when(relative == "", base.rstrip("/")).otherwise(F.concat(F.lit(base), relative)).alias("run"), relative.alias("relative")).distinct()


#: from a first line of three dashes to the next such line; white space may follow the dashes
_MATTER = r"(?s)\A---[ \t\x0B\f\r]*\n(?:.*?\n)??---[ \t\x0B\f\r]*(?=\n|\z)"


def _let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, which is computed once however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _matter(text: Column) -> Column:
    """The lines between a first line of three dashes and the next such line, as an array; null without either. Lines behind them aren't split."""
    return _let(F.regexp_extract(text, _MATTER, 0), lambda m: F.when(m != "", _let(F.split(m, "\n"), lambda x: F.slice(x, F.lit(2), F.size(x) - 2))))


def frontmatter(text: Column) -> Column:
    """SRC14: lenient `key: value` lines between rules, however indented, as a map; null without front matter. The last of equal keys wins.

    Lines are sorted by key and place, so that equal keys lie side by side, and back by place.
    """
    pairs = F.transform(_matter(text), lambda x, i: F.struct(X.strip(F.substring_index(x, ":", 1)).alias("k"), i.alias("i"), F.regexp_replace(X.strip(F.regexp_extract(x, "(?s)^[^:]*:(.*)$", 1)), "^[\"']+|[\"']+$", "").alias("v"), F.contains(x, F.lit(":")).alias("is")))
    pairs = F.sort_array(F.filter(pairs, lambda p: p["is"] & (p["k"] != "") & ~F.startswith(p["k"], F.lit("#"))))
    last = _let(pairs, lambda a: F.filter(a, lambda p, i: ~F.get(a, i + 1)["k"].eqNullSafe(p["k"])))
    placed = F.sort_array(F.transform(last, lambda p: F.struct(p["i"], p["k"], p["v"])))
    return F.map_from_entries(F.transform(placed, lambda p: F.struct(p["k"], p["v"])))


def frontmatter_blocks(df: DataFrame, text: str = "text") -> DataFrame:
    """SRC15: adds name and description; a description of >, |, >- or |- runs on over lines of two blanks or a tab of indent.

    The part between the rules becomes one array of lines; an aggregate walks it, in the JVM. Empty without front matter.
    """
    lines = F.coalesce(_matter(F.col(text)), F.array().cast("array<string>"))
    bare = lambda v: F.regexp_replace(F.regexp_replace(v, '^"+|"+$', ""), "^'+|'+$", "")
    after = lambda x, key: X.strip(F.substring(x, len(key) + 2, 1 << 30))

    def value(key: str, runs_on: bool) -> Column:
        start = F.struct(F.lit(False).alias("on"), F.lit("").alias("v"))
        block = lambda x: after(x, key).rlike("^[>|]-?$") if runs_on else F.lit(False)
        step = lambda s, x: (
            F.when(s["on"] & x.rlike("^(  |\t)"), F.struct(F.lit(True).alias("on"), F.concat_ws(" ", F.when(s["v"] != "", s["v"]), X.strip(x)).alias("v")))
            .when(F.startswith(x, F.lit(f"{key}:")), F.struct(block(x).alias("on"), F.when(block(x), "").otherwise(bare(after(x, key))).alias("v")))
            .otherwise(F.struct(F.lit(False).alias("on"), s["v"].alias("v")))
        )
        return F.aggregate(lines, start, step, lambda s: s["v"])

    return df.withColumn("name", value("name", False)).withColumn("description", value("description", True))


#: what PyYAML's parser in C is known to read otherwise than its own, or isn't known to read alike: odd characters, tabs, question
#: marks and backslashes anywhere, other signs at the start of a token, block scalars with anything behind their sign
_UNLIKE = r"[^A-Za-z0-9_ \n:'./()+#\"~=,;\[\]{}<>|$^!&*%@\xa1-\u2027\u2030-\ud7ff-]|(?<!\w)[!&*%@]|[>|](?!-?\n)"


def yaml_loader():
    """The function of a text that gives what yaml.safe_load does, and its errors. It refers to nothing of this package, so workers without it can run it.

    Texts of up to 16 KiB, of few levels and without what is listed in `_UNLIKE` go to the parser in C; those that it refuses, and all others,
    to PyYAML's own, whose verdict and words count. The parser in C has no bound on levels, so texts that could have many never reach it.
    """
    unlike = _UNLIKE

    def load(text: str):
        import re

        import yaml

        quick = getattr(yaml, "CSafeLoader", None)
        if quick and len(text) <= 1 << 14 and text.count("- ") + text.count("[") + text.count("{") < 256 and not re.search(unlike, text):
            try:
                return yaml.load(text, Loader=quick)
            except yaml.YAMLError:
                pass
        return yaml.safe_load(text)

    return load


def parse_yaml(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """SRC16: strict front matter: keep, matter (JSON of the mapping), error. YAML has no parser in the JVM."""
    load = yaml_loader()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json
        import re

        import yaml

        for b in batches:
            matter, error = [], []
            for t in b.column(len(keep)).to_pylist():
                m = re.match(r"^---\n(.*?)\n---", t or "", re.S)
                try:
                    v = load(m[1]) if m else None
                    ok = isinstance(v, dict)
                    matter.append(json.dumps(v, default=str) if ok else None)
                    error.append(None if ok else "no front matter" if not m else "not a mapping")
                except yaml.YAMLError as e:
                    matter.append(None)
                    error.append(str(e).split("\n")[0])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(matter, pa.string()), pa.array(error, pa.string())], [*keep, "matter", "error"])

    return df.select(*keep, text).mapInArrow(run, df.select(*keep).schema.add("matter", "string").add("error", "string"))


def archive_members(files: DataFrame, depth: int = 16, most_bytes: int = 1 << 30) -> DataFrame:
    """SRC06: archive, member, content, error of zip and tar files, and of those within, to `depth`.

    What isn't read gets an error row: members of more than `most_bytes` and archives nested deeper, as guards against bombs.

    Names that are absolute or climb out are refused with an error row, as are kinds without a reader here (7z) and broken files.
    """

    def members(name: str, raw: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
        low = name.lower()
        try:
            if low.endswith(".zip"):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for i in z.infolist():
                        if not i.is_dir():
                            yield i.filename, z.read(i) if i.file_size <= most_bytes else None, None if i.file_size <= most_bytes else "too large"
            elif low.endswith((".tar", ".tar.gz", ".tgz")):
                with tarfile.open(fileobj=io.BytesIO(raw)) as t:
                    for i in t:
                        if i.isfile():
                            yield i.name, t.extractfile(i).read() if i.size <= most_bytes else None, None if i.size <= most_bytes else "too large"
            else:
                yield "", None, "no reader for this kind"
        except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError) as e:
            yield "", None, f"broken: {e}"

    def walk(archive: str, name: str, raw: bytes, left: int) -> Iterator[tuple]:
        for member, content, error in members(name, raw):
            if member.startswith(("/", "\\")) or ".." in member.replace("\\", "/").split("/"):
                yield archive, member, None, "unsafe name"
                continue
            yield archive, member, content, error
            if content is not None and member.lower().endswith((".zip", ".tar", ".tar.gz", ".tgz")):
                if left > 1:
                    yield from walk(f"{archive}!{member}", member, content, left - 1)
                else:
                    yield f"{archive}!{member}", "", None, "nested too deep"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1)):
                rows = list(walk(path, path, raw.as_py() or b"", depth))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.binary(), pa.string()))], ["archive", "member", "content", "error"])

    return files.select("path", "content").mapInArrow(run, "archive string, member string, content binary, error string")


def diagram_cells(files: DataFrame) -> DataFrame:
    """SRC17, XML01, UDF03: file, diagram, pos, id, value, style, source, target, parent, edge, connectable; broken XML gives no cells.

    Missing attributes stay null, so columns can't slip against each other.
    """
    cell = "array<struct<_id:string,_value:string,_style:string,_source:string,_target:string,_parent:string,_edge:string,_connectable:string>>"
    schema = f"diagram array<struct<_name:string,mxGraphModel:struct<root:struct<mxCell:{cell}>>>>"
    parsed = files.select(F.col("path").alias("file"), F.from_xml(F.col("content").cast("string"), schema, {"mode": "PERMISSIVE"}).alias("x"))
    tabs = parsed.select("file", F.posexplode("x.diagram").alias("tab", "d"))
    rows = tabs.select("file", F.coalesce("d._name", F.concat(F.lit("Page "), (F.col("tab") + 1).cast("string"))).alias("diagram"), F.posexplode("d.mxGraphModel.root.mxCell").alias("pos", "c"))
    return rows.select("file", "diagram", "pos", *[F.col(f"c._{n}").alias(n) for n in ("id", "value", "style", "source", "target", "parent", "edge", "connectable")])


def benchmark_json(summary: DataFrame) -> DataFrame:
    """SNK04: one row of JSON per configuration; the caller writes the single file."""
    return summary.groupBy("configuration").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", F.struct("mean", "stddev", "min", "max")))))).alias("json"))


def write_results(df: DataFrame, folder: str, stamp: str) -> str:
    """SNK11: results under a folder of their time."""
    path = f"{folder.rstrip('/')}/{stamp}"
    df.write.mode("errorifexists").json(path)
    return path
