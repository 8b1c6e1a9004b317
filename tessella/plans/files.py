"""Queries of file sources, sinks and streams: small folders are made of the tables' rows, read back by the library, and compared with what SQL says of the same rows."""

from __future__ import annotations

import io
import tarfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.functions import values as V
from tessella.operators import convert as Z
from tessella.operators import evals as E
from tessella.operators import ingest as I
from tessella.operators import knowledge as K
from tessella.operators import validate as C
from tessella.plans.evaluation import _RUNS, _STATS, _runs
from tessella.plans.registry import query, table
from tessella.session import new_folder, stored
from tessella.sources import files as S
from tessella.sources import reports as W
from tessella.streaming import events as T


def _nations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("r"))


def _pick(options: list[str], c) -> F.Column:
    return F.get(F.array(*[F.lit(x) for x in options]), c.cast("int"))


_DIRS = ["", "a/", "a/deep/", "node_modules/x/", "b/venv/"]
_ENDS = [".pdf", ".DOCX", ".md", ".zip", ".Pdf", ".mp4", ".drawio"]
_TREE = f"SELECT n_nationkey AS k, {_DIRS}[1 + n_nationkey % 5] AS dir, 'f' || n_nationkey || {_ENDS}[1 + n_nationkey % 7] AS name, ['pdf', 'word', NULL, 'archive', 'pdf', 'video', 'diagram'][1 + n_nationkey % 7] AS kind, length(n_name) AS size FROM nation"


def _tree(spark: SparkSession, sf: str) -> str:
    """A folder of a file per nation, in five directories, two of them pruned, with seven kinds of names."""
    n = _nations(spark, sf)
    path = F.concat(_pick(_DIRS, F.col("k") % 5), F.lit("f"), F.col("k").cast("string"), _pick(_ENDS, F.col("k") % 7))
    return S.put_files(n.select(path.alias("path"), "name").withColumnRenamed("name", "content"), new_folder(spark, "tree"))


@query(f"SELECT dir || name AS path, kind, CAST(size AS BIGINT) AS length FROM ({_TREE}) WHERE kind IS NOT NULL AND k % 5 < 3")
def w1_scan(spark, sf):
    """SRC01, SRC02, SRC04, SRC05, SRC07."""
    root = S.scan_root(None, _tree(spark, sf))
    files = S.read_files(spark, [root]).select(S.relative_to(F.col("path"), root).alias("path"), "length")
    return I.scan(files)


@query(f"SELECT name, CAST(size AS BIGINT) AS length FROM ({_TREE}) WHERE dir = '' AND k % 7 IN (0, 1, 3, 5, 6)")
def w1_flat_scan(spark, sf):
    """SRC03: the folder itself alone; endings of mixed case aren't found."""
    return S.flat_scan(spark, _tree(spark, sf)).select(X.basename(F.col("path")).alias("name"), "length")


@query(f"SELECT dir || name AS path FROM ({_TREE}) WHERE kind = 'video' AND k % 5 < 3")
def w1_video_scan(spark, sf):
    """SRC08."""
    root = _tree(spark, sf)
    return I.scan(S.read_files(spark, [root]).select(S.relative_to(F.col("path"), root).alias("path")), video=True).select("path")


def _markdown(path: str, content: bytes) -> str | None:
    """A stand-in for the first converter: it fails on some files and gives nothing for others."""
    if content.endswith(b"0"):
        raise ValueError("can't read")
    return f"# {content.decode()}" if content.endswith((b"1", b"2", b"3")) else None


def _plain(path: str, content: bytes) -> str | None:
    """A stand-in for the second: it gives nothing for names of nine."""
    return content.decode() if not content.endswith(b"9") else ""


@query("""SELECT CAST(c_custkey AS VARCHAR) || e AS path, CASE WHEN e = '.doc' THEN NULL WHEN d IN (1, 2, 3) THEN 'markitdown' WHEN d <> 9 THEN 'docling' END AS converter, CASE WHEN e = '.doc' THEN NULL WHEN d IN (1, 2, 3) THEN '# ' || c_custkey WHEN d <> 9 THEN CAST(c_custkey AS VARCHAR) END AS markdown,
 CASE WHEN e <> '.doc' AND d = 0 THEN 'markitdown: can''t read' END AS error, CASE WHEN e = '.doc' OR d = 9 THEN CASE WHEN c_custkey % 3 = 0 THEN 'images_only' ELSE 'failed' END WHEN c_custkey % 3 = 0 THEN 'complete' ELSE 'markdown_only' END AS status
FROM (SELECT c_custkey, c_custkey % 10 AS d, CASE WHEN c_custkey % 7 = 0 THEN '.doc' ELSE '.pdf' END AS e FROM customer)""")
def w1_convert(spark, sf):
    """UDF01, UDF02, WIN05, PRJ04: stand-ins for converters; the first that gives text wins, failures leave their message, old files aren't tried."""
    k = F.col("c_custkey")
    path = F.concat(k.cast("string"), F.when(k % 7 == 0, ".doc").otherwise(".pdf"))
    c = table(spark, sf, "customer")
    done = Z.convert(c.select(path.alias("path"), k.cast("string").cast("binary").alias("content")), [("markitdown", _markdown), ("docling", _plain)])
    images = c.where("c_custkey % 3 = 0").select(path.alias("path"), F.array(F.lit("p001-001.webp")).alias("images"))
    return done.join(Z.with_status(done, images), "path")


@query("""SELECT p_partkey, CAST(CASE WHEN p_size % 4 = 0 THEN p_size WHEN p_size % 4 = 1 THEN p_size + 100 WHEN p_size % 4 = 2 THEN p_size + 200 ELSE 1 END AS BIGINT) AS pages FROM part""")
def w1_page_count(spark, sf):
    """UDF08, WIN05: counts of three readers, some missing, zero or negative."""
    n = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", Z.page_count(F.when(n % 4 == 0, n), F.when(n % 4 == 1, n + 100).otherwise(0), F.when(n % 4 == 2, n + 200).otherwise(-1)).cast("long").alias("pages"))


@query("""SELECT p_partkey, p_size % 4 < 2 AS readable, CAST(CASE WHEN p_size % 4 < 2 THEN p_partkey % 50000 END AS BIGINT) AS width, CAST(CASE WHEN p_size % 4 < 2 THEN p_size * 300 END AS BIGINT) AS height,
 p_size % 4 < 2 AND least(p_partkey % 50000, p_size * 300) >= 100 AND greatest(p_partkey % 50000, p_size * 300) <= 8192 AS suitable FROM part""")
def w4_image_headers(spark, sf):
    """UDF11, PRJ16: PNG and GIF headers, one cut off, and other bytes."""
    w, h, k = F.col("p_partkey") % 50000, F.col("p_size") * 300, F.col("p_size") % 4
    hex8 = lambda c: F.lpad(F.hex(c), 8, "0")
    swapped = lambda c: F.concat(F.substring(F.lpad(F.hex(c), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(c), 4, "0"), 1, 2))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hex8(w), hex8(h), F.lit("0806"))
    raw = F.unhex(F.when(k == 0, png).when(k == 1, F.concat(F.lit("474946383961"), swapped(w), swapped(h), F.lit("F700"))).when(k == 2, F.substring(png, 1, 40)).otherwise("FFD8FFE0"))
    p = table(spark, sf, "part").select("p_partkey", C.image_header(raw).alias("i")).select("p_partkey", "i.*", F.lit(20_000).alias("size_bytes"))
    return C.verify_images(p).select("p_partkey", "readable", "width", "height", F.coalesce("suitable", F.lit(False)).alias("suitable"))


def _archive(k: int, name: str) -> tuple[str, bytes]:
    """An archive per nation: zip, tar, gzipped tar, a zip in a zip, a kind without a reader."""

    def zipped(members: dict[str, bytes]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for path, raw in members.items():
                z.writestr(path, raw)
        return out.getvalue()

    raw = name.encode()
    if k % 5 == 0:
        return f"x{k}.zip", zipped({"one.txt": raw, "in/two.txt": b"2", "../out.txt": b"3"})
    if k % 5 in (1, 2):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz" if k % 5 == 2 else "w") as t:
            info = tarfile.TarInfo("one.txt")
            info.size = len(raw)
            t.addfile(info, io.BytesIO(raw))
        return f"x{k}.t{'gz' if k % 5 == 2 else 'ar'}", out.getvalue()
    if k % 5 == 3:
        return f"x{k}.zip", zipped({"deep.zip": zipped({"one.txt": raw})})
    return f"x{k}.7z", b"7z"


@query("""SELECT n_nationkey AS k, m.member, CASE WHEN m.member = 'one.txt' THEN n_name WHEN m.member = 'in/two.txt' THEN '2' END AS content, m.error
FROM nation JOIN (VALUES (0, 'one.txt', NULL), (0, 'in/two.txt', NULL), (0, '../out.txt', 'unsafe name'), (1, 'one.txt', NULL), (2, 'one.txt', NULL), (3, 'deep.zip', NULL), (3, 'one.txt', NULL), (4, '', 'no reader for this kind')) m(kind, member, error) ON m.kind = n_nationkey % 5""")
def w1_archive_members(spark, sf):
    """SRC06: the text of members that are text; an archive within has bytes of its own."""
    rows = [_archive(r.k, r.name) for r in _nations(spark, sf).collect()]  # 25 nations
    folder = S.put_files(spark.createDataFrame(rows, "path string, content binary"), new_folder(spark, "archives"))
    m = S.archive_members(S.read_files(spark, [folder]))
    k = F.regexp_extract(F.substring_index("archive", "!", 1), r"x(\d+)\.[a-z0-9]+$", 1).cast("long")
    return m.select(k.alias("k"), "member", F.when(F.endswith("member", F.lit(".txt")), F.col("content").cast("string")).alias("content"), "error")


_ENTRY = "struct_pack(status := ['complete', 'failed'][1 + n_nationkey % 2])"


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    """key, entry of each nation, as manifests have them."""
    e = F.struct(
        F.concat(F.lit("src/"), "name").alias("source"), F.md5("name").alias("hash"), F.lit("2026-01-02T03:04:05").alias("processed_at"), F.when(F.col("k") % 3 == 0, F.concat("name", F.lit(".md"))).alias("markitdown"),
        F.transform(F.sequence(F.lit(1), F.col("k") % 6), lambda i: F.concat(F.lit("i"), i.cast("string"), F.lit(".webp"))).alias("images"), F.when(F.col("k") % 4 == 0, F.array(F.lit("m1"), F.lit("m2"))).alias("archive_contents"), _pick(["complete", "failed"], F.col("k") % 2).alias("status"),
    )
    n = _nations(spark, sf).withColumn("k", F.col("k").cast("int"))
    return n.select(F.concat(F.lit("docs/"), "name").alias("key"), F.when(F.col("k") % 6 == 0, e.withField("images", F.array().cast("array<string>"))).otherwise(e).alias("entry"))


@query("""SELECT 'docs/' || n_name AS key, 'src/' || n_name AS source, md5(n_name) AS hash, ['complete', 'failed'][1 + n_nationkey % 2] AS status, CAST(n_nationkey % 6 AS BIGINT) AS images FROM nation""")
def w1_manifest_read(spark, sf):
    """SRC09, MAP03, JSN01: a manifest written as JSON and read back, together with one that isn't there."""
    folder = new_folder(spark, "manifest")
    body = _manifest(spark, sf).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("key", "entry"))).alias("files"), F.lit("now").alias("last_updated"))).alias("content"))  # 25 nations
    S.put_files(body.select(F.lit("m.json").alias("path"), "content"), folder)
    both = S.read_manifest(spark, f"{folder}/m.json").unionByName(S.read_manifest(spark, f"{folder}/none.json"))
    return both.select("key", "entry.source", "entry.hash", "entry.status", F.size("entry.images").cast("long").alias("images"))


@query("SELECT s.n AS snapshot, 'docs/' || n_name AS key FROM nation JOIN (VALUES (1), (2)) s(n) ON s.n = 2 OR n_nationkey % 2 = 0")
def w1_manifest_snapshots(spark, sf):
    """SNK01: a snapshot after each batch; the second holds what the first does."""
    m = _manifest(spark, sf).select("key")
    even = _nations(spark, sf).where("k % 2 = 0").select(F.concat(F.lit("docs/"), "name").alias("key"))
    folder = new_folder(spark, "snapshots")
    for n, rows in ((1, even), (2, m)):
        S.write_manifest(rows, f"{folder}/{n}")
    read = lambda n: spark.read.parquet(f"{folder}/{n}").select(F.lit(n).alias("snapshot"), "key")
    return read(1).unionByName(read(2))


@query("""SELECT 'docs/' || n_name AS key, '### docs/' || n_name || chr(10) || chr(10) || '- **Status:** ' || ['complete', 'failed'][1 + n_nationkey % 2] || chr(10) || '- **Source:** src/' || n_name || chr(10) || '- **Processed:** 2026-01-02T03:04:05'
 || CASE WHEN n_nationkey % 3 = 0 THEN chr(10) || '- **Markitdown:** [' || n_name || '.md](' || n_name || '.md)' ELSE '' END
 || CASE WHEN n_nationkey % 6 > 0 THEN chr(10) || '- **Images:** ' || n_nationkey % 6 || ' WEBP file(s)' || array_to_string(list_transform(range(1, 1 + least(3, n_nationkey % 6)), lambda i: chr(10) || '  - [i' || i || '.webp](i' || i || '.webp)'), '') ELSE '' END
 || CASE WHEN n_nationkey % 6 > 3 THEN chr(10) || '  - … and ' || (n_nationkey % 6 - 3) || ' more' ELSE '' END || CASE WHEN n_nationkey % 4 = 0 THEN chr(10) || '- **Archive contents:** 2 document(s)' || chr(10) || '  - m1' || chr(10) || '  - m2' ELSE '' END || chr(10) || chr(10) AS text FROM nation""")
def w1_index_text(spark, sf):
    """SNK03, LIM01, ARR01."""
    e = F.col("entry")
    return W.index_text(_manifest(spark, sf).withColumn("entry", e.withField("docling", F.lit(None).cast("string")).withField("drawio_parsed", F.lit(""))))


_WORKSPACE = "SELECT n_nationkey AS k, 'eval-' || n_regionkey AS eval_dir, ['new_skill', 'old_skill', 'notes'][1 + n_nationkey % 3] AS configuration, 'run-' || n_nationkey AS run, n_nationkey % 4 <> 3 AS graded, n_nationkey % 7 <> 6 AS valid FROM nation"


def _workspace(spark: SparkSession, sf: str, below: str) -> str:
    """Runs of three configurations, one of which has no runs; some aren't graded, some gradings are broken."""
    k = F.col("k")
    folder = F.concat(F.lit(f"{below}eval-"), F.col("r").cast("string"), F.lit("/"), _pick(["new_skill", "old_skill", "notes"], k % 3), F.lit("/"), F.when(k % 3 == 2, "x").otherwise(F.concat(F.lit("run-"), k.cast("string"))), F.lit("/"))
    name = F.when(k % 4 == 3, "log.txt").otherwise("grading.json")
    body = F.when(k % 7 == 6, '{"summary": {"passed": ').otherwise(F.concat(F.lit('{"summary": {"passed": '), k.cast("string"), F.lit(', "failed": 1, "total": '), (k + 1).cast("string"), F.lit('}, "expectations": []}')))
    return S.put_files(_nations(spark, sf).select(F.concat(folder, name).alias("path"), body.alias("content")), new_folder(spark, "workspace"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS layout, eval_dir, configuration, run, graded FROM ({_WORKSPACE}) WHERE configuration <> 'notes'" for n in ("runs", "flat")))
def w2_workspace_runs(spark, sf):
    """SRC10, SRC11: both layouts; what stands beside runs/ doesn't count."""
    nested, flat = _workspace(spark, sf, "runs/"), _workspace(spark, sf, "")
    S.put_files(spark.createDataFrame([("eval-9/new_skill/run-1/grading.json", b"{}")], "path string, content binary"), nested)
    return S.workspace_runs(S.read_files(spark, [nested]), nested).unionByName(S.workspace_runs(S.read_files(spark, [flat]), flat))


@query(f"SELECT eval_dir, configuration, CAST(CASE WHEN configuration = 'notes' THEN 1 ELSE k END AS BIGINT) AS run_number, CAST(k AS BIGINT) AS passed, CAST(k + 1 AS BIGINT) AS total FROM ({_WORKSPACE}) WHERE graded AND valid AND configuration <> 'notes'")
def w2_gradings(spark, sf):
    """SRC12: broken gradings are dropped."""
    g = S.read_gradings(spark, [_workspace(spark, sf, "runs/")]).where("configuration <> 'notes' AND eval_dir LIKE 'eval-%'")
    return g.select("eval_dir", "configuration", F.col("run_number").cast("long").alias("run_number"), F.col("summary.passed").cast("long").alias("passed"), F.col("summary.total").cast("long").alias("total"))


_RUN_DIRS = ["p/", "p/deep/", "skill/", "inputs/", ""]


def _run_folder(spark: SparkSession, sf: str) -> str:
    """Run directories below a workspace whose own path holds a name that isn't searched; some hold runs in their outputs."""
    k = F.col("k")
    run = F.concat(_pick(_RUN_DIRS, k % 5), F.lit("r"), k.cast("string"))
    meta = F.concat(F.lit('{"eval_id": '), k.cast("string"), F.lit(', "prompt": "'), F.when(k % 3 == 0, F.col("name")).otherwise(" "), F.lit('"}'))
    n = _nations(spark, sf).withColumn("run", run)
    file = lambda path, content, where="true": n.where(where).select(F.concat("run", F.lit(path)).alias("path"), content.cast("binary").alias("content"))
    files = file("/outputs/a.txt", F.col("name")).unionByName(file("/outputs/b/outputs/c.txt", F.lit("x"))).unionByName(file("/eval_metadata.json", meta, "k % 2 = 0"))
    files = files.unionByName(file("/outputs/transcript.md", F.concat(F.lit("# t\n## Eval Prompt\n\nsay "), "name", F.lit("\n## Next\n")), "k % 3 <> 2")).unionByName(file("/grading.json", F.lit('{"ok": 1}'), "k % 4 = 0")).unionByName(file("/grading.json", F.lit("{oops"), "k % 4 = 1"))
    return S.put_files(files, new_folder(spark, "inputs") + "/inputs/skill/ws")


@query(f"""SELECT replace({_RUN_DIRS}[1 + n_nationkey % 5] || 'r' || n_nationkey, '/', '-') AS id, CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS BIGINT) AS eval_id,
 CASE WHEN n_nationkey % 6 = 0 THEN n_name WHEN n_nationkey % 3 <> 2 THEN 'say ' || n_name ELSE '(No prompt found)' END AS prompt, CAST(CASE WHEN n_nationkey % 3 <> 2 THEN 2 ELSE 1 END AS BIGINT) AS outputs, n_nationkey % 4 = 0 AS graded FROM nation WHERE n_nationkey % 5 IN (0, 1, 4)""")
def w4_read_runs(spark, sf):
    """SRC13, SRC19, SRC23, STR11, STR16, WIN05: directories of the names that aren't searched are left out below the workspace alone."""
    r = S.read_runs(spark, _run_folder(spark, sf))
    return r.select("id", "eval_id", "prompt", "outputs", F.col("grading").isNotNull().alias("graded"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN NULL ELSE c_mktsegment END AS segment, ['no front matter', 'not a mapping', NULL, NULL][1 + c_custkey % 4] AS error, CAST(CASE WHEN c_custkey % 4 >= 2 THEN c_custkey END AS BIGINT) AS number FROM customer""")
def w4_yaml(spark, sf):
    """SRC16: typed values; texts without front matter, and with a list in it. Rows are dear and their file small, so they are dealt out first."""
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, F.col("c_name")).when(k % 4 == 1, "---\n- a\n- b\n---\n").otherwise(F.concat(F.lit("---\nsegment: '"), "c_mktsegment", F.lit("'\nnumber: "), k.cast("string"), F.lit("\n---\nbody")))
    m = S.parse_yaml(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment").repartition("c_custkey").select("c_custkey", text.alias("text")), keep=("c_custkey",))
    return m.select("c_custkey", F.get_json_object("matter", "$.segment").alias("segment"), "error", F.get_json_object("matter", "$.number").cast("long").alias("number"))


@query("""SELECT n_nationkey AS k, 'Tab ' || n_name AS diagram, 'node' AS kind, n_name AS label FROM nation WHERE n_nationkey % 5 <> 4 UNION ALL SELECT n_nationkey, 'Page 2', 'node', 'end' FROM nation WHERE n_nationkey % 5 <> 4 UNION ALL SELECT n_nationkey, 'Tab ' || n_name, 'edge', 'says' FROM nation WHERE n_nationkey % 5 <> 4""")
def w1_diagram_files(spark, sf):
    """SRC17, XML01, UDF03, GRF01: two tabs a file, the second without a name; broken files have no cells."""
    cell = lambda attributes: F.concat(F.lit("<mxCell "), attributes, F.lit("/>"))
    model = lambda *cells: F.concat(F.lit("<mxGraphModel><root>"), *cells, F.lit("</root></mxGraphModel>"))
    one = model(cell(F.lit('id="0"')), cell(F.concat(F.lit('id="2" value="&lt;b&gt;'), "name", F.lit('&lt;/b&gt;" style="ellipse" parent="1"'))), cell(F.lit('id="3" value="" edge="1" source="2" target="2"')), cell(F.lit('id="4" value="says" connectable="0" parent="3"')))
    xml = F.concat(F.lit('<mxfile><diagram name="Tab '), "name", F.lit('">'), one, F.lit("</diagram><diagram>"), model(cell(F.lit('id="7" value="end"'))), F.lit("</diagram>"), F.when(F.col("k") % 5 == 4, "<").otherwise("</mxfile>"))
    folder = S.put_files(_nations(spark, sf).select(F.concat(F.lit("d"), F.col("k").cast("string"), F.lit(".drawio")).alias("path"), xml.alias("content")), new_folder(spark, "diagrams"))
    cells = stored(S.diagram_cells(S.read_files(spark, [folder], "*.drawio")), "cells")
    key = F.regexp_extract("file", r"d(\d+)\.drawio$", 1).cast("long").alias("k")
    nodes = K.diagram_nodes(cells).select(key, "diagram", F.lit("node").alias("kind"), "label")
    return nodes.unionByName(K.diagram_edges(cells).select(key, "diagram", F.lit("edge").alias("kind"), "label"))


@query("SELECT 's' || n_nationkey AS skill, n_name AS name, 'does ' || n_name AS description FROM nation")
def w4_skill_catalogue(spark, sf):
    """SRC21, SRC15: a folder a skill, other texts beside it."""
    at = F.concat(F.lit("s"), F.col("k").cast("string"))
    text = F.concat(F.lit("---\nname: "), "name", F.lit("\ndescription: |\n  does\n  "), "name", F.lit("\n---\nbody"))
    n = _nations(spark, sf)
    folder = S.put_files(n.select(F.concat(at, F.lit("/SKILL.md")).alias("path"), text.alias("content")).unionByName(n.select(F.concat(at, F.lit("/references/more.md")).alias("path"), F.lit("x").alias("content"))), new_folder(spark, "skills"))
    rows = S.frontmatter_blocks(S.read_texts(spark, [folder], "SKILL.md"))
    return rows.select(F.regexp_extract("path", "([^/]+)/SKILL.md$", 1).alias("skill"), "name", "description")


@query("SELECT p_partkey, p_brand || '/' || p_size || '.txt' AS path, row_number() OVER (ORDER BY p_brand, p_size || '.txt', p_partkey) AS place FROM part")
def w4_path_order(spark, sf):
    """SRT01: places of paths by their components; the sort itself runs over ranges."""
    p = table(spark, sf, "part").select("p_partkey", F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string"), F.lit(".txt")).alias("path"))
    keyed = p.withColumn("o", F.struct(X.path_order(F.col("path")).alias("parts"), "p_partkey"))
    return E.placed(keyed, "o").select("p_partkey", "path", (F.col("place") + 1).alias("place"))


_SUMMARY = " UNION ALL ".join(f"SELECT configuration, '{m}' AS metric, {_STATS.format(c=m)} FROM ({_RUNS}) GROUP BY configuration" for m in E.METRICS)


@query(f"""SELECT upper(substr(configuration, 1, 1)) || substr(configuration, 2) AS configuration, metric, CASE metric WHEN 'pass_rate' THEN printf('%.0f%% ± %.0f%%', mean * 100, stddev * 100) WHEN 'time_seconds' THEN printf('%.1fs ± %.1fs', mean, stddev) ELSE printf('%.0f ± %.0f', mean, stddev) END AS cell FROM ({_SUMMARY})""")
def w2_benchmark_lines(spark, sf):
    """SNK04, STR09, STR10."""
    return W.benchmark_lines(E.summary(_runs(spark, sf)))


@query(f"SELECT configuration, round(max(CASE WHEN metric = 'tokens' THEN mean END), 2) AS tokens, round(max(CASE WHEN metric = 'time_seconds' THEN stddev END), 2) AS spread FROM ({_SUMMARY}) GROUP BY configuration")
def w2_benchmark_json(spark, sf):
    """SNK04: the JSON of each configuration, with numbers read back from it."""
    value = lambda path: F.round(F.get_json_object("json", path).cast("double"), 2)
    return S.benchmark_json(E.summary(_runs(spark, sf))).select("configuration", value("$.tokens.mean").alias("tokens"), value("$.time_seconds.stddev").alias("spread"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CAST(coalesce(n, 0) AS BIGINT) AS files, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS feedback FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def w4_review_data(spark, sf):
    """SNK07, JON10: orders are runs, lineitems their files; blank feedback doesn't count."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), "o_orderpriority", F.col("o_orderkey").alias("k"))
    files = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("run_id"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("path"), F.lit("text").alias("kind"), F.col("l_shipmode").alias("text"), F.lit(None).cast("string").alias("uri")) if "l_shipmode" in table(spark, sf, "lineitem").columns else table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("run_id"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("path"), F.lit("text").alias("kind"), F.col("l_returnflag").alias("text"), F.lit(None).cast("string").alias("uri"))
    feedback = o.select("run_id", F.when(F.col("k") % 3 == 0, F.col("o_orderpriority")).otherwise(" \n").alias("feedback"))
    r = W.review_data(o.select("run_id"), files, feedback)
    return r.select("run_id", F.coalesce(F.json_array_length(F.get_json_object("json", "$.files")), F.lit(0)).cast("long").alias("files"), F.get_json_object("json", "$.feedback").alias("feedback"))


@query("SELECT n_nationkey AS k, n_name AS name FROM nation")
def w3_results_folder(spark, sf):
    """SNK11: results below a folder of their time, read back."""
    path = S.write_results(_nations(spark, sf).select("k", "name"), new_folder(spark, "results"), "2026-01-02_030405")
    return spark.read.schema("k long, name string").json(path)


def _stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"


@query(f"SELECT event_id, {_stamp('ts')} AS at, strftime(ts, '%Y-%m-%d') AS day FROM events")
def w1_time_stamps(spark, sf):
    """DAT01, DAT02: the clock is a parameter; here the events' own times."""
    return table(spark, sf, "events").select("event_id", V.now_iso(F.col("ts")).alias("at"), V.today(F.col("ts")).alias("day"))


@query("SELECT p_partkey, true AS ok FROM part")
def w3_trial_ids(spark, sf):
    """HSH03: eight hex digits; the ids themselves differ from run to run."""
    return table(spark, sf, "part").select("p_partkey", V.random_id().rlike("^[0-9a-f]{8}$").alias("ok"))


@query("SELECT ['factual', 'process', 'quality'][1 + o_orderkey % 3] AS kind, CAST(count(*) AS BIGINT) AS claims, CAST(count(l_orderkey) AS BIGINT) AS verified FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey GROUP BY 1")
def w2_verified_claims(spark, sf):
    """JON12: orders are claims, returned lineitems their evidence."""
    claims = table(spark, sf, "orders").select(F.col("o_orderkey").alias("claim_id"), _pick(["factual", "process", "quality"], F.col("o_orderkey") % 3).alias("kind"))
    return E.verified_claims(claims, table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("claim_id")))


@query("SELECT user_id, CAST(count(DISTINCT md5(event_type)) AS BIGINT) AS n FROM events GROUP BY user_id")
def w1_stream_ingest(spark, sf):
    """STM01, STM06: a file stream in two runs, the second over what has come since; hashes tell what is new."""
    folder = new_folder(spark, "stream")
    e = table(spark, sf, "events").select("user_id", "event_id", F.md5("event_type").alias("hash"))

    def process(batch: DataFrame, epoch: int) -> None:
        seen = spark.read.schema("user_id long, hash string").parquet(f"{folder}/seen")
        batch.select("user_id", "hash").distinct().join(seen, ["user_id", "hash"], "left_anti").write.mode("append").parquet(f"{folder}/seen")

    spark.createDataFrame([], "user_id long, hash string").write.parquet(f"{folder}/seen")
    for half in (0, 1):
        e.where(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{folder}/in")
        T.ingest_batches(spark.readStream.schema("user_id long, event_id long, hash string").parquet(f"{folder}/in"), process, f"{folder}/cp").awaitTermination()
    return spark.read.parquet(f"{folder}/seen").groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT event_type AS query, CAST(count(*) AS BIGINT) AS runs FROM events GROUP BY event_type")
def w3_live_report(spark, sf):
    """STM04, STM05: a report that is written anew with each batch of a stream, and read again."""
    folder = new_folder(spark, "report")
    table(spark, sf, "events").select("event_type").write.parquet(f"{folder}/in")
    counts = spark.readStream.schema("event_type string").parquet(f"{folder}/in").groupBy(F.col("event_type").alias("query")).agg(F.count("*").alias("runs"))
    T.live_report(counts, lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{folder}/out"), f"{folder}/cp").awaitTermination()
    return spark.read.parquet(f"{folder}/out")
