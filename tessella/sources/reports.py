"""Single-file sinks: small aggregates rendered on the driver, or rows rendered by expressions (SNK04-SNK09)."""

from __future__ import annotations

import html
import io
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.functions.values import head_and_rest
from tessella.operators.validate import left_out_of_package


def benchmark_markdown(summary: DataFrame, deltas: DataFrame) -> str:
    """SNK04, STR09, STR10: a table of metrics by configuration. The input is an aggregate: a row per configuration and metric."""
    rows = summary.orderBy("metric", "configuration").collect()
    configs = sorted({r.configuration for r in rows})
    delta = {r.metric: r.delta for r in deltas.collect()}
    out = ["| Metric | " + " | ".join(c.replace("_", " ").title() for c in configs) + " | Delta |", "|" + "-|" * (len(configs) + 2)]
    for metric in sorted({r.metric for r in rows}):
        cell = {r.configuration: f"{r['mean']:.0%} ± {r.stddev:.0%}" if metric == "pass_rate" else f"{r['mean']:.1f} ± {r.stddev:.1f}" for r in rows if r.metric == metric}
        out.append(f"| {metric} | " + " | ".join(cell.get(c, "-") for c in configs) + f" | {delta.get(metric, 0):+.2f} |")
    return "\n".join(out) + "\n"


def benchmark_lines(summary: DataFrame) -> DataFrame:
    """SNK04, STR09, STR10: configuration, metric, cell: mean and deviation as the report's table shows them; shares in percent, tokens whole."""
    m, d = F.col("mean"), F.col("stddev")
    cell = F.when(F.col("metric") == "pass_rate", X.plus_minus(m, d, percent=True)).when(F.col("metric") == "time_seconds", F.format_string("%.1fs ± %.1fs", m, d)).otherwise(F.format_string("%.0f ± %.0f", m, d))
    return summary.select(X.label(F.col("configuration")).alias("configuration"), "metric", cell.alias("cell"))


def index_text(entries: DataFrame) -> DataFrame:
    """SNK03, LIM01: key, text: a manifest entry's part of the index. entries: key, entry (a struct as manifests have it)."""
    e = lambda f: F.col(f"entry.{f}")
    line = lambda name, f: F.concat(F.lit(f"- **{name}:** "), F.coalesce(e(f), F.lit("unknown")))
    link = lambda name, f: F.when(e(f) != "", F.concat(F.lit(f"- **{name}:** ["), e(f), F.lit("]("), e(f), F.lit(")")))
    images, members = F.coalesce(e("images"), F.array().cast("array<string>")), F.coalesce(e("archive_contents"), F.array().cast("array<string>"))
    shown, more = head_and_rest(images)
    lines = F.concat(
        F.array(F.concat(F.lit("### "), "key"), F.lit(""), line("Status", "status"), line("Source", "source"), line("Processed", "processed_at")),
        F.array_compact(F.array(link("Markitdown", "markitdown"), link("Docling", "docling"), link("Drawio Parsed", "drawio_parsed"), F.when(F.size(images) > 0, F.concat(F.lit("- **Images:** "), F.size(images).cast("string"), F.lit(" WEBP file(s)"))))),
        F.transform(shown, lambda x: F.concat(F.lit("  - ["), x, F.lit("]("), x, F.lit(")"))),
        F.array_compact(F.array(F.when(more > 0, F.concat(F.lit("  - … and "), more.cast("string"), F.lit(" more"))), F.when(F.size(members) > 0, F.concat(F.lit("- **Archive contents:** "), F.size(members).cast("string"), F.lit(" document(s)"))))),
        F.transform(members, lambda x: F.concat(F.lit("  - "), x)),
    )
    return entries.select("key", F.concat(F.array_join(lines, "\n"), F.lit("\n\n")).alias("text"))


def image_report(checked: DataFrame) -> DataFrame:
    """SNK05, AGG11: a line of text per document with its images and their issues in path order."""
    line = F.concat(F.when(F.col("suitable"), "ok ").otherwise("bad "), "path", F.when(F.size("issues") > 0, F.concat(F.lit(": "), F.array_join("issues", ", "))).otherwise(""))
    return checked.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda x: x["line"]), "\n").alias("report"))


def trigger_report(results: DataFrame, queries: list[str], refresh: int | None = 5) -> str:
    """SNK06, STM04, LIM02: HTML of iterations by queries. results: iteration, query, pass, trigger_rate; one row per cell of the report."""
    wide = results.groupBy("iteration").pivot("query", queries).agg(F.first(F.struct("pass", "trigger_rate"))).orderBy("iteration").collect()
    head = "".join(f"<th>{html.escape(q[:60])}</th>" for q in queries)

    def cell(v) -> str:
        return "<td></td>" if v is None else f'<td class="{"pass" if v["pass"] else "fail"}">{v["trigger_rate"]:.2f}</td>'

    body = "".join(f"<tr><td>{r['iteration']}</td>{''.join(cell(r[q]) for q in queries)}</tr>" for r in wide)
    auto = f'<meta http-equiv="refresh" content="{refresh}">' if refresh else ""
    return f"<!DOCTYPE html><html><head>{auto}<title>Triggers</title></head><body><table><tr><th>#</th>{head}</tr>{body}</table></body></html>"


def review_data(runs: DataFrame, files: DataFrame, feedback: DataFrame) -> DataFrame:
    """SNK07: a JSON row per run with its files and last feedback, for a viewer to embed."""
    f = files.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("path", "kind", "text", "uri"))).alias("files"))
    rows = runs.join(f, "run_id", "left").join(feedback.where(X.strip(F.col("feedback")) != "").select("run_id", "feedback"), "run_id", "left")
    return rows.select("run_id", F.to_json(F.struct(*rows.columns)).alias("json"))


def package(files: DataFrame) -> bytes:
    """SNK09: a zip of a package's files (path, content), without what packages leave out. One package fits the driver."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for r in files.where(~left_out_of_package(F.col("path"))).orderBy("path").toLocalIterator():
            z.writestr(r.path, bytes(r.content))
    return out.getvalue()
