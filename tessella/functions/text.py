"""Text expressions (STR, HSH) over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Trims every kind of white space; SQL trim() knows blanks alone."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_tags(c: Column) -> Column:
    """STR01: each tag becomes a blank."""
    return F.regexp_replace(c, "<[^>]+>", " ")


def squeeze(c: Column) -> Column:
    """STR02: runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """STR03: the last extension with its dot, as it stands; empty for none and for dot files."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    name = basename(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(path)))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def path_order(path: Column) -> Column:
    """SRT01: paths sort by their components, so a/b comes before a-b/x."""
    return F.split(path, "/")


def clean_prefix(c: Column, project: str | None = None) -> Column:
    """STR04: without the project's prefix, white space and slashes as single hyphens, none at the ends."""
    if project:
        c = F.regexp_replace(c, rf"^{project}\s*-?\s*", "")
    c = F.regexp_replace(strip(c), r"[\s/\\]+", "-")
    return F.regexp_replace(F.regexp_replace(c, "-{2,}", "-"), "^-+|-+$", "")


def partner_prefix(path: Column, journey: str, regions: list[str], keywords: list[str], generic: list[str], project: str | None = None) -> Column:
    """STR05: a telling directory of the path, by three strategies in order; lists are configuration.

    The directory behind one whose name contains `journey` (behind a region the next one); else the nearest directory
    with a keyword; else the nearest that isn't generic; null if there is none.
    """
    dirs = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    at = F.array_position(F.transform(dirs, lambda d: F.contains(F.lower(d), F.lit(journey))), F.lit(True))
    rest = F.when(at > 0, F.slice(F.split(path, "/"), at.cast("int") + 1, F.size(dirs)))
    first, second = F.get(rest, F.lit(0)), F.get(rest, F.lit(1))
    region = F.coalesce(first.isin(regions), F.lit(False)) & second.isNotNull()
    by_journey = F.when(region, second).otherwise(first)
    near = F.reverse(dirs)
    by_keyword = F.get(F.filter(near, lambda d: F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(F.lower(d), k))), F.lit(0)) if keywords else F.lit(None)
    plain = lambda d: ~F.lower(d).isin(generic) & (~F.startswith(d, F.lit(project)) if project else F.lit(True)) & (d != "")
    by_parent = F.get(F.filter(near, plain), F.lit(0))
    return clean_prefix(F.coalesce(by_journey, by_keyword, by_parent), project)


def unique_name(path: Column, prefix: Column) -> Column:
    """STR06, HSH02: prefix-name, or six hex digits of the parent's MD5 where there is no prefix."""
    return F.concat(F.coalesce(prefix, F.substring(F.md5(parent(path)), 1, 6)), F.lit("-"), basename(path))


def window_name(start: Column, end: Column) -> Column:
    """STR07."""
    return F.format_string("p%03d-%03d", start.cast("int"), end.cast("int"))


def signed(c: Column, digits: int) -> Column:
    """STR08."""
    return F.format_string(f"%+.{digits}f", c.cast("double"))


def plus_minus(mean: Column, deviation: Column, percent: bool = False) -> Column:
    """STR09: percent without decimals, else one decimal."""
    return F.format_string("%.0f%% ± %.0f%%", mean * 100, deviation * 100) if percent else F.format_string("%.1f ± %.1f", mean, deviation)


def label(c: Column) -> Column:
    """STR10."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def run_id(relative: Column) -> Column:
    """STR11."""
    return F.replace(relative, F.lit("/"), F.lit("-"))


def data_uri(mime: Column, content: Column) -> Column:
    """STR13: Spark's base64 breaks lines, data URIs don't."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), "[\r\n]", ""))


def html_escape(c: Column) -> Column:
    """STR14."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def tagged(c: Column, tag: str) -> Column:
    """STR15: the text inside <tag>, else the whole, without white space and quotes around it."""
    inner = F.regexp_extract(c, f"(?s)<{tag}>(.*?)</{tag}>", 1)
    found = F.when(c.rlike(f"(?s)<{tag}>.*?</{tag}>"), inner).otherwise(c)
    return F.regexp_replace(strip(found), '^"+|"+$', "")


def transcript_prompt(c: Column) -> Column:
    """STR16: what follows the prompt heading, up to the next heading."""
    return strip(F.regexp_extract(c, r"(?s)## Eval Prompt\n\n(.*?)(?=\n##|\z)", 1))


def kebab(c: Column) -> Column:
    """STR17: lower-case letters, digits and single hyphens inside."""
    return c.rlike("^[a-z0-9-]+$") & ~c.rlike("^-|-$|--")


def observations(c: Column) -> Column:
    """STR18: (category, statement, tags) of each `- [category] statement #tags` line."""
    lines = F.regexp_extract_all(c, F.lit(r"(?m)^- \[[a-z_]+\] .+$"), F.lit(0))
    return F.transform(
        lines,
        lambda x: F.struct(
            F.regexp_extract(x, r"^- \[([a-z_]+)\]", 1).alias("category"),
            F.regexp_replace(F.regexp_replace(x, r"^- \[[a-z_]+\] ", ""), r"(\s+#[\w-]+)+\s*$", "").alias("statement"),
            F.regexp_extract_all(x, F.lit(r"\s#([\w-]+)"), F.lit(1)).alias("tags"),
        ),
    )


def wiki_links(c: Column) -> Column:
    """STR19: (relation, kind, name) of each `- relation [[Kind - Name]]`."""
    found = F.regexp_extract_all(c, F.lit(r"(\w+) \[\[[^\]]+ - [^\]]+\]\]"), F.lit(0))
    part = lambda x, i: F.regexp_extract(x, r"(\w+) \[\[([^\]]+?) - ([^\]]+)\]\]", i)
    return F.transform(found, lambda x: F.struct(part(x, 1).alias("relation"), part(x, 2).alias("kind"), part(x, 3).alias("name")))


def revisions(c: Column) -> Column:
    """STR20, DAT03: (rev, at, note) of each `[rN] time — note`; the arrow form counts too."""
    pattern = r"\[r(\d+)\] (\S+) [—→] ([^\n]+)"
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    part = lambda x, i: F.regexp_extract(x, pattern, i)
    return F.transform(found, lambda x: F.struct(part(x, 1).cast("int").alias("rev"), F.coalesce(F.try_to_timestamp(part(x, 2)), F.try_to_timestamp(part(x, 2), F.lit("yyyy-MM-dd'T'HH:mmX"))).alias("at"), part(x, 3).alias("note")))


def citations(c: Column) -> Column:
    """STR21: (source, tier) of each `(Source: ..., T#)`."""
    pattern = r"\(Source: ([^()]+), (T[1-4])\)"
    part = lambda x, i: F.regexp_extract(x, pattern, i)
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda x: F.struct(part(x, 1).alias("source"), part(x, 2).alias("tier")))


def cited_claims(c: Column) -> Column:
    """STR21: (claim, name, url) of each `claim — [name](url)`."""
    pattern = r"(?m)^(.+?) — \[([^\]]+)\]\(([^)]+)\)"
    part = lambda x, i: F.regexp_extract(x, pattern, i)
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda x: F.struct(part(x, 1).alias("claim"), part(x, 2).alias("name"), part(x, 3).alias("url")))


def anti_requirements(c: Column) -> Column:
    """STR22: (id, text, source, consequence) of each `[AR-id]: text | Source: ... | Consequence: ...`."""
    pattern = r"\[(AR-[\w-]+)\]: ([^|\n]+?) \| (?:Source: )?([^|\n]+?) \| (?:Consequence: )?([^|\n]+)"
    part = lambda x, i: F.regexp_extract(x, pattern, i)
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda x: F.struct(*[part(x, i + 1).alias(n) for i, n in enumerate(("id", "text", "source", "consequence"))]))


def requirement_kind(c: Column) -> Column:
    """STR23: the prefix of a well-formed requirement or gap id, else null. CON is the older spelling of CTR."""
    kind = F.regexp_extract(c, r"^(FR|NFR|GAP|CTR|CON|AMB)-(?:[A-Z0-9]+-)?\d{2,}$", 1)
    return F.when(kind == "CON", "CTR").when(kind != "", kind)


#: fixed values: phrases by which an author defends a solution, and by which a critique softens
DEFENSE = ("correct because", "already handles", "doesn't apply because", "intentional design choice", "justified by")
HEDGES = ("might benefit from", "could consider", "perhaps", "overall good", "minor")
SLOP = ("it's important to note", "in summary", "in conclusion", "overall,")


def has_any(c: Column, phrases: tuple[str, ...]) -> Column:
    """STR24: whether the text has one of the phrases, whatever the case."""
    low = F.lower(c)
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p))
    return out


def breadcrumbs(c: Column) -> Column:
    """STR25: (kind, payload) of the markers left for the next session."""
    pattern = r"(?:<!-- |# |\{\{)(TODO\(next-agent\)|CONTINUE|HANDOFF|INJECT|PARAM|PIPELINE): *(.+?)(?= -->|\}\}|$)"
    part = lambda x, i: F.regexp_extract(x, pattern, i)
    return F.transform(F.regexp_extract_all(c, F.lit("(?m)" + pattern), F.lit(0)), lambda x: F.struct(part(x, 1).alias("kind"), part(x, 2).alias("payload")))


def argument_kind(c: Column) -> Column:
    """STR26: how a topic argument is given: a flag, a Markdown file, a path, or words."""
    return F.when(c.rlike(r"(^|\s)--file(\s|=)"), "file_flag").when(c.rlike(r"\.md(\s|$)"), "markdown").when(F.contains(c, F.lit("/")), "path").otherwise("topic")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slop_ratio(c: Column) -> Column:
    """STR27: share of lines that are bullets, hold an em dash or a stock phrase; 0 where the text links to a source."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")
    bad = F.filter(lines, lambda x: x.rlike(r"^\s*[-*•] ") | F.contains(x, F.lit("—")) | has_any(x, SLOP))
    return F.when(c.rlike("https?://"), 0.0).when(F.size(lines) > 0, F.size(bad) / F.size(lines)).otherwise(0.0)


def default_description(path: Column) -> Column:
    """STR29."""
    return F.replace(F.replace(stem(path), F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" "))


def with_year(template: Column, year: Column | None = None) -> Column:
    """STR28; the year is a parameter so that results can be tested."""
    return F.replace(template, F.lit("{current_year}"), (year if year is not None else F.year(F.current_date())).cast("string"))


def cut(c: Column, n: int) -> Column:
    """LIM02: a text for a report, cut to n characters."""
    return F.substring(c, 1, n)
