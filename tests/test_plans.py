"""Every registered query against its SQL in DuckDB, over whole tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tessella.operators.ingest import companions
from tessella.plans.registry import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    want = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_dear_rows_are_dealt_out(spark, sf):
    """A small file is read by one task; its rows are dealt to others before dear work."""
    for name in ("w4_yaml", "w4_frontmatter"):
        assert "REPARTITION_BY_COL" in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_rules_over_whole_turns(spark, tmp_path):
    """Turns that begin alike, a repeated turn, a marker late in a text, and a cycle, against brute force."""
    long_ = " ".join(f"w{i}" for i in range(60))
    turns = {1: ["the same start a b", "the same start c d", "the other e f", "the same start g h"], 2: [long_, long_ + " more", "x y z"], 3: ["alpha beta", "gamma delta", "alpha beta"], 4: ["one two", "three four and it already handles this"], 5: [f"turn {i}" for i in range(8)]}
    rows = [(c, i, "user", t) for c, x in turns.items() for i, t in enumerate(x)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def end(x):
        for i, t in enumerate(x):
            a, b = set(t.split()), set(x[i - 1].split()) if i else set()
            if "already handles" in t:
                return i, "DEFENSE"
            if i and len(a & b) / len(a | b) > 0.95:
                return i, "CONVERGE"
            if t in x[: max(0, i - 1)]:
                return i, "CYCLE"
            if i >= 6:
                return i, "TIMEOUT"

    got = {r.solution_id: (r.iteration, r.reason) for r in QUERIES["w5_terminations"](spark, tmp_path).collect()}
    assert got == {c: e for c, x in turns.items() if (e := end(x))} and {e[1] for e in got.values()} == {"DEFENSE", "CONVERGE", "CYCLE", "TIMEOUT"}
    got = {r.survey: (r.n, r.duplicates, r.ok) for r in QUERIES["w5_question_rules"](spark, tmp_path).collect()}
    assert got == {c: (len(x), len(x) - len(set(x)), 4 <= len(x) <= 8 and len(x) == len(set(x))) for c, x in turns.items()}


def test_whole_tables_on_both_sides(spark, tmp_path):
    """All languages, ids of equal parity, late differences, and both directions, against brute force."""
    same = "a beginning of more than forty characters, then "
    docs = [(0, "Ein Wort hier", None, "s"), (2, same + "x" * 80, "de", "s"), (4, same + "y" * 80, "en", "s"), (6, "Ein Wort", "en", "s"), (8, same + "x" * 80, "en", "t"), (10, "tail " * 100 + "late", "fr", "t"), (12, None, "en", "t")]
    items = [(0, "ein anderes wort"), (10, "tail"), (99, "only second")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    a, b = ({(i, w) for i, t, *_ in x for w in (t or "").lower().replace(",", " ").split()} for x in (docs, items))
    want = {(d, s): sum(1 for i, _ in x if i == d) for s, x in (("first", a - b), ("second", b - a)) for d in {i for i, _ in x}}
    got = {(r.doc, r.only_in): r.n for r in QUERIES["w4_converter_gaps"](spark, tmp_path).collect()}
    assert got == want and {s for _, s in got} == {"first", "second"}
    sides = [spark.createDataFrame([(s, t) for _, t, _, s in docs], "dir string, stem string")] * 2
    want = {(s, x, y) for _, x, _, s in docs for _, y, _, t in docs if s == t and x and y and (x == y or y.startswith(x[:40]))}
    got = [tuple(r) for r in companions(*sides).select("dir", "video", "subtitle").collect()]
    assert len(got) == len(set(got)) and set(got) == want and ("s", docs[1][1], docs[2][1]) in want
