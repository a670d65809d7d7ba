import random

import pytest

from depthframe.llm import lines, queries
from tests.conftest import duck_rows, rows_of


def brute(rows, least):
    sites, first = {}, {}
    for i, t, s in rows:
        for line in (t or "").split("\n"):
            line = line.strip(" ")
            if line:
                sites.setdefault(line, set()).update([s] if s is not None else [])
                if i is not None:
                    first[line] = min(first.get(line, i), i)
    gone = {x for x, s in sites.items() if len(s) >= least}
    return [None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" ") not in gone or (i is not None and i == first.get(x.strip(" ")))) for i, t, s in rows]


@pytest.mark.parametrize("least", [2, 3, 5])
def test_against_brute_force(spark, least):
    rng = random.Random(least)
    pool = [f"line {k}" for k in range(12)] + ["", "  ", " line 1 ", "é"]
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, "\n".join(rng.choices(pool, k=rng.randrange(6)))]), rng.choice([None, "a", "b", "c", "d", "e", "f"])) for _ in range(80)]
    got = lines.clean(spark.createDataFrame(rows, "doc_id long, text string, source string"), least=least).collect()
    key = lambda t: (t is None, t or "")
    assert sorted((r["text"] for r in got), key=key) == sorted(brute(rows, least), key=key)


def test_lines_near_the_threshold_are_counted_exactly(spark, monkeypatch):
    monkeypatch.setattr(lines, "BAND", 0.9)  # nearly every line is near
    rows = [(k, f"only {k}\nshared\n{'rare' if k < 4 else 'more'}", f"s{k % 9}") for k in range(40)]
    got = {r["doc_id"]: r["text"] for r in lines.clean(spark.createDataFrame(rows, "doc_id long, text string, source string"), least=5).collect()}
    assert got == dict(zip(range(40), brute(rows, 5), strict=True)) and got[3] == "only 3\nrare" and got[5] == "only 5"


def test_many_sites_are_estimated(spark):
    rows = [(k, f"everywhere\nonly {k}", f"site{k}") for k in range(3000)]
    got = lines.clean(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert got.where("n_removed = 1").count() == 2999 and got.where("doc_id = 0").first()["text"] == "everywhere\nonly 0"


def test_query_agrees_with_its_sql(spark, duck, sf_dir):
    df = queries.op10_lines(spark, sf_dir)
    assert rows_of(df) == duck_rows(duck, queries.ORACLE["op10_lines"], df.columns)


def test_messy_rows(messy, nothing):
    got = lines.clean(messy, least=1)
    assert sorted(got.columns) == sorted(messy.columns) and got.count() == messy.count()
    assert {r["text"] for r in got.where("doc_id = 1").collect()} == {"hello there world"} and {r["text"] for r in got.where("doc_id is null").collect()} == {"", None}
    assert lines.clean(nothing).count() == 0
