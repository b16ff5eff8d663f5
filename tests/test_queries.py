"""Registered queries against their SQL on the smallest tables, one session for all."""

import os
import random
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from recollect.plans import registry as queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def rows(names, values):
    def shown(v):
        return "%.9g" % v if isinstance(v, float) else str(v)

    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(tuple(shown(r[k]) for k in order) for r in values)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(queries.SQL[name])
    assert got == rows([d[0] for d in found.description], found.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, name):
    assert len(entry.queries()[name](spark, SF).columns) > 1


def test_linked_groups_of_all_lines(spark, tmp_path):
    """Lines of every quantity, a part that most orders share among them, against brute force."""
    rng = random.Random(3)
    lines = [(rng.choice((1, 1, rng.randint(2, 400))), k, float(rng.randint(1, 50))) for k in rng.choices(range(1, 300), k=400)] + [(900, 900, 1.0), (901, 900, 50.0)]
    spark.createDataFrame(lines, "l_partkey long, l_orderkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    label = {x: x for p, o, _ in lines for x in (p, 100_000_000 + o)}
    for _ in label:
        for p, o, _ in lines:
            label[p] = label[100_000_000 + o] = min(label[p], label[100_000_000 + o])
    assert {r.node: r.label for r in entry.queries()["linked_groups"](spark, str(tmp_path)).collect()} == label


def test_normalised_descriptions_of_odd_texts(spark, tmp_path):
    """Letters with no single capital, white space beyond ASCII, folded prefixes, missing texts: as the SQL says."""
    import duckdb

    texts = [None, "", " ", "ßheit, ge", "ŉ a", "ﬁn", "ᾳ b", "ǆ c", "և d", "i\u0307", "x\u0085", "x.\u2028", "a\u00a0\u2003b", "\x0ba", "a\x0bb", "Note that\u00a0y", "make \u017fure w", "Loc\u212a in it", "FYI: ßx?"]
    texts += [chr(k) + "." for k in range(0xA0, 0x3000) if k not in (0x19B, 0x264, 0x1C8A)]  # letters newer than Java's tables
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    df = entry.queries()["normalised_descriptions"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(queries.SQL["normalised_descriptions"]).fetchall())


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_corpus_operators(tmp_path, pipeline):
    """A copy without both folders of the corpus operators, with or without the pipeline's file."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    left_out = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(root, f"{tmp_path}/copy", ignore=left_out)
    said = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), 'pipeline' in q, any(k.startswith('op1_') for k in q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", said], cwd=f"{tmp_path}/copy", env=env, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(queries.QUERIES)), str(len(queries.SQL)), "False", "False"], out.stderr


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
