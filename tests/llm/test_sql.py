"""The SQL of every corpus query against the query, on tables with quotes, nulls, ties and repeats, and on the given ones."""

import tempfile

import duckdb
import numpy as np
import pytest

from runscope.llm.queries import ORACLE_SQL, QUERIES

from .test_lines import made


def conversations(rng):
    rows = []
    words = [f"w{i}" for i in range(40)]
    for conv in range(30):
        said = []
        for turn in range(int(rng.integers(1, 12))):
            own = "\n".join(" ".join(rng.choice(words, int(rng.integers(1, 7)))) for _ in range(int(rng.integers(1, 4))))
            quotes = []
            for _ in range(int(rng.integers(0, 3)) if said else 0):
                old = said[int(rng.integers(len(said)))]
                lines = old.split("\n")
                lines = lines if rng.random() < 0.5 else lines[:1]
                mark = str(rng.choice(["> ", ">", ">> ", "> > ", " >"]))
                quotes.append("\n".join(mark + (x.upper() if rng.random() < 0.3 else x.replace(" ", "  ")) for x in lines))
            text = "\n".join([*quotes, own]) if rng.random() < 0.8 else "\n".join([own, *quotes])
            said.append(text)
            rows.append((conv, turn, str(rng.choice(["user", "assistant"])), None if rng.random() < 0.05 else text))
    rows += [(None, 1, "user", "> w1"), (99, None, "user", "> w1"), (98, 0, None, "> nothing like it\n>> at all"), (97, 0, "user", ""), (97, 1, "user", ">"), (96, 0, "user", "x" * 50_000), (96, 1, "user", "> " + "X" * 50_000)]
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(9)
    where = tempfile.mkdtemp()
    texts = [t for _, t in made(31, 150, longest=60)]
    items = [" ".join(f"b{i}" for i in range(14)), "b3 b4 b5", "B1 b2-b3", None, "", "w1 w2", " ".join(f"b{i}" for i in range(14))]
    texts += [None, "", "...", "so b0 b1 b2 b3 b4 b5 b6 b7 b8 b9, b10 then", "B3 B4 b5 b3 b4 b5", "w1 " * 3000, texts[0] + "\n" + texts[1] + "\n" + texts[2]]
    docs = [(int(i), t, "en", "s", len(t or "")) for i, t in zip(rng.permutation(2 * len(texts)), texts, strict=False)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    vectors = np.round(rng.normal(size=(220, 3)), 1)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    rows += [(1000, None, 0), (1050, [1.0, None, 2.0], 0), (1100, [float("inf"), 0.0, 0.0], 0), (1150, [float("nan")] * 3, 0), (1200, [1e3, -1e3, 1e3], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{where}/embeddings.parquet")
    spark.createDataFrame(conversations(rng), "conv_id long, turn long, role string, text string").write.parquet(f"{where}/conversations.parquet")
    pages = [(int(i), f"http://a/{i}", t) for i, t in enumerate([*texts[:60], *texts[:5], None, "", "WARC/1.1\r\n\r\n"])]
    spark.createDataFrame([*pages, (None, None, texts[0])], "page_id long, url string, html string").write.parquet(f"{where}/pages.parquet")
    return where


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equal_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, tables)
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    rel = con.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(repr([r[i] for i in at]) for r in rel.fetchall())
    assert len(got) > 5
    if name == "op6_chat":
        assert df.where("parent_turn is not null").count() > 30


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equal_sql_on_the_given_tables(same_as_sql, name):
    same_as_sql(QUERIES[name], ORACLE_SQL[name])
