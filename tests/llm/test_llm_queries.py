"""Every registered query of the package and the pipeline on the smallest data set, against SQL or plain rules."""

import duckdb
import pytest
from pyspark.sql import functions as F

import check
import corpus_pipeline
from sojourn.llm import decontaminate, packing, queries, scoring, similar, substrings
from tests.llm import rules

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, sql, name):
    found = queries.QUERIES[name](spark, DATA)
    want = sql.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(names)
    assert check.rows_of(found.columns, [tuple(r) for r in found.collect()]) == check.rows_of(names, want.fetchall())


OTHERS = [n for n in sorted(queries.QUERIES) if n not in queries.ORACLES and not n.startswith("op3")]


@pytest.mark.parametrize("name", OTHERS)
def test_other_queries_give_each_row(spark, sql, name):
    table, key = ("pages", "page_id") if name.startswith("op10") else ("documents", "doc_id")
    found = queries.QUERIES[name](spark, DATA).collect()
    assert sorted(r[key] for r in found) == sorted(x for x, in sql.execute(f"SELECT {key} FROM {table}").fetchall())
    if "score" in found[0].__fields__ and not name.startswith("op1_"):
        assert all(0 <= r.score <= 1 for r in found)


def test_stages_equal_plain_rules(spark, sql):
    rows = sql.execute("SELECT doc_id, text FROM documents").fetchall()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumns({c: F.lit("x") for c in ("found", "match", "parsed", "_hash", "h", "row")})
    benchmark = sql.execute("SELECT item_id, text FROM benchmark").fetchall()
    texts = {d: t for d, t in rows if any(c.isalpha() for c in t or "")}
    wanted = []
    for number in range(4):
        if number == 1:
            groups = rules.jaccard_groups(list(texts.items()), 5, 80)
            texts = {d: t for d, t in texts.items() if groups[d][1] == d}
        elif number == 2:
            cut = {}
            first = {}
            for d, t in texts.items():
                w = rules.SPACED.findall(t or "")
                for i in range(len(w) - 49):
                    first[tuple(w[i:i + 50])] = min(first.get(tuple(w[i:i + 50]), d), d)
            for d, t in texts.items():
                w = rules.SPACED.findall(t or "")
                gone = {j for i in range(len(w) - 49) if first[tuple(w[i:i + 50])] < d for j in range(i, i + 50)}
                if not gone or len(gone) < len(w):
                    cut[d] = t if not gone else " ".join(x for i, x in enumerate(w) if i not in gone)
            texts = cut
        elif number == 3:
            texts = {d: texts[d] for d, *_, bad in rules.leaks(list(texts.items()), benchmark) if not bad}
        wanted.append(dict(texts))
    for (name, stage), want in zip(corpus_pipeline.STAGES, wanted):
        columns = docs.columns
        docs = stage(spark, docs, DATA).checkpoint()
        assert docs.columns == columns, name
        assert {r.doc_id: r.text for r in docs.collect()} == want, name
    pieces = corpus_pipeline.sequences(spark, docs, DATA).collect()
    assert {p.doc_id for p in pieces} == set(wanted[-1])
    for d in list(wanted[-1])[:20]:
        own = sorted((p.start, p.length, p.doc_tokens) for p in pieces if p.doc_id == d)
        assert [s for s, _, _ in own] == [sum(n for _, n, _ in own[:i]) for i in range(len(own))] and own[0][2] == sum(n for _, n, _ in own)


def test_rows_that_were_once_wrong(spark, documents, prose):
    # An id with a copied text and another one: passages of the other are still found.
    a, b = prose(1, 100), prose(2, 80)
    x = prose(3, 20)
    out = substrings.parse(documents([(1, a), (2, a), (2, b), (3, b + " " + x)]).withColumn("parsed_at", F.lit(1)))
    assert sorted((r.doc_id, r.parsed.n_removed) for r in out.collect()) == [(1, 0), (2, 0), (2, 100), (3, 80)] and "parsed_at" in out.columns
    # An item without an id is searched for all the same.
    items = spark.createDataFrame([(None, prose(4, 12)), ("k", prose(5, 12))], "item_id string, text string")
    docs = documents([(1, "so " + prose(4, 12)), (2, prose(5, 12)), (3, prose(6, 12))]).withColumn("match_before", F.lit(1))
    for size in (decontaminate.BLOCK_BYTES, 40):
        found = {r.doc_id: r for r in decontaminate.search(docs, items, block_bytes=size).collect()}
        assert [(found[d].match.n_hit, found[d].match.n_items, found[d].match.contaminated) for d in (1, 2, 3)] == [(12, 0, True), (12, 1, True), (0, 0, False)]
    # Rows without an id are told apart by their whole text.
    rows = [(None, " ".join(["w"] * (i % 97) + [f"x{i}"])) for i in range(400)]
    got = scoring.score(documents(rows), documents(rows[:50])).select("n_tokens").collect()
    assert sorted(r.n_tokens for r in got) == sorted(i % 97 + 2 for i in range(400))
    # Letters in patterns that a polynomial hash cannot tell apart.
    word, other = "a", "b"
    for _ in range(10):
        word, other = word + other, other + word
    assert len(word) == 1024 and word != other
    pieces = {r.doc_id: r.ids_crc32 for r in packing.pack(documents([(1, word), (2, other)]), queries.tokenizer_path()).collect()}
    assert pieces[1] != pieces[2]
    clash = documents([(1, a), (2, a)]).withColumns({c: F.lit(1) for c in ("_hash", "_key", "_none", "h", "i", "none", "row")})
    assert [r.doc_id for r in similar.one_of_each(clash).collect()] == [1]
