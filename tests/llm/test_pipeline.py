"""The pipeline against brute-force versions of its stages, and its defined cases; queries with SQL."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkveil.llm import language_id, mixing, near_dedup, packing, queries

from ..conftest import SF
from .test_language_id import brute_vector
from .test_near_dedup import brute_pairs, roots
from .test_packing import brute as brute_pack

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(8)
    letters = {"en": "theandforwithisofinto", "fr": "lesdesuneauxqueéèpour"}

    def text(lang):
        return " ".join("".join(r.choice(letters[lang]) for _ in range(r.randint(2, 8))) for _ in range(r.randint(15, 90)))

    rows = [(i, text(lang), lang, r.choice("aab")) for i in range(90) for lang in [r.choice(["en", "fr"])]]
    rows += [(200 + i, rows[i][1], *rows[i][2:]) for i in range(10)]
    for i in range(15):
        words = rows[i + 20][1].split()
        words[r.randrange(len(words))] = "zz"
        rows.append((300 + i, " ".join(words), *rows[i + 20][2:]))
    rows += [(400, "12 34 !!", "en", "a"), (401, "", "en", "a"), (402, None, None, None), (403, "qq " * 5000, "en", "b")]
    return [(*row, len(row[1] or "")) for row in rows]


def brute(spark, rows):
    slots, letters = language_id.letter_slots(), language_id.letter_vectors(language_id.DIMS)
    vectors = {i: brute_vector(t, language_id.DIMS, slots, letters) if t else np.zeros(language_id.DIMS) for i, t, *_ in rows}
    protos = {g: sum(vectors[r[0]] for r in rows if r[2] == g) for g in {r[2] for r in rows} - {None}}
    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    kept = [r for r in rows if any(vectors[r[0]]) and max(unit(vectors[r[0]]) @ unit(p) for p in protos.values()) >= language_id.MIN_COSINE]
    first = {}
    for r in sorted(kept):
        first.setdefault(r[1], r)
    kept = sorted(first.values())
    root = roots(brute_pairs([r[:2] for r in kept], near_dedup.THRESHOLD, near_dedup.CHECK))
    kept = [r for r in kept if root.get(r[0], r[0]) == r[0]]
    table = spark.createDataFrame(kept, SCHEMA)
    copies = {r["doc_id"]: r["copies"] for r in mixing.rates(table).collect()}  # held against its own brute force
    order = {r["doc_id"]: r["h"] for r in table.select("doc_id", F.xxhash64(F.lit("pack"), "doc_id").alias("h")).collect()}
    mixed = sorted((order[r[0]], r[0], len(r[1].split())) for r in kept for _ in range(copies[r[0]]))
    return Counter((0, b, offset, mixed[item][1], start, n) for item, b, offset, start, n in brute_pack([n for *_, n in mixed], packing.LENGTH, packing.OPEN))


def test_run_equals_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == brute(spark, rows)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.createDataFrame([(1, "some words in a text", "en", "a", 5, "x"), (2, None, None, None, None, None), (3, "", "en", "a", 0, "y"), (1, "some words in a text", "en", "a", 5, "x"), (4, "some words in one text " * 20000, "en", "a", 5, "")], SCHEMA + ", `key` string")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "mixing", "best-fit packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
        assert stage(spark, docs, "").count() <= docs.count()
        assert stage(spark, docs.limit(0), "").count() == 0


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    own, want = queries.queries()[name](spark, SF), c.sql(queries.oracle_sql()[name])
    assert own.columns == want.columns
    assert sorted(map(tuple, own.collect()), key=str) == sorted(want.fetchall(), key=str)
