"""Language ID: held-out accuracy, brute-force vectors, defined cases."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sparkveil.llm import language_id as li

from ..conftest import SF


def brute_vector(text, dims, slots, letters):
    own = [0] + [slots[ord(c)] if ord(c) < 0x10000 else 0 for c in text.lower()] + [0]
    runs = [s for i, s in enumerate(own) if s or i == 0 or own[i - 1]]
    v = np.zeros(dims)
    for a, b, c in zip(runs, runs[1:], runs[2:]):
        if a + b:
            v += letters[0][a].astype(int) * letters[1][b] * letters[2][c]
    return v


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, held = docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 4 = 0")
    rows = li.language_id(held, li.prototypes(train)).where("accepted and length(lang) > 0").collect()
    assert np.mean([r["lang"] == r["predicted"] for r in rows]) > 0.97


def test_cosines_equal_brute_force(spark):
    dims = 256
    slots, letters = li.letter_slots(), li.letter_vectors(dims)
    rows = [(1, "The quick brown fox", "en"), (2, "Die Brücke über den Fluß", "de"), (3, "the lazy dog's 3 bones", "en"), (4, "l'été à la plage", "fr")]
    protos = {}
    for _, text, lang in rows:
        protos[lang] = protos.get(lang, np.zeros(dims)) + brute_vector(text, dims, slots, letters)
    protos = {k: v / np.linalg.norm(v) for k, v in sorted(protos.items())}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = li.prototypes(docs, dims)
    assert list(found) == list(protos)
    for k in protos:
        assert np.allclose(found[k], protos[k])
    for r in li.language_id(docs, found, dims).collect():
        v = brute_vector(rows[r["doc_id"] - 1][1], dims, slots, letters)
        c = {k: float(v @ p / np.linalg.norm(v)) for k, p in protos.items()}
        assert r["predicted"] == max(c, key=c.get)
        assert r["cosine"] == pytest.approx(max(c.values()), abs=1e-5)


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = docs.where("n_chars > 200 and text rlike '[a-z]{3}'")
    assert li.keep_languages(docs).join(clean.select("doc_id"), "doc_id").count() >= 0.98 * clean.count()


def test_defined_cases(spark):
    rows = [(1, "plain words in a line of text", "en", "a", 1), (2, None, "en", None, 2), (3, "", "en", "", 3), (4, "1234 5678 !!!", "en", "", 4), (5, "more plain words in lines", None, "", 5), (1, "plain words in a line of text", "en", "a", 1), (None, "plain words in a line", "en", "", 6), (7, "plain words in a line of text " * 40000, "en", "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, predicted string, cosine int")
    kept = li.keep_languages(docs)
    assert kept.schema == docs.schema
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 1, 5, 7]
    judged = li.language_id(docs)
    assert judged.count() == len(rows) and judged.where("not accepted and predicted is not null").count() == 0
    assert li.keep_languages(docs.limit(0)).count() == 0
    assert li.keep_languages(docs.where("lang is null")).count() == 0  # no prototype
    assert li.keep_languages(docs, ["de"]).count() == 0


def test_ties_go_to_the_first_language(spark):
    rows = [(1, "same text for both", "b"), (2, "same text for both", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["predicted"] for r in li.language_id(docs).collect()} == {"a"}


def test_gibberish_and_other_languages_are_rejected(spark):
    r = random.Random(4)
    scripts = ["abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя", *("".join(map(chr, range(a, a + 150))) for a in (0x4E00, 0xAC00))]
    rows = [(i, " ".join("".join(r.choice(s) for _ in range(r.randint(2, 9))) for _ in range(n)), None) for i, (s, n) in enumerate((s, n) for s in scripts for n in (30, 300) for _ in range(40))]
    rows += [(1000, "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", None), (1001, "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền", None)]
    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = li.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), li.prototypes(train))
    assert found.where("accepted").count() <= 0.01 * len(rows)
    short = train.where("text rlike '[a-z]{3}'").selectExpr("doc_id", "array_join(slice(split(text, ' '), 1, 3), ' ') as text", "lang").where("text rlike '[a-z]{3}'")
    assert li.language_id(short, li.prototypes(train)).where("accepted").count() >= 0.95 * short.count()


@pytest.mark.parametrize("block", [1, 2, 7, 100])
def test_blocks_of_a_long_text_count_alike(block):
    r = random.Random(block)
    text = "".join(r.choice("abc  é中\U00010400!") for _ in range(500))
    data = np.frombuffer(text.encode(), np.uint8)
    _, tri, n = li.long_counts(data, li.letter_slots(), block)
    _, want, m = li.trigram_counts(pa.array([text], pa.large_string()), li.letter_slots())
    assert (tri == want).all() and (n == m).all()


def test_letters_beyond_the_basic_plane_and_invalid_languages(spark):
    rows = [(i, "".join(chr(0x10428 + (7 * k * (i + 1)) % 9 + k % 5) + " " * (k % 4 == 0) for k in range(80)), b"ds\xff") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang binary").selectExpr("doc_id", "text", "cast(lang as string) lang")
    assert {r["predicted"] for r in li.language_id(docs).collect()} == {"ds�"}
