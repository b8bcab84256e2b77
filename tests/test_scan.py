"""Whole scans: every query against its SQL, streams, files of a folder, the entry without the optional part."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as S

from sparkveil.functions import sql as F
from sparkveil.functions.sql import column
from sparkveil.operators.files import keyword_gate
from sparkveil.plans import inputs, queries, scan
from sparkveil.sources.files import from_documents, from_folder
from sparkveil.spec.load import load

from .conftest import SF

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 5) if isinstance(r[i], float) else r[i] for i in order) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, duck, name):
    own = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLE[name])
    assert sorted(own.columns) == sorted(want.columns)
    assert rows(own.columns, own.collect()) == rows(want.columns, want.fetchall())


def test_stream_equals_batch(spark):
    batch = scan.issues(from_documents(spark.read.parquet(f"{SF}/documents.parquet")), queries.planted_rules())
    assert rows(batch.columns, queries.stream_scan(spark, SF).select(batch.columns).collect()) == rows(batch.columns, batch.collect())


def test_scan_has_no_shuffle_and_reads_few_columns(spark):
    plan = queries.issues_flagship(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def _searches(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    return plan.count("regexp_extract_all("), plan.count("regexp_replace(")


def test_candidates_are_searched_once(spark):
    """A search for each of the four rules and the context, and the content made once, whatever fields are wanted."""
    assert _searches(spark, "rule_candidates") == (5, 1) and _searches(spark, "overlap_resolve") == (5, 1)
    assert _searches(spark, "active_rules") == (2, 1)
    assert _searches(spark, "issues_described")[0] == 7


def _issues_without_gate(table, rules):
    gate, scan.files.keyword_gate = scan.files.keyword_gate, lambda *a: F.lit(True)
    try:
        return scan.issues(table, rules)
    finally:
        scan.files.keyword_gate = gate


def test_catalogue_equals_its_rules_one_by_one(spark):
    """The gate for all keywords together lets through what the rules' own would."""
    rules, table = load(), inputs.files(spark, SF).withColumn("lowered", S.lower("content")).cache()
    gate = column(keyword_gate(rules, *map(F.col, ("path", "filename", "language", "file_type", "lowered"))))
    every, some = table.where(gate), table.where(S.greatest(*[S.contains("lowered", S.lit(w)) for w in sorted({k.lower() for r in rules for k in r.pre.include.content})]))
    assert some.count() <= every.count()
    alone = scan.issues(table.drop("lowered"), rules)
    assert alone.where("rule_id is not null").join(every, "doc_id", "left_anti").count() == 0
    assert rows(alone.columns, alone.collect()) == rows(alone.columns, _issues_without_gate(table.drop("lowered"), rules).collect())
    # a table without planted lines is mostly left alone
    pages = inputs.pages(spark, SF).withColumn("lowered", S.lower("content"))
    assert pages.where(gate).count() < pages.count()
    table.unpersist()


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "src" / "sub").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_bytes(b"x = 1\r\ny\xff = 2\n")
    (tmp_path / "src" / "sub" / ".b").write_bytes(b"\x01\x02")
    (tmp_path / "src" / "empty.txt").write_bytes(b"")
    found = {r["path"]: r for r in from_folder(spark, str(tmp_path / "src")).collect()}
    assert set(found) == {"a.py", "sub/.b", "empty.txt"}
    assert found["a.py"]["content"] == "x = 1\ny\ufffd = 2" and found["sub/.b"]["content"] == "" and found["sub/.b"]["is_hidden"]


def test_rejections_are_capped(spark):
    text = "\n".join('token = "' + "a" * 40 + '"' for _ in range(5))
    table = from_documents(spark.createDataFrame([(1, "s", text)], "doc_id long, source string, text string"))
    own = [r for r in queries.planted_rules() if r.id == "planted-hex"]
    assert [r["reason"] for r in scan.rejections(table, own, scan.ScanConfig(log_rejections=2)).collect()] == ["statisticalFilter", "statisticalFilter", "3 more suppressed"]


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, None, None), (1, "s", ""), (2, None, 'token = "' + "0123456789abcdef" * 2 + '01234567"')], "doc_id long, source string, text string")
    assert [r["rule_id"] for r in scan.issues(from_documents(docs), queries.planted_rules()).where("rule_id = 'planted-hex'").collect()] == ["planted-hex"]
    assert scan.issues(from_documents(docs.limit(0)), queries.planted_rules()).count() == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_training_data_operators(tmp_path):
    """As when that subpackage and the pipeline are not there."""
    (tmp_path / "sparkveil").mkdir()
    for p in (ROOT / "sparkveil").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "sparkveil" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'issues_flagship' in q and 'pipeline' not in q and not any(k.startswith('op1') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
