"""Tables of files made of the tables of documents, pages and conversations, with planted cases.

The documents hold few credentials, no paths and no hidden characters. Every document therefore gets a path
and some planted lines that follow from its id, by one SQL text that Spark and DuckDB read alike. Nothing
is left out: every row and every whole text is part of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import describe

_NL = "chr(10)"
_ID = "CAST(doc_id AS STRING)"
_HEX = f"md5({_ID})"


def _pick(number: str, values: list[str]) -> str:
    """One of the SQL values by a number."""
    return "CASE " + " ".join(f"WHEN {number} % {len(values)} = {i} THEN {v}" for i, v in enumerate(values)) + " ELSE '' END"


_FOLDER = _pick("doc_id", ["'src/main'", "'src/test'", "'docs'", "'lib'", "'app/res/values-pl'", "'.github/workflows'", "'mod/.git'"])
_FILE = _pick("doc_id", ["'/f' || %s || '.py'", "'/f' || %s || '.json'", "'/f' || %s || '.spec.ts'", "'/strings.xml'", "'/f' || %s || '.png'", "'/settings.py'", "'/.env'", "'/' || md5(%s)", "'/test_' || %s || '.go'", "'/f' || %s || '.tar.gz'"]).replace("%s", _ID)

#: What stands in the planted assignment: compliant, repeated, a placeholder, a path, an address, base64.
_SECRET = _pick("doc_id", [f"{_HEX} || substr(md5('x' || {_ID}), 1, 8)", "repeat('a', 40)", f"'example-' || substr({_HEX}, 1, 24)", f"'src/main/' || substr({_HEX}, 1, 8) || '/a/b/c/d'", f"'https://host/' || substr({_HEX}, 1, 20)", "{b64}"])
_HEAD = _pick("doc_id", [f"'user: bob' || {_NL}", "''", f"'user: bob' || repeat({_NL}, 9)", "repeat('x', 1200) || ' user: eve '", f"'user: eve and more' || {_NL} || 'host: h1' || {_NL}"])
_TAIL = _pick("doc_id", [f"{_NL} || 'user: ann'", "' user: ann'", f"repeat({_NL}, 4) || 'user: ann'", "''", f"repeat('.', 300) || 'host: h2 user: zoe'", f"{_NL} || 'host: h3'", "''"])
_HIDDEN = _pick(
    "doc_id",
    ["''", "'a\u202eb'", "'\u2066x\u2069 \u202ay\u202c'", "'\u2067q \u202bw'", "'\U0001f600\u202d\u202cz\u2068'", "'t\U000e0068\U000e0069 u'", "'\U0001f3f4\U000e0067\U000e0062\U000e007f v'", "'s\ufe00\ufe01\ufe02\ufe03\ufe04'", "'r\ufe00\ufe01'", "'\u202c\u2069 none'", "'\U000e0041 one'"],
)
_BYTE = _pick("doc_id", ["''"] * 12 + ["chr(1)"])
_BREAK = _pick("doc_id", [_NL, f"chr(13) || {_NL}", "chr(13)"])


def _raw(b64: str, table: str) -> str:
    text = f"text || {_BREAK} || {_HEAD} || 'token = \"' || {_SECRET.replace('{b64}', b64)} || '\"' || {_TAIL} || {_BREAK} || {_HIDDEN} || {_BYTE} || {_NL}"
    return f"""SELECT doc_id, {_FOLDER} || {_FILE} AS path, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'text' END AS language,
CASE WHEN doc_id % 17 = 0 THEN 'TEST' ELSE 'MAIN' END AS file_type, {text} AS text FROM {table}"""


_PLAIN = f"'{{\"key\":\"' || substr({_HEX}, 1, 20) || '\"}}'"
RAW_SPARK = _raw(f"base64(encode({_PLAIN}, 'utf-8'))", "{documents}")
RAW_DUCKDB = _raw(f"to_base64(encode({_PLAIN}))", "documents")

#: DuckDB's form of the table of files: line ends normalized, and content that is no text emptied.
FILES = rf"""raw AS ({RAW_DUCKDB}), plain AS (SELECT doc_id, path, regexp_extract(path, '[^/]*$') AS filename, language, file_type,
regexp_matches(path, '(^|/)\.[^/]') AS is_hidden, regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '\n\z', '') AS c FROM raw),
files AS (SELECT doc_id, path, filename, language, file_type, is_hidden, CASE WHEN language IS NULL AND regexp_matches(c, '[\x01-\x07\x0E-\x1A\x1C-\x1F]') THEN '' ELSE c END AS content FROM plain)"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, language, file_type, text) of all documents, with what is planted."""
    # the SQL text has braces of its own; only the table's name is to be filled in
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = RAW_SPARK.replace("{documents}", "\0").replace("{", "{{").replace("}", "}}").replace("\0", "{documents}")
    return spark.sql(text, documents=documents)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files."""
    rows = raw(spark, sf_dir)
    kinds = rows.select("doc_id", "path", "text", F.col("language").alias("_language"), F.col("file_type").alias("_type"))
    return describe(kinds, F.col("text"), F.col("_language"), F.col("_type"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All web pages as files of markup, named by their addresses."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.regexp_replace("url", "^[a-z]+://", "").alias("path"), "html")
    return describe(rows, F.col("html"), F.lit("html"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of all conversations as files."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return describe(rows.select(F.xxhash64("conv_id", "turn").alias("doc_id"), F.concat_ws("/", F.lit("conv"), "conv_id", "turn").alias("path"), "text"), F.col("text"))
