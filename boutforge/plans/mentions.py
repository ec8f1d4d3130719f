"""Names in all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mentions
from .registry import query
from .testdata import table

#: A benchmark item's words of at least six letters, and its first three words as one name.
_NAMES_SQL = """n AS (SELECT DISTINCT unnest(list_append(regexp_extract_all(text, '[[:alpha:]]{6,}'), regexp_extract(text, '^[^ \\n]+ [^ \\n]+ [^ \\n]+'))) AS name FROM benchmark)"""


def _names(spark, sf_dir):
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), 0)
    first = F.regexp_extract("text", "^[^ \\n]+ [^ \\n]+ [^ \\n]+", 0)
    return table(spark, sf_dir, "benchmark").select(F.explode(F.array_append(words, first)).alias("name")).distinct()


@query(rf"""WITH {_NAMES_SQL}, m AS (SELECT doc_id, name, strpos(text, name) - 1 AS place, CAST((length(text) - length(replace(text, name, ''))) / length(name) AS BIGINT) AS apart FROM documents, n WHERE name <> '' AND contains(text, name))
SELECT doc_id, CAST(place AS INTEGER) AS place, name, CAST(chip AS INTEGER) AS chip FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place, length(name) DESC, name) AS chip FROM m) WHERE chip <= 3""")
def named_in_documents(spark, sf_dir):
    """The first three names of each document, of all that any benchmark item holds."""
    found = mentions.places(table(spark, sf_dir, "documents"), "doc_id", "text", _names(spark, sf_dir))
    return mentions.chips(found, "doc_id").select("doc_id", "place", "name", "chip")


@query(r"""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part), t AS (SELECT p_partkey, p_name, unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT p_partkey, word AS name, CAST(count(*) AS INTEGER) AS times FROM t JOIN w ON word = w.name WHERE word <> '' GROUP BY ALL""")
def words_of_part_names(spark, sf_dir):
    """Whole words only: names of which thousands begin alike, in texts that all hold some."""
    parts = table(spark, sf_dir, "part")
    words = parts.select(F.explode(F.split("p_name", " ")).alias("name"))
    return mentions.places(parts, "p_partkey", "p_name", words, whole=True).select("p_partkey", "name", "times")
