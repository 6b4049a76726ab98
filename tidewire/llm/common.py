"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def map_rows(df: DataFrame, columns: list[str], fn: Callable[..., dict[str, list]], schema: str) -> DataFrame:
    """Run `fn(*columns as lists)` on Arrow batches; it returns the output columns as lists.

    Batches are bounded in rows and bytes by the session, so memory does not
    depend on the partition's size.
    """
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = fn(*[batch.column(c).to_pylist() for c in columns])
                yield pa.RecordBatch.from_pydict({n: made[n] for n in arrow.names}, schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def documents_like(text: str = "text", key: str = "doc_id"):
    """The two columns an operator needs; names that clash with its own never get in."""
    return [F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")]


def lowest_hashes(rows: int, of: int) -> int:
    """The 64-bit hash below which about `rows` of `of` rows lie."""
    return -(1 << 63) + min((1 << 64) - 1, int(rows / max(1, of) * (1 << 64)))


def all_pairs_sql(words: int, percent: int, columns: str) -> str:
    """DuckDB SQL of the components by an inverted list of whole shingles."""
    return f"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingled AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {words}
        THEN list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM worded),
ids AS (SELECT doc_id, hash(s) AS h, s FROM shingled),
sizes AS (SELECT doc_id, count(*) AS n FROM ids GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM ids a JOIN ids b ON a.h = b.h AND a.s = b.s AND a.doc_id < b.doc_id
        GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * common >= {percent} * (p.n + q.n - common)),
edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS node, doc_id AS c FROM sizes
        UNION SELECT e.y, r.c FROM reach r JOIN edges e ON e.x = r.node WHERE r.c < e.y),
best AS (SELECT node, min(c) AS c FROM reach GROUP BY node),
out AS (SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(b.c, d.doc_id)::BIGINT AS component_id FROM documents d
        LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN best b ON b.node = d.doc_id)
SELECT {columns} FROM out
"""
