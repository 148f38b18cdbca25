"""Trees of blocks over parts.

Eighty parts in a row are a document whose blocks are a ternary tree: block 0 is the page, block 1 a table of the cells 4
to 6, block 13, in the first of these, a table of the cells 40 to 42. Even documents name children, odd ones parents. Of
sixteen documents in a row all but two or three have a fault of one kind each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import trees
from .tables import oracle, table

#: Parts as blocks: kinds go round by place; every seventh text has a mark that tables escape.
BLOCKS = """n AS (SELECT CAST(floor(p_partkey / 80) AS bigint) AS doc, CAST(p_partkey % 80 AS int) AS k, p_name FROM {part}),
b AS (SELECT doc, k, CASE WHEN doc % 16 = 6 THEN k - 1 ELSE CAST(floor((k - 1) / 3) AS int) END AS up, p_name || CASE WHEN k % 7 = 0 THEN ' | x' ELSE '' END AS text,
  CASE WHEN k = 0 THEN 1 WHEN doc % 16 <> 6 AND k IN (1, 13) THEN 31 WHEN doc % 16 <> 6 AND k IN (4, 5, 6, 40, 41, 42) THEN 32
    WHEN k % 6 = 0 THEN 2 WHEN k % 6 = 1 THEN 3 + k % 9 WHEN k % 6 = 2 THEN 12 WHEN k % 6 = 3 THEN 15 WHEN k % 6 = 4 THEN 14 ELSE 19 END AS kind
  FROM n WHERE doc IN (SELECT doc FROM n GROUP BY doc HAVING count(*) = 80))"""

DOCUMENTS = f"""WITH {BLOCKS},
c AS (SELECT doc, up AS k, transform(array_sort(collect_list(k)), x -> concat('n', x)) AS names FROM b WHERE k > 0 GROUP BY doc, up),
j AS (SELECT b.doc, b.k, to_json(named_struct('block_id', concat('n', b.k), 'block_type', kind, 'parent_id', CASE WHEN b.k > 0 THEN concat('n', up) END,
    'children', CASE WHEN b.doc % 16 = 1 AND b.k = 0 THEN concat(names, array('gone')) WHEN b.doc % 16 = 2 AND b.k = 1 THEN concat(names, array('n0')) WHEN b.doc % 16 = 3 AND b.k = 0 THEN concat(names, array('n3')) WHEN b.doc % 2 = 0 THEN names END,
    'table', CASE WHEN kind = 31 THEN named_struct('cells', CASE WHEN b.doc % 16 = 7 THEN array('n4', 'n5', 'gone') END,
      'property', named_struct('column_size', CASE b.doc % 16 WHEN 8 THEN '0' WHEN 9 THEN 'wide' WHEN 10 THEN '2' ELSE '3' END)) END,
    'text', named_struct('elements', array(named_struct('text_run', named_struct('content', substring(text, 1, 5)), 'equation', NULL), named_struct('text_run', NULL, 'equation', named_struct('content', substring(text, 6)))))), map('ignoreNullFields', 'false')) AS block
  FROM b LEFT JOIN c ON c.doc = b.doc AND c.k = b.k),
a AS (SELECT doc, array_join(transform(array_sort(collect_list(struct(k, block))), x -> x.block), ',') AS blocks FROM j GROUP BY doc)
SELECT concat('d', doc) AS doc, CASE WHEN doc % 16 = 14 THEN '[]' ELSE concat('[', blocks, CASE doc % 16
  WHEN 4 THEN ',{{{{"block_id":"x","parent_id":"lost","block_type":2}}}}' WHEN 5 THEN ',{{{{"block_id":"x","parent_id":"n79","block_type":15}}}}'
  WHEN 11 THEN ',{{{{"block_id":"x","parent_id":"n79","block_type":30,"sheet":{{{{"token":"bad"}}}}}}}}' WHEN 12 THEN ',{{{{"block_id":"x","parent_id":"","block_type":30,"sheet":{{{{"token":"a_b"}}}}}}}}'
  WHEN 15 THEN ',"oops"' ELSE '' END, ']') END AS blocks FROM a"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DOCUMENTS, part=table(spark, sf_dir, "part"))


def block_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.flattened(documents(spark, sf_dir), "doc", "blocks")


QUERIES = {"block_trees": block_trees}

#: By the fault of a document: the error that it makes.
ERROR = """CASE doc % 16 WHEN 1 THEN 'block_child_missing' WHEN 2 THEN 'blocks_root_missing' WHEN 3 THEN 'blocks_duplicate_or_cycle' WHEN 4 THEN 'unreachable_document_blocks'
  WHEN 5 THEN 'unsupported_empty_block_quote' WHEN 6 THEN 'blocks_depth_exceeded' WHEN 7 THEN 'table_cell_missing' WHEN 8 THEN 'table_structure_missing' WHEN 9 THEN 'table_structure_missing'
  WHEN 10 THEN 'table_cells_incomplete' WHEN 11 THEN 'embedded_sheet_token_invalid' WHEN 12 THEN 'embedded_sheet_unavailable' WHEN 14 THEN 'blocks_unavailable' WHEN 15 THEN 'block_malformed' END"""

LINE = "'| ' || string_agg(text, ' | ' ORDER BY k) || ' |' || chr(10) || '| --- | --- | --- |'"

SQL = {
    "block_trees": oracle(f"""WITH RECURSIVE {BLOCKS}, e AS (SELECT *, {ERROR} AS error FROM b),
      r AS (SELECT doc, k, kind, text, [k] AS path FROM e WHERE error IS NULL AND k = 0 UNION ALL SELECT e.doc, e.k, e.kind, e.text, list_append(r.path, e.k) FROM e JOIN r ON e.doc = r.doc AND e.up = r.k AND e.k > 0),
      i AS (SELECT doc, k, replace(text, '|', chr(92) || '|') AS text FROM r WHERE k IN (40, 41, 42)), t AS (SELECT doc, {LINE} AS text FROM i GROUP BY doc),
      c AS (SELECT r.doc, r.path[3] AS k, replace(replace(string_agg(CASE WHEN r.k = 13 THEN t.text ELSE r.text END, '<br>' ORDER BY path), '|', chr(92) || '|'), chr(10), '<br>') AS text
        FROM r JOIN t ON t.doc = r.doc WHERE len(path) > 2 AND path[2] = 1 AND r.k NOT IN (40, 41, 42) GROUP BY ALL), u AS (SELECT doc, {LINE} AS text FROM c GROUP BY doc),
      p AS (SELECT r.doc, path, CASE WHEN r.k = 1 THEN 'table' WHEN kind BETWEEN 3 AND 11 THEN 'heading' WHEN kind = 12 THEN 'list' WHEN kind = 15 THEN 'quote' WHEN kind = 14 THEN 'code' ELSE 'paragraph' END AS type,
        CASE WHEN r.k <> 1 AND kind BETWEEN 3 AND 11 THEN least(kind - 2, 6) END AS level, CASE WHEN r.k = 1 THEN u.text ELSE r.text END AS text FROM r JOIN u ON u.doc = r.doc WHERE r.k > 0 AND (path[2] <> 1 OR r.k = 1))
      SELECT 'd' || doc AS doc, row_number() OVER (PARTITION BY doc ORDER BY path) - 1 AS pos, type, level, text, NULL AS error FROM p
      UNION ALL SELECT DISTINCT 'd' || doc, 0, NULL, NULL, NULL, error FROM e WHERE error IS NOT NULL"""),
}
