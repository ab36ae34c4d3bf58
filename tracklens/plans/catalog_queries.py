"""Folders, shortcuts, selections, aliases and error tails: pages are files, their hosts and languages folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog
from .queries import query, table

_PATHS = "f AS (SELECT page_id, '/' || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)"
_TREE = rf"""{_PATHS}, p AS (SELECT page_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM f),
i AS (SELECT DISTINCT '/' || array_to_string(p[1:k - 1], '/') AS dir, CASE WHEN k > 1 THEN '/' || array_to_string(p[1:k - 2], '/') END AS parent, p[k] AS name, '/' || array_to_string(p[1:k], '/') AS path, k < len(p) AS is_dir FROM p, unnest(range(1, 100)) AS g(k) WHERE k <= len(p))"""


def _files(s, d) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(s, d, "pages").select("page_id", F.concat(F.lit("/"), bare).alias("path"))


@query("browse_tree", f"WITH {_TREE} SELECT * FROM i")
def _(s, d):
    return catalog.tree(_files(s, d))


@query("browse_shortcuts", rf"""WITH {_TREE}, s AS (SELECT page_id AS ord, page_id % 3 AS source, CASE WHEN page_id % 2 = 0 THEN '/' || string_split(path, '/')[2] ELSE path END AS path FROM f),
u AS (SELECT path, arg_min('l' || ord, source * 1000000000 + ord) AS label, ['home', 'removable', 'camera'][min(source) + 1] AS kind FROM s GROUP BY path)
SELECT label, path, kind FROM u WHERE path IN (SELECT path FROM i WHERE is_dir)""")
def _(s, d):
    files = _files(s, d)
    own = files.select(F.concat(F.lit("l"), "page_id").alias("label"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/"), F.split("path", "/")[1])).otherwise(F.col("path")).alias("path"), F.col("page_id").alias("ord"))
    return catalog.shortcuts([own.where(F.col("ord") % 3 == k).withColumn("kind", F.lit(kind)) for k, kind in enumerate(("home", "removable", "camera"))], catalog.tree(files))


@query("selection", f"WITH {_PATHS} SELECT page_id, path FROM f WHERE path IN (SELECT path FROM f JOIN pages USING (page_id) WHERE contains(url, '?'))")
def _(s, d):
    files = _files(s, d)
    marked = table(s, d, "pages").where(F.contains("url", F.lit("?"))).select("page_id")
    return catalog.selected(files, files.join(marked, "page_id")).select("page_id", "path")


@query("first_present_alias", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_type WHEN 2 THEN p_brand END AS value FROM part")
def _(s, d):
    k = F.col("p_partkey") % 4
    m = F.when(k == 0, F.create_map(F.lit("fixed"), "p_type", F.lit("fps"), "p_brand")).when(k == 1, F.create_map(F.lit("rate"), "p_type")).when(k == 2, F.create_map(F.lit("fps"), "p_brand", F.lit("rate"), "p_type")).otherwise(F.create_map(F.lit("other"), "p_name"))
    return table(s, d, "part").select("p_partkey", catalog.first_present(m, "fps", "rate").alias("value"))


@query("job_error_tail", """WITH l AS (SELECT user_id AS job, event_id, event_type || ' of ' || repeat('x', CAST(event_id % 50 AS INTEGER)) || ' at ' || event_id AS line, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
SELECT job, right(array_to_string(list(line ORDER BY event_id), chr(10)), 800) AS tail FROM l WHERE r <= 40 GROUP BY job""")
def _(s, d):
    e = table(s, d, "events")
    line = F.concat("event_type", F.lit(" of "), F.repeat(F.lit("x"), (F.col("event_id") % 50).cast("int")), F.lit(" at "), "event_id")
    return catalog.error_tail(e.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), line.alias("line")))
