"""Elements that users mean by an id or a name: one answer for each request.

A name that many elements have gives at most ``most`` candidates, the first ones of
the document; they are chosen before they are gathered, so a name that a third of all
elements have makes no large group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.sources.documents import shared_key

MOST = 20


def resolve(requests: DataFrame, elements: DataFrame, most: int = MOST) -> DataFrame:
    """(request_id, status, element_id, n_matches, candidates, error) of requests
    (request_id, element_id, element_name). An id counts before a name; of elements with
    one id the first one. Status: passed, ambiguous or failed."""
    key = shared_key(requests, elements)
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    asks = requests.select(*key, "request_id", F.when(filled("element_id"), F.col("element_id")).alias("by_id"), F.when(~filled("element_id") & filled("element_name"), F.col("element_name")).alias("by_name"))
    ids = elements.select(*key, F.col("id").alias("by_id")).distinct().withColumn("there", F.lit(True))
    wanted = asks.filter("by_name is not null").select(*key, F.col("by_name").alias("name")).distinct()
    named = elements.select(*key, "id", "name", "type", "ord").join(wanted, [*key, "name"], "left_semi")
    counts = named.groupBy(*key, F.col("name").alias("by_name")).agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy(*key, "name").orderBy("ord", "id"))
    first = named.withColumn("nth", nth).filter(F.col("nth") <= most)
    some = first.groupBy(*key, F.col("name").alias("by_name")).agg(F.array_sort(F.collect_list(F.struct("nth", "id", "name", "type"))).alias("first"))
    out = asks.join(ids, [*key, "by_id"], "left").join(counts, [*key, "by_name"], "left").join(some, [*key, "by_name"], "left")
    n = F.when(F.col("by_id").isNotNull(), F.when(F.col("there"), 1).otherwise(0)).otherwise(F.coalesce("n", F.lit(0)))
    status = F.when(n == 1, "passed").when(n > 1, "ambiguous").otherwise("failed")
    error = (
        F.when(n == 1, None).when(n > 1, F.concat(F.lit("Element name '"), "by_name", F.lit("' matched multiple elements")))
        .when(F.col("by_id").isNotNull(), F.concat(F.lit("Element '"), "by_id", F.lit("' does not exist")))
        .when(F.col("by_name").isNotNull(), F.concat(F.lit("Element name '"), "by_name", F.lit("' does not exist"))).otherwise("elementId or elementName is required")
    )
    none = F.array().cast("array<struct<id:string,name:string,type:string>>")
    told = F.when(n > 1, F.transform("first", lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), x["type"].alias("type")))).otherwise(none)
    found = F.when(n == 1, F.coalesce("by_id", F.element_at("first", 1)["id"]))
    return out.select(*key, "request_id", status.alias("status"), found.alias("element_id"), n.cast("long").alias("n_matches"), told.alias("candidates"), error.alias("error"))
