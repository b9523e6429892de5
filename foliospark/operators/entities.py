"""Entities of chunks: from a graph's entity store, by its map of chunk ids, to lines in front of chunks.

Entities are rows (pos, entity_name, content, source_id); id_map rows (graph_id, chunk_id).  Entities without a name or
source, and ids that the map doesn't have, are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import headers as H


def id_map(store: DataFrame) -> DataFrame:
    """graph_id and chunk_id of a text store's rows (graph_id, full_doc_id)."""
    return store.filter(F.length("full_doc_id") > 0).select("graph_id", F.col("full_doc_id").alias("chunk_id"))


def inverted(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """chunk_id, name, description, exclusive: a row for each chunk of each entity; exclusive if its source is that chunk
    alone.  Of several entities with a name in a chunk the first counts."""
    w = Window.partitionBy("pos")
    # names and descriptions stay behind while pairs of entity and chunk meet: rows of one pos are told apart by number
    held = entities.select("pos", F.trim("entity_name").alias("name"), H.description_of(F.coalesce("content", F.lit(""))).alias("description"), "entity_name", "source_id").withColumn("nth", F.dense_rank().over(w.orderBy("description", "name")))
    pairs = held.filter((F.length("entity_name") > 0) & (F.length("source_id") > 0)).select("pos", "nth", F.explode(H.fields_of(F.col("source_id"))).alias("graph_id"))
    alone = [F.min(c).over(w) == F.max(c).over(w) for c in ("nth", "chunk_id")]
    at = pairs.join(ids, "graph_id").select("pos", "nth", "chunk_id").withColumn("exclusive", alone[0] & alone[1])
    kinds = held.groupBy("pos").agg(F.array_sort(F.collect_set(F.struct("nth", "name", "description"))).alias("kinds"))
    hits = at.join(kinds, "pos").withColumn("kind", F.element_at("kinds", F.col("nth"))).select("chunk_id", "kind.name", "pos", "nth", "kind.description", "exclusive")
    # all that follows is by chunk, so that its rows move once
    first = F.min(F.struct("pos", "nth", "description", "exclusive")).alias("f")
    return hits.repartition("chunk_id").groupBy("chunk_id", "name").agg(first).select("chunk_id", "name", "f.description", "f.exclusive")


def top(hits: DataFrame, most: int = 5) -> DataFrame:
    """The entities of each chunk to show (a top-n report): exclusive ones first, then shorter names, then by name."""
    w = Window.partitionBy("chunk_id").orderBy(F.desc("exclusive"), F.length("name"), "name")
    return hits.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def entity_topn(mentions: DataFrame, most: int = 5) -> DataFrame:
    """Of plain mentions (chunk_id, entity): those in fewest chunks first, then shorter names, then names in order."""
    spread = mentions.groupBy("entity").agg(F.countDistinct("chunk_id").alias("chunks"))
    held = mentions.select("chunk_id", "entity").distinct().join(spread, "entity")
    w = Window.partitionBy("chunk_id").orderBy("chunks", F.length("entity"), "entity")
    return held.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("chunk_id", "entity", "chunks", "place")


def enriched(chunks: DataFrame, shown: DataFrame, description_most: int = 100) -> DataFrame:
    """chunks (chunk_id, text, …) with the line of their entities in text and an array ``entities``; a line from an
    earlier run is replaced; chunks without entities stay as they are."""
    one = F.struct("place", "name", H.shortened(F.col("description"), description_most).alias("description"), "exclusive")
    lists = shown.groupBy("chunk_id").agg(F.array_sort(F.collect_list(one)).alias("entities"))
    both = chunks.join(lists, "chunk_id", "left")
    named = F.transform("entities", lambda e: F.struct(e["name"].alias("name"), e["description"].alias("description")))
    text = F.when(F.col("entities").isNull(), F.col("text")).otherwise(H.with_entities(H.without_entities(F.col("text")), H.entity_line(named, description_most)))
    return both.withColumn("text", text)


def enrich_stats(rows: DataFrame) -> DataFrame:
    """One row: chunks, those with entities, entities, and their average a chunk."""
    n = F.coalesce(F.size("entities"), F.lit(0))
    return rows.agg(F.count("*").alias("chunks_total"), F.count_if(n > 0).alias("chunks_enriched"), F.coalesce(F.sum(n), F.lit(0)).alias("entities"), F.bround(F.avg(n), 3).alias("avg_entities"))
