"""Readers and the adapters that give tables the shape of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id and markdown: a line ``[MM:SS] role: text`` a turn, seven seconds a turn, in order of turn."""
    sec = F.col("turn") * 7
    stamp = F.format_string("[%02d:%02d] ", F.floor(sec / 60), sec % 60)
    line = F.concat(stamp, F.coalesce("role", F.lit("")), F.lit(": "), F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "))
    turns = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return conversations.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["line"]), "\n").alias("markdown"))


def outlines(nation: DataFrame, region: DataFrame, supplier: DataFrame, joint: Column | str = ", ") -> DataFrame:
    """doc_id (region) and markdown: a heading a region and nation, a paragraph of the nation's suppliers."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: x["s_name"])
    names = F.array_join(listed, joint) if isinstance(joint, str) else F.when(F.first(joint) == "", F.array_join(listed, "")).otherwise(F.array_join(listed, ", "))
    body = supplier.groupBy("s_nationkey").agg(names.alias("body"))
    part = F.concat(F.lit("## "), F.col("n_name"), F.when(F.col("body").isNotNull(), F.concat(F.lit("\n\n"), F.col("body"))).otherwise(""))
    parts = nation.join(body, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", part.alias("part")))).alias("parts"))
    text = F.concat(F.lit("# "), F.col("r_name"), F.lit("\n\n"), F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n"))
    return region.join(parts, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_regionkey").cast("long").alias("doc_id"), text.alias("markdown"))


def part_tables(part: DataFrame) -> DataFrame:
    """brand_no and markdown: a table of key and name of each brand's parts."""
    row = F.concat(F.lit("| "), F.col("p_partkey"), F.lit(" | "), F.col("p_name"), F.lit(" |"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("row")))), lambda x: x["row"]), "\n")
    key = F.regexp_replace("p_brand", "[^0-9]", "").cast("long")
    return part.groupBy(key.alias("brand_no")).agg(F.concat(F.lit("| key | name |\n| --- | --- |\n"), rows).alias("markdown"))


def blocks(part: DataFrame) -> DataFrame:
    """brand_no and markdown: paragraphs, lists, code and tables in turn, one of each part, blank lines between."""
    key, number = F.col("p_partkey"), F.col("p_partkey").cast("string")
    b = F.trim(F.repeat(F.concat("p_name", F.lit(" ")), (1 + key % 9 * 4).cast("int")))
    piece = (
        F.when(key % 4 == 0, b).when(key % 4 == 1, F.concat(F.lit("- "), b, F.lit("\n- second "), number)).when(key % 4 == 2, F.concat(F.lit("```\n"), b, F.lit("\n```")))
        .otherwise(F.concat(F.lit("| a | b |\n| --- | --- |\n| "), b, F.lit(" | "), number, F.lit(" |")))
    )
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", piece.alias("piece")))), lambda x: x["piece"])
    return part.groupBy(F.regexp_replace("p_brand", "[^0-9]", "").cast("long").alias("brand_no")).agg(F.array_join(pieces, "\n\n").alias("markdown"))


def workbooks(nation: DataFrame, customer: DataFrame) -> DataFrame:
    """doc_id (region) and markdown: a sheet a nation, a table of its customers."""
    row = F.concat(F.lit("| "), F.col("c_custkey").cast("string"), F.lit(" | "), "c_name", F.lit(" | "), "c_mktsegment", F.lit(" |"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("row")))), lambda x: x["row"]), "\n")
    each = customer.groupBy("c_nationkey").agg(F.concat(F.lit("\n\n| key | name | segment |\n| --- | --- | --- |\n"), rows).alias("body")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    sheets = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", F.concat(F.lit("## "), "n_name", "body").alias("sheet")))), lambda x: x["sheet"])
    return each.groupBy(F.col("n_regionkey").cast("long").alias("doc_id")).agg(F.array_join(sheets, "\n\n<!-- pagebreak -->\n\n").alias("markdown"))


def decks(conversations: DataFrame) -> DataFrame:
    """conv_id and markdown: a slide a turn, page breaks between."""
    slide = F.concat(F.lit("# "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n\n"), "text")
    slides = F.transform(F.array_sort(F.collect_list(F.struct("turn", slide.alias("slide")))), lambda x: x["slide"])
    return conversations.groupBy("conv_id").agg(F.array_join(slides, "\n<!-- pagebreak -->\n").alias("markdown"))
