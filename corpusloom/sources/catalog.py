"""The corpora as a small table, and its Markdown block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Id, name, kind of text, section style.
SOURCES = (
    ("arxiv", "arXiv papers", "papers", "markdown"),
    ("openalex", "OpenAlex works", "abstracts", "text"),
    ("billstatus", "US bills", "summaries", "text"),
    ("ecfr", "US federal regulations", "sections", "text"),
    ("enwiki", "English encyclopedia", "articles", "markdown"),
    ("simplewiki", "Simple English encyclopedia", "articles", "markdown"),
    ("wikinews", "News wiki", "articles", "markdown"),
    ("eurlex", "EU law", "acts", "text"),
    ("factbook", "Country profiles", "profiles", "markdown"),
    ("federal_register", "US federal notices", "notices", "markdown"),
    ("github", "Project readmes", "readmes", "markdown"),
    ("gutenberg", "Public-domain books", "books", "text"),
    ("justice_canada", "Canadian law", "acts", "markdown"),
    ("openstax", "Open textbooks", "sections", "markdown"),
    ("pdfs", "PDF library", "pages", "pages"),
    ("pydocs", "Python documentation", "pages", "markdown"),
    ("sec_edgar", "Company filings", "filings", "text"),
)


def sources(spark: SparkSession) -> DataFrame:
    """The sources with the place where their chunks are searched."""
    rows = spark.createDataFrame(SOURCES, "id string, name string, kind string, style string")
    return rows.withColumn("endpoint", F.concat(F.lit("/"), "id", F.lit("/chunks")))


def in_step(block: DataFrame, text: str) -> bool:
    """Whether a page still holds the block that the catalog gives; where not, it has drifted."""
    return block.filter(F.lit(text).contains(F.col("block"))).count() == 1


def markdown_block(catalog: DataFrame) -> DataFrame:
    """One row (block): a Markdown list of the catalog, by id."""
    line = F.concat(F.lit("- **"), F.col("name"), F.lit("** (`"), F.col("id"), F.lit("`): "), F.col("kind"))
    return catalog.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"]), "\n").alias("block"))
