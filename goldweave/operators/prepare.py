"""Source rows to canonical records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.functions.numeric import normalize_price
from goldweave.functions.text import normalize_brand, normalize_manufacturer, normalize_text, tokens

REQUIRED = ("id", "title", "manufacturer", "price")
# Other names of the required columns.
COLUMN_ALIASES = {
    "product_id": "id",
    "sku": "id",
    "name": "title",
    "product_name": "title",
    "brand": "manufacturer",
    "maker": "manufacturer",
    "vendor": "manufacturer",
    "list_price": "price",
    "amount": "price",
}


def rename_aliases(df: DataFrame) -> DataFrame:
    """Known aliases to required names, unless the name is there already; spaces and underscores are alike."""
    renamed, taken = {}, set(df.columns)
    for c in df.columns:
        to = COLUMN_ALIASES.get("_".join(c.strip().lower().replace("_", " ").split()))
        if to and to not in taken:
            renamed[c] = to
            taken.add(to)
    return df.withColumnsRenamed(renamed)


def missing_columns(df: DataFrame) -> list[str]:
    return [f"missing required column: {c}" for c in REQUIRED if c not in df.columns]


def preprocess(df: DataFrame) -> DataFrame:
    """The required columns and seven derived ones."""
    out = df.select(*[F.col(c).cast("string").alias(c) for c in REQUIRED])
    out = out.withColumns(
        {
            "title_norm": normalize_text(F.col("title")),
            "manufacturer_norm": normalize_manufacturer(F.col("manufacturer")),
            "price_norm": normalize_price(F.col("price")),
        }
    )
    return out.withColumns(
        {
            "brand_norm": normalize_brand(F.col("manufacturer_norm")),
            "price_missing": F.col("price_norm").isNull().cast("int"),
            "title_missing": (F.col("title_norm") == "").cast("int"),
            "manufacturer_missing": (F.col("manufacturer_norm") == "").cast("int"),
        }
    )


def with_tokens(df: DataFrame) -> DataFrame:
    return df.withColumn("tokens", tokens(F.col("title_norm")))
