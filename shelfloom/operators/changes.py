"""Set-based changes of the stored tables: current table + changes -> new table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom.fixed_values import DEFAULT_CURRENCY
from shelfloom.schemas import PRODUCTS

# What a feed line overwrites on an existing product, null included.
FEED_FIELDS = ["title", "description", "category", "brand", "price", "attributes", "raw_data"]

# What a partial update may set.
PATCH_FIELDS = [
    "title", "description", "generated_description", "category", "brand", "price",
    "status", "attributes", "seo_title", "seo_keywords",
]


def new_product_id(sku: Column) -> Column:
    """Id of a new product: a hash of its SKU, the same in every recomputation."""
    return F.xxhash64(sku)


def _comparable(name: str, column: Column) -> Column:
    """Maps cannot be compared; their sorted entries can."""
    return F.array_sort(F.map_entries(column)) if name == "attributes" else column


def _differs(fields: list, old, new) -> Column:
    test = F.lit(False)
    for name in fields:
        same = _comparable(name, old(name)).eqNullSafe(_comparable(name, new(name)))
        test = test | ~same
    return test


def _typed(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PRODUCTS.fields])


def _merged(joined: DataFrame, run_ts) -> DataFrame:
    """Products from a join of ``cur`` and ``fed`` rows on SKU."""
    fed, known = F.col("fed.sku").isNotNull(), F.col("cur.sku").isNotNull()
    stamp = F.lit(run_ts).cast("timestamp")

    def cur(name):
        return F.col(f"cur.{name}")

    def new(name):
        return F.col(f"fed.{name}")

    changed = _differs([*FEED_FIELDS, "status"], cur, new)
    values = {
        "product_id": F.coalesce(cur("product_id"), new_product_id(new("sku"))),
        "sku": F.coalesce(cur("sku"), new("sku")),
        "currency": F.when(known, cur("currency")).otherwise(new("currency")),
        "created_at": F.coalesce(cur("created_at"), stamp),
        "updated_at": F.when(fed & (~known | changed), stamp).otherwise(cur("updated_at")),
    }
    for name in [*FEED_FIELDS, "status"]:
        values[name] = F.when(fed, new(name)).otherwise(cur(name))
    for name in ("generated_description", "seo_title", "seo_keywords"):
        values[name] = cur(name)
    return _typed(joined.select(*[value.alias(name) for name, value in values.items()]))


def upsert_products(current: DataFrame, latest: DataFrame, run_ts) -> DataFrame:
    """Catalog after a feed; ``latest`` has one row per SKU and its new status.

    A known SKU gets all feed fields, null included, and keeps its currency and
    generated content. ``updated_at`` moves only where a value changed. Both
    sides are shuffled once, by SKU.
    """
    joined = current.alias("cur").join(
        latest.alias("fed"), F.col("cur.sku") == F.col("fed.sku"), "full_outer"
    )
    return _merged(joined, run_ts)


def create_products(current: DataFrame, requested: DataFrame, run_ts):
    """(accepted new rows, requests rejected because the SKU exists).

    ``requested`` has a unique sku, a title and any other product columns.
    """
    known = current.select("sku")
    accepted = requested.join(known, "sku", "left_anti")
    rejected = requested.join(known, "sku", "left_semi")
    stamp = F.lit(run_ts).cast("timestamp")
    defaults = {
        "product_id": new_product_id(F.col("sku")),
        "currency": F.lit(DEFAULT_CURRENCY),
        "status": F.lit("draft"),
        "attributes": F.create_map().cast("map<string,string>"),
        "created_at": stamp,
        "updated_at": stamp,
    }

    def value(name: str) -> Column:
        if name in ("product_id", "status", "created_at", "updated_at"):
            return defaults[name]
        given = F.col(name) if name in requested.columns else F.lit(None)
        return F.coalesce(given, defaults[name]) if name in defaults else given

    created = accepted.select(*[
        value(f.name).cast(f.dataType).alias(f.name) for f in PRODUCTS.fields
    ])
    return created, rejected


def patch_products(current: DataFrame, patches: DataFrame, run_ts, order: str = None) -> DataFrame:
    """Partial update: each patch row names the fields it sets in ``set_fields``.

    A named field is overwritten even with null; any other keeps its value. With
    several patches per product, ``order`` tells which one came last.
    """
    fields = [f for f in PATCH_FIELDS if f in patches.columns]
    position = F.col(order) if order else F.lit(0)

    def is_set(name: str) -> Column:
        return F.array_contains("set_fields", name)

    combined = patches.groupBy("product_id").agg(*[
        item
        for name in fields
        for item in (
            F.max_by(name, F.when(is_set(name), position)).alias(f"_new_{name}"),
            F.bool_or(is_set(name)).alias(f"_set_{name}"),
        )
    ])
    joined = current.join(combined, "product_id", "left")

    def new(name: str) -> Column:
        return F.when(F.coalesce(f"_set_{name}", F.lit(False)), F.col(f"_new_{name}")).otherwise(
            F.col(name)
        )

    changed = _differs(fields, F.col, new)
    stamp = F.lit(run_ts).cast("timestamp")
    values = {name: new(name) for name in fields}
    values["updated_at"] = F.when(changed, stamp).otherwise(F.col("updated_at"))
    return _typed(joined.select(*[
        values.get(f.name, F.col(f.name)).alias(f.name) for f in PRODUCTS.fields
    ]))


def delete_products(doomed: DataFrame, products: DataFrame, *children: DataFrame) -> list:
    """Products and child tables without the rows of the product ids in ``doomed``."""
    ids = doomed.select("product_id").distinct()
    return [table.join(ids, "product_id", "left_anti") for table in (products, *children)]


def _marked(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows with ``_hit`` true where their key is among the ids."""
    chosen = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return rows.join(chosen, key, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))


def resolve_issues(issues: DataFrame, ids: DataFrame, run_ts) -> DataFrame:
    """Issues with those in ``ids`` (issue_id) resolved at ``run_ts``."""
    marked = _marked(issues, ids, "issue_id")
    stamp = F.lit(run_ts).cast("timestamp")
    return marked.select(*[
        F.when(F.col("_hit"), F.lit(True)).otherwise(F.col("resolved")).alias(c) if c == "resolved"
        else F.when(F.col("_hit"), stamp).otherwise(F.col(c)).alias(c) if c == "resolved_at"
        else F.col(c)
        for c in issues.columns
    ])


def acknowledge_alerts(alerts: DataFrame, ids: DataFrame) -> DataFrame:
    """Alerts with those in ``ids`` (alert_id) acknowledged."""
    marked = _marked(alerts, ids, "alert_id")
    return marked.select(*[
        (F.col("_hit") | F.col("acknowledged")).alias(c) if c == "acknowledged" else F.col(c)
        for c in alerts.columns
    ])
