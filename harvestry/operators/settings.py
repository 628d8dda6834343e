"""Layered settings: the first layer that decides gives the value and its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Layers by precedence, and the source that each one is reported as.
LAYERS = (("per_run", "PER_RUN_OVERRIDE"), ("run_profile", "RUN_PROFILE"), ("crawler", "CRAWLER_OPERATIONAL_DEFAULT"), ("collection", "COLLECTION_OVERRIDE"), ("global", "GLOBAL_SETTING"))
BUILT_IN = "BUILT_IN_DEFAULT"
#: Layers that a run without a crawler does not have.
NOT_IN_QUICK_SCRAPE = ("run_profile", "crawler")
SCOPE_OF_LAYER = {"RUN_PROFILE": "run_profile", "CRAWLER": "crawler", "COLLECTION": "collection", "GLOBAL": "global"}


def resolve(layers: dict[str, tuple[Column, Column]], built_in: Column, quick_scrape: Column | bool = False) -> Column:
    """struct(value, source). layers: by name, (state, value); a null state inherits. A reset gives the built-in value."""
    quick = F.lit(quick_scrape) if isinstance(quick_scrape, bool) else quick_scrape
    out = F.struct(built_in.alias("value"), F.lit(BUILT_IN).alias("source"))
    for name, source in reversed(LAYERS):
        if name not in layers:
            continue
        state, value = layers[name]
        state = F.coalesce(state, F.lit("INHERIT"))
        if name in NOT_IN_QUICK_SCRAPE:
            state = F.when(quick, "INHERIT").otherwise(state)
        own = F.struct(value.alias("value"), F.lit(source).alias("source"))
        out = F.when(state == "CUSTOM", own).when(state == "RESET_TO_BUILT_IN", F.struct(built_in.alias("value"), F.lit(BUILT_IN).alias("source"))).otherwise(out)
    return out


def resolve_stored(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value, source) for each key of keys (key, built_in) from stored rows (scope, key, state, value), one a scope and key."""
    wide = stored.groupBy("key").agg(*[F.max(F.when(F.col("scope") == scope, F.struct("state", "value"))).alias(layer) for scope, layer in SCOPE_OF_LAYER.items()])
    joined = keys.join(wide.withColumnRenamed("key", "__k"), F.col("key") == F.col("__k"), "left")
    layers = {layer: (F.col(f"{layer}.state"), F.col(f"{layer}.value")) for layer in SCOPE_OF_LAYER.values()}
    return joined.withColumn("__r", resolve(layers, F.col("built_in"))).select("key", "__r.value", "__r.source")


def latest(rows: DataFrame, key: tuple[str, ...], order: tuple[str, ...], keep_first: tuple[str, ...] = ()) -> DataFrame:
    """Upsert: of the rows of a key the last by order; columns in keep_first keep the value of the first."""
    others = [c for c in rows.columns if c not in key]
    rank = [F.col(c) for c in order] + [F.col(c) for c in others if c not in order]
    agg = [F.max(F.struct(*rank)).alias("__last")] + [F.min(F.struct(*[F.col(c) for c in order], F.col(c))).getField(c).alias(f"__first_{c}") for c in keep_first]
    out = rows.groupBy(*key).agg(*agg)
    return out.select(*key, *[(F.col(f"__first_{c}") if c in keep_first else F.col(f"__last.{c}")).alias(c) for c in others])
