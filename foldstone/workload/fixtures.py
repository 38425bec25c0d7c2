"""Stand-in views: the record, enrichment, score and series tables made from the driver tables.

Column expressions are written once as text that Spark and DuckDB both read, so a query and its SQL
twin start from the same rows.  Every view covers its tables whole; ``split`` puts each row in
either ``train`` or ``test`` by a hash of its key.  Values are whole or have few decimals, so
that sums do not depend on the order of adding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone import constants as K
from foldstone.functions.features import add_features
from foldstone.operators.joins import enrich
from foldstone.sources.tables import table

SPLIT = "case when substr(md5(cast(o_orderkey as string)), 1, 2) < '33' then 'test' else 'train' end"
TARGET = "cast(o_orderstatus = 'F' or o_totalprice < 60000 as int)"
SCORE = "least(0.999e0, greatest(0.001e0, 1e0 - floor(o_totalprice / 5e0) / 1e5))"

RECORD_COLUMNS = {
    "record_id": "o_orderkey",
    "split": SPLIT,
    "zone": "case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'Rural' else 'Peri-urban' end",
    "gender": "case when o_orderpriority in ('1-URGENT', '3-MEDIUM') then 'Female' else 'Male' end",
    "deathdate": "cast(cast(o_orderdate as date) as string)",
    "age": "cast(floor(o_totalprice / 4200e0) as double)",
    "avg_temperature": "floor(c_acctbal / 250e0) * 1e0",
    "max_temperature": "6e0 + floor(c_acctbal / 200e0)",
    "min_temperature": "floor(c_acctbal / 300e0) - 3e0",
    "precipitation": "floor(o_totalprice / 25000e0) * 1e0",
    "latitude": "0.45e0 + floor(c_acctbal / 10e0) / 1e3",
    "longitude": "32.5e0 + floor((o_totalprice - 250000e0) / 200e0) / 1e3",
    "location": "concat(c_name, ', ', n_name, ', ', r_name)",
    "target": TARGET,
}
_DISCOUNT = "sum(cast(round(l_discount * 100e0) as int))"
_TAX = "sum(cast(round(l_tax * 100e0) as int))"
ENRICHMENT_COLUMNS = {
    "rain_sum_7d": "sum(case when l_returnflag = 'R' then l_quantity else 0e0 end)",
    "rain_sum_30d": "sum(l_quantity)",
    "rain_sum_90d": f"sum(l_quantity) + {_DISCOUNT}",
    "rain_days_30d": "cast(count(*) as int)",
    "max_daily_rain_30d": "max(l_quantity)",
    "tavg_7d": "20e0 + floor(sum(l_quantity) * 10e0 / count(*)) / 1e2",
    "tavg_30d": f"20e0 + floor({_DISCOUNT} * 50e0 / count(*)) / 1e2",
    "tavg_90d": f"20e0 + floor({_TAX} * 50e0 / count(*)) / 1e2",
    "tmax_30d": "25e0 + max(l_quantity) / 5e0",
    "tmin_30d": "10e0 + min(l_quantity) / 5e0",
    "hot_days_30d": "cast(sum(case when l_quantity > 45 then 1 else 0 end) as int)",
    "temp_range_mean_30d": "floor(sum(l_quantity) * 25e0 / count(*)) / 1e2",
    "ndvi_30d": f"floor({_DISCOUNT} * 8e0 / count(*)) / 1e2",
    "ndvi_90d": f"floor({_TAX} * 10e0 / count(*)) / 1e2",
    "elevation": "floor(max(l_extendedprice) / 40e0) * 1e0",
    "slope": "floor(sum(l_linenumber) * 10e0 / count(*)) / 1e1",
}
MODEL_SCORES = {
    "leafwise": SCORE,
    "levelwise": f"({SCORE}) * ({SCORE})",
    "ordered": f"sqrt({SCORE})",
    "forest": f"0.5e0 * ({SCORE}) + 0.5e0 * (cast((o_orderkey * 7919) % 1000 as double) / 1e3)",
}
MODELS = tuple(MODEL_SCORES)
SCORE_KEYS = {"record_id": "o_orderkey", "split": SPLIT, "target": TARGET}


def _select(columns: dict[str, str]) -> list[str]:
    return [f"{e} as {n}" for n, e in columns.items()]


# ------------------------------------------------------------------ Spark side


def records(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .selectExpr(*_select(RECORD_COLUMNS))
    )


def train(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).where("split = 'train'")


def test(spark: SparkSession, sf: str) -> DataFrame:
    """Unlabelled side: no target column, like a hand-out test file."""
    return records(spark, sf).where("split = 'test'").drop("target")


def enrichment(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("record_id")).agg(
        *[F.expr(e).alias(n) for n, e in ENRICHMENT_COLUMNS.items()])


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return enrich(records(spark, sf), enrichment(spark, sf))


def featured(spark: SparkSession, sf: str) -> DataFrame:
    return add_features(enriched(spark, sf))


def wide_scores(spark: SparkSession, sf: str) -> DataFrame:
    """(record_id, split, target, one column per model)."""
    return table(spark, sf, "orders").selectExpr(*_select(SCORE_KEYS | MODEL_SCORES))


def scores(spark: SparkSession, sf: str, model: str = "leafwise") -> DataFrame:
    """(record_id, split, target, p) of one model."""
    return table(spark, sf, "orders").selectExpr(*_select(SCORE_KEYS | {"p": MODEL_SCORES[model]}))


def long_scores(spark: SparkSession, sf: str) -> DataFrame:
    """(record_id, split, target, model, p)."""
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in MODELS])
    return wide_scores(spark, sf).select("record_id", "split", "target", F.inline(cells))


def place_readings(spark: SparkSession, sf: str) -> DataFrame:
    """(place, ts, amount): shipped quantities at the buyer's place."""
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    customer = table(spark, sf, "customer")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("c_nationkey").alias("place"), F.col("l_shipdate").alias("ts"),
                F.col("l_quantity").alias("amount"))
    )


def placed_records(spark: SparkSession, sf: str) -> DataFrame:
    """(record_id, place, day)."""
    return table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("record_id"), F.col("c_nationkey").alias("place"),
        F.col("o_orderdate").cast("date").alias("day"))


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, lang, target, p): a second labelled set scored by text length."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return docs.select("doc_id", "lang", "n_chars").join(labels, "doc_id").selectExpr(
        "doc_id", "lang", "quality as target", "least(1e0, n_chars / 4e3) as p")


# ------------------------------------------------------------------ SQL side

_FROM_RECORDS = ("from orders join customer on o_custkey = c_custkey "
                 "join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")


def _fold(part: str, seed: int, k: int, key: str = "record_id") -> str:
    return (f"cast((row_number() over (partition by {part} order by "
            f"md5(concat('{seed}:', cast({key} as varchar)))) - 1) % {k} as int)")


CTES = {
    "records": f"select {', '.join(_select(RECORD_COLUMNS))} {_FROM_RECORDS}",
    "train": "select * from records where split = 'train'",
    "test": "select * from records where split = 'test'",
    "enrichment": (f"select l_orderkey as record_id, {', '.join(_select(ENRICHMENT_COLUMNS))} "
                   "from lineitem group by l_orderkey"),
    "enriched": "select * from records left join enrichment using (record_id)",
    "wide": f"select {', '.join(_select(SCORE_KEYS | MODEL_SCORES))} from orders",
    "scores": f"select {', '.join(_select(SCORE_KEYS | {'p': SCORE}))} from orders",
    "longs": " union all ".join(
        f"select record_id, split, target, '{m}' as model, {m} as p from wide" for m in MODELS),
    "folded": f"select *, {_fold('target', K.SEED, K.FOLDS)} as fold from train",
    "calfold": (f"select *, {_fold('target', K.CALIBRATION_SEED, K.FOLDS)} as fold "
                "from scores where split = 'train'"),
    "docs": ("select doc_id, lang, quality as target, least(1e0, n_chars / 4e3) as p "
             "from documents join labels using (doc_id)"),
}
_NEEDS = {
    "train": ["records"], "test": ["records"], "enriched": ["records", "enrichment"],
    "longs": ["wide"], "folded": ["train"], "calfold": ["scores"],
}


def with_views(body: str, *names: str, **extra: str) -> str:
    """Prefix a SELECT with the named views (and what they need) and any extra ones."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} as ({CTES[n]})" for n in order] + [f"{n} as ({s})" for n, s in extra.items()]
    return f"with {', '.join(parts)} {body}" if parts else body
