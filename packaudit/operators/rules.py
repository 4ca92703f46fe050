"""Threshold lookups (R1, R2, R3) and rule disclosure.

Rule tables are fixed lists of three to five rows; they are broadcast and joined by
interval, so a new table is a data change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packaudit import dims
from packaudit.functions.quantity import WEIGHT_VOLUME


def _in_interval(key: Column, lower: str, upper: str) -> Column:
    return ((F.col(lower).isNull() | (key > F.col(lower)))
            & (F.col(upper).isNull() | (key <= F.col(upper))))


def _table(rules: DataFrame, *tables: str) -> DataFrame:
    return F.broadcast(rules.where(F.col("table_id").isin(*tables)).select(
        F.col("table_id").alias("_t"), F.col("lower").alias("_lo"), F.col("upper").alias("_up"),
        F.col("normal_mm").alias("_normal"), F.col("moulded_mm").alias("_moulded"), F.col("label").alias("_label")))


def _height(style: Column) -> Column:
    return F.when(style == "normal", F.col("_normal")).otherwise(F.col("_moulded"))


def table_height(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Binding height by panel area; refused without a positive area.

    Adds required_mm, rule_row, lookup_ok, lookup_reason.
    """
    area = F.col("panel_area_cm2")
    hit = df.join(_table(rules, "I"), (area > 0) & _in_interval(area, "_lo", "_up"), "left")
    reason = (F.when(area.isNull(), "principal display panel area not given")
              .when(area <= 0, "principal display panel area must be positive"))
    return hit.select(
        *df.columns, _height(F.col("print_style")).alias("required_mm"),
        F.concat(F.lit("panel area "), F.col("_label"), F.lit(" cm2")).alias("rule_row"),
        F.coalesce(area > 0, F.lit(False)).alias("lookup_ok"), reason.alias("lookup_reason"))


def advisory_height(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Superseded reading, by quantity for weight and volume, else by area (R2); never binds.

    Needs quantity_kind, quantity_base, panel_area_cm2, print_style.
    """
    by_quantity = F.coalesce(F.col("quantity_kind") == WEIGHT_VOLUME, F.lit(False))
    table = F.when(by_quantity, "adv_quantity").otherwise("adv_area")
    key = F.when(by_quantity, F.col("quantity_base")).otherwise(F.col("panel_area_cm2"))
    hit = df.join(_table(rules, "adv_quantity", "adv_area"),
                  (F.col("_t") == table) & (F.col("panel_area_cm2") > 0) & _in_interval(key, "_lo", "_up"), "left")
    name = F.when(F.col("_t") == "adv_quantity", "I (pre-2017, quantity-keyed)").when(
        F.col("_t") == "adv_area", "II (pre-2017)")
    return hit.select(*df.columns, _height(F.col("print_style")).alias("advisory_required_mm"),
                      name.alias("advisory_table"))


def required_height(df: DataFrame, rules: DataFrame, declarations: DataFrame) -> DataFrame:
    """Binding and advisory heights of each declaration by its basis.

    A field without a row, or on the table basis, takes table I. A field mapped to the
    historical floor takes that floor, with the table shown as advisory.
    """
    both = advisory_height(table_height(df, rules), rules)
    basis = F.broadcast(declarations.select("field", F.col("basis").alias("_basis")))
    out = both.join(basis, "field", "left")
    floor = F.coalesce(F.col("_basis") == dims.FLOOR_BASIS, F.lit(False))
    flat = F.when(F.col("print_style") == "normal", dims.FLOOR_MM["normal"]).otherwise(dims.FLOOR_MM["embossed"])
    return out.select(
        *df.columns,
        F.when(floor, flat).otherwise(F.col("required_mm")).alias("required_mm"),
        F.when(floor, F.concat(F.lit("superseded flat floor ("), F.col("print_style"), F.lit(")")))
        .otherwise(F.col("rule_row")).alias("rule_row"),
        (floor | F.col("lookup_ok")).alias("lookup_ok"),
        F.when(~floor, F.col("lookup_reason")).alias("lookup_reason"),
        F.when(floor, F.col("required_mm")).otherwise(F.col("advisory_required_mm")).alias("advisory_required_mm"),
        F.when(floor & F.col("lookup_ok"), "I").otherwise(F.col("advisory_table")).alias("advisory_table"),
        F.when(floor, "7(3) pre-2017").otherwise("I").alias("rule_table"))


def rules_disclosure(spark) -> DataFrame:
    """Every table row, declaration, unit and key phrase the engine applies."""
    tables = dims.rule_table(spark).select(
        F.lit("height_table").alias("section"), F.col("table_id").alias("name"), "ord",
        F.format_string("%s: %s / %s mm", "label", "normal_mm", "moulded_mm").alias("text"))
    decl = dims.declarations(spark).select(
        F.lit("declaration").alias("section"), F.col("field").alias("name"), "ord",
        F.format_string("%s; basis %s", "requirement", "basis").alias("text"))
    unit = dims.units(spark).select(
        F.lit("unit").alias("section"), F.col("unit").alias("name"), F.lit(0).alias("ord"),
        F.format_string("%s x %s", "base_unit", "factor").alias("text"))
    keys = dims.key_phrases(spark).select(
        F.lit("phrase").alias("section"), F.concat_ws("/", "field", "kind").alias("name"), "ord",
        F.col("pattern").alias("text"))
    width = spark.range(1).select(
        F.lit("width_rule").alias("section"), F.lit("min_ratio").alias("name"), F.lit(0).alias("ord"),
        F.lit(str(dims.MIN_WIDTH_RATIO)).alias("text"))
    return tables.unionByName(decl).unionByName(unit).unionByName(keys).unionByName(width)


def rule_usage(df: DataFrame, rules: DataFrame) -> DataFrame:
    """How many measurements fall under each row of table I and each print style."""
    used = table_height(df, rules).where("lookup_ok")
    per = used.groupBy("rule_row", "print_style").agg(
        F.count(F.lit(1)).alias("n"), F.first("required_mm").alias("required_mm"))
    return per
