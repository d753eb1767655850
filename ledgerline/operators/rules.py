"""Comparison rules as small broadcast DataFrames.

A rule says how one (segment, field) is compared: severity (hard / soft /
ignore), case-insensitive, numeric, a conditional qualifier and a numeric
tolerance.  Rules come in three tiers – universal, transaction type, partner –
plus an optional per-profile crosswalk that sits above them.

Resolution (C17) first merges tiers per exact (segment, field) – the highest
tier wins – and then looks the merged table up with wildcards:
``(s, f) > (s, *) > (*, f) > (*, *) > hard default``.  Each lookup is an equi
join against a broadcast rule table (the single ``(*, *)`` rule is a literal);
one OR-join would plan as a nested loop.

Rule tables are configuration: they are built from Python values whose length
is known when the plan is built; up to ``BROADCAST_ROWS`` they carry a broadcast
hint, beyond it Spark picks the join by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows up to which a rule table carries a broadcast hint; larger ones are joined by size.
BROADCAST_ROWS = 100_000

# Tier names and their precedence (higher wins).
TIER_RANK = {"universal": 1, "transaction": 2, "partner": 3, "crosswalk": 4}

RULE_SCHEMA = T.StructType([
    T.StructField("tier", T.StringType(), False),
    T.StructField("tier_rank", T.IntegerType(), False),
    T.StructField("segment", T.StringType(), False),
    T.StructField("field", T.StringType(), False),
    T.StructField("severity", T.StringType(), True),
    T.StructField("ignore_case", T.BooleanType(), True),
    T.StructField("numeric", T.BooleanType(), True),
    T.StructField("conditional_qualifier", T.StringType(), True),
    T.StructField("amount_variance", T.DoubleType(), True),
])

RULE_ATTRS = ["severity", "ignore_case", "numeric", "conditional_qualifier", "amount_variance"]


class RuleBook:
    """The rules of a comparison profile: one list, every entry naming its tier."""

    def __init__(self) -> None:
        self.rules: list[dict] = []
        self.ignored: list[tuple[str, str, str]] = []
        self.aligned: list[tuple[str, str, str | None]] = []

    def rule(self, tier: str, segment: str, field: str, severity: str = "hard", **how) -> RuleBook:
        """How ``field`` of ``segment`` is compared; ``how`` sets further rule attributes."""
        unknown = set(how) - set(RULE_ATTRS)
        if unknown or tier not in TIER_RANK:
            raise ValueError(f"no such tier or attribute: {tier}, {sorted(unknown)}")
        self.rules.append({"tier": tier, "segment": segment, "field": field, "severity": severity,
                           "ignore_case": False, "numeric": False, **how})
        return self

    def ignore(self, tier: str, segment: str, field: str) -> RuleBook:
        self.ignored.append((tier, segment, field))
        return self

    def align_by(self, tier: str, segment: str, element: str | None) -> RuleBook:
        """Occurrences of ``segment`` are matched by an element, or by position (None)."""
        self.aligned.append((tier, segment, element))
        return self

    def rows(self, crosswalk: list[dict] | None = None) -> list[dict]:
        """Rules as rows of ``RULE_SCHEMA``.  ``crosswalk`` rows come on top; an attribute
        that they leave out inherits from the tiers (T7)."""
        over = [{"tier": "crosswalk", "segment": "*", **x} for x in crosswalk or []]
        return [{f.name: r.get(f.name) for f in RULE_SCHEMA} | {
            "tier_rank": TIER_RANK[r["tier"]],
            "amount_variance": None if r.get("amount_variance") is None else float(r["amount_variance"])}
            for r in [*self.rules, *over]]


def small(df: DataFrame, rows: int) -> DataFrame:
    """Hint to broadcast a configuration table of ``rows`` rows, within the bound; beyond it
    Spark chooses the join by size, with the same result."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def rules_frame(spark: SparkSession, book: RuleBook, crosswalk: list[dict] | None = None) -> DataFrame:
    """All tier rules as one DataFrame (one row per tier rule)."""
    return spark.createDataFrame([tuple(r[f.name] for f in RULE_SCHEMA) for r in book.rows(crosswalk)], RULE_SCHEMA)


def merge_tiers(rules: DataFrame) -> DataFrame:
    """C16 (+C20): per exact (segment, field) the rule of the highest tier wins whole; nothing
    of a lower tier's rule is inherited.  A crosswalk row is no rule of its own: it overlays
    the attributes that it sets, so an override of severity keeps the rule's numeric flag.
    """
    over = F.col("tier") == "crosswalk"
    rule = F.max_by(F.struct("tier", *RULE_ATTRS), F.when(~over, F.col("tier_rank")))
    laid = [F.max_by(F.when(over, F.col(a)), F.when(over & F.col(a).isNotNull(), F.col("tier_rank"))).alias(f"_x_{a}")
            for a in RULE_ATTRS]
    merged = rules.groupBy("segment", "field").agg(rule.alias("_rule"), F.max(over).alias("_over"), *laid)
    attrs = {a: F.coalesce(F.col(f"_x_{a}"), F.col("_rule")[a]) for a in RULE_ATTRS}
    unset = {"severity": F.lit("hard"), "ignore_case": F.lit(False), "numeric": F.lit(False)}
    return merged.select(
        "segment", "field", F.when(F.col("_over"), "crosswalk").otherwise(F.col("_rule.tier")).alias("tier"),
        *[(F.coalesce(c, unset[a]) if a in unset else c).alias(a) for a, c in attrs.items()])


def merge_config(book: RuleBook, crosswalk: list[dict] | None = None) -> list[dict]:
    """C16 on the configuration itself: the same result as ``merge_tiers`` on
    ``rules_frame``, computed in Python because rules are configuration."""
    merged: dict[tuple[str, str], dict] = {}
    for row in sorted(book.rows(crosswalk), key=lambda r: r["tier_rank"]):  # later rows win
        key, own = (row["segment"], row["field"]), {a: row[a] for a in ["tier", *RULE_ATTRS]}
        if row["tier"] == "crosswalk":
            own = merged.get(key, dict.fromkeys(RULE_ATTRS)) | {a: v for a, v in own.items() if v is not None}
        merged[key] = own
    return [{"segment": seg, "field": fld, **m, "severity": m["severity"] or "hard",
             "ignore_case": bool(m["ignore_case"]), "numeric": bool(m["numeric"])}
            for (seg, fld), m in sorted(merged.items())]


MERGED_SCHEMA = ("segment string, field string, tier string, severity string, ignore_case boolean, "
                 "numeric boolean, conditional_qualifier string, amount_variance double")


def merged_frame(spark: SparkSession, book: RuleBook, crosswalk: list[dict] | None = None) -> DataFrame:
    """Merged rules as a local (broadcastable, job-free) DataFrame."""
    rows = [(m["segment"], m["field"], m["tier"], m["severity"], m["ignore_case"], m["numeric"],
             m["conditional_qualifier"], None if m["amount_variance"] is None else float(m["amount_variance"]))
            for m in merge_config(book, crosswalk)]
    return spark.createDataFrame(rows, MERGED_SCHEMA)


def _rule_struct(prefix: str) -> Column:
    return F.struct(*[F.col(f"{prefix}{a}").alias(a) for a in RULE_ATTRS])


def _default_rule() -> Column:
    """The rule used when nothing matches: hard, exact text."""
    return F.struct(F.lit("hard").alias("severity"), F.lit(False).alias("ignore_case"),
                    F.lit(False).alias("numeric"),
                    F.lit(None).cast("string").alias("conditional_qualifier"),
                    F.lit(None).cast("double").alias("amount_variance"))


def _literal_rule(row) -> Column:
    return F.struct(F.lit(row["severity"]).cast("string").alias("severity"),
                    F.lit(row["ignore_case"]).cast("boolean").alias("ignore_case"),
                    F.lit(row["numeric"]).cast("boolean").alias("numeric"),
                    F.lit(row["conditional_qualifier"]).cast("string").alias("conditional_qualifier"),
                    F.lit(row["amount_variance"]).cast("double").alias("amount_variance"))


_UNSET = object()


def resolve(df: DataFrame, merged: DataFrame, seg_col: str = "rule_segment",
            field_col: str = "field", prefix: str = "", star_rule=_UNSET, n_rules: int = 0) -> DataFrame:
    """Add ``{prefix}severity … amount_variance``, ``{prefix}wildcard``
    and ``{prefix}hit`` (some rule of ``merged`` applied, not the default).

    ``merged`` is the output of ``merge_tiers`` – configuration.  Three equi left joins – (s, f), (s, *), (*, f) –
    and the single (*, *) rule read once at plan time and inlined as a literal
    (a join on a constant would plan as a nested loop).  ``df`` is not shuffled.
    ``star_rule`` (a dict or None) is that rule; where the rules are no Python values, it is
    read from ``merged``, which is one row of configuration (see :func:`star_of`).
    """
    def side(t: DataFrame, n: int, keys: list[str]) -> DataFrame:
        cols = [F.col(k).alias(f"_r{n}_{k}") for k in keys]
        cols += [F.col(a).alias(f"_r{n}_{a}") for a in RULE_ATTRS]
        cols.append(F.lit(True).alias(f"_r{n}_hit"))
        return small(t.select(*cols), n_rules)

    r1 = side(merged, 1, ["segment", "field"])
    r2 = side(merged.filter(F.col("field") == "*"), 2, ["segment"])
    r3 = side(merged.filter(F.col("segment") == "*"), 3, ["field"])
    star = [r for r in merged.filter((F.col("segment") == "*") & (F.col("field") == "*")).limit(1).collect()] \
        if star_rule is _UNSET else ([star_rule] if star_rule else [])
    out = (df
           .join(r1, (F.col(seg_col) == F.col("_r1_segment")) & (F.col(field_col) == F.col("_r1_field")), "left")
           .join(r2, F.col(seg_col) == F.col("_r2_segment"), "left")
           .join(r3, F.col(field_col) == F.col("_r3_field"), "left"))
    rule = F.coalesce(
        F.when(F.col("_r1_hit"), _rule_struct("_r1_")),
        F.when(F.col("_r2_hit"), _rule_struct("_r2_")),
        F.when(F.col("_r3_hit"), _rule_struct("_r3_")),
        _literal_rule(star[0]) if star else _default_rule())
    wildcard = (F.col("_r1_hit").isNull()
                & (F.col("_r2_hit").isNull() | (F.col(seg_col) == "*"))
                & (F.col("_r3_hit").isNull() | (F.col(field_col) == "*")))
    hit = F.coalesce(F.col("_r1_hit"), F.col("_r2_hit"), F.col("_r3_hit"), F.lit(bool(star)))
    out = (out.withColumn("_rule", rule)
              .withColumn(f"{prefix}wildcard", wildcard)
              .withColumn(f"{prefix}hit", hit))
    return out.select(*[F.col(c) for c in df.columns],
                      *[F.col(f"_rule.{a}").alias(f"{prefix}{a}") for a in RULE_ATTRS],
                      f"{prefix}wildcard", f"{prefix}hit")


def star_of(book: RuleBook, crosswalk: list[dict] | None = None, tier: str | None = None) -> dict | None:
    """The merged (*, *) rule of the configuration (of one tier, if named)."""
    if tier is None:
        rows = merge_config(book, crosswalk)
    else:
        one = RuleBook()
        one.rules = [r for r in book.rules if r["tier"] == tier]
        rows = merge_config(one, crosswalk if tier == "crosswalk" else None)
    return next((m for m in rows if m["segment"] == "*" and m["field"] == "*"), None)


def resolve_with_tier(keys: DataFrame, rules: DataFrame, seg_col: str = "segment",
                      field_col: str = "field", stars: dict[str, dict | None] | None = None) -> DataFrame:
    """Tier first, wildcards inside each tier; adds ``tier``.

    ``stars``: the (*, *) rule of each tier, when the rules are Python values.

    Differs from ``resolve`` when a higher tier has only a ``(*, *)`` rule and a
    lower tier an exact one.  Used for rule listings, not for diffs.
    """
    out = keys
    order = ["crosswalk", "partner", "transaction", "universal"]
    for tier in order:
        out = resolve(out, merge_tiers(rules.filter(F.col("tier") == tier)), seg_col, field_col, prefix=f"{tier}_",
                      star_rule=_UNSET if stars is None else stars.get(tier))
    tier_col = F.lit("default")
    for tier in reversed(order):
        tier_col = F.when(F.col(f"{tier}_hit"), F.lit(tier)).otherwise(tier_col)
    cols = [F.col(c) for c in keys.columns] + [tier_col.alias("tier")]
    for a in RULE_ATTRS:
        v = _default_rule()[a]
        for tier in reversed(order):
            v = F.when(F.col(f"{tier}_hit"), F.col(f"{tier}_{a}")).otherwise(v)
        cols.append(v.alias(a))
    return out.select(*cols)


# ------------------------------------------------------------------ ignore list

IGNORE_SCHEMA = T.StructType([
    T.StructField("tier", T.StringType(), False),
    T.StructField("segment", T.StringType(), False),
    T.StructField("field", T.StringType(), False),
])


def ignores_frame(spark: SparkSession, book: RuleBook) -> DataFrame:
    """Ignore entries of all tiers, one row per distinct (segment, field)."""
    lowest = {(s, f): tier for tier, s, f in sorted(book.ignored, key=lambda x: -TIER_RANK[x[0]])}
    return spark.createDataFrame([(tier, s, f) for (s, f), tier in lowest.items()], IGNORE_SCHEMA)


def drop_ignored(df: DataFrame, ignores: DataFrame, seg_col: str = "rule_segment",
                 field_col: str = "field", n_rules: int = 0) -> DataFrame:
    """C14: remove rows whose (segment, field) is ignored.

    An entry (s, f) ignores exactly that field, (s, *) the whole segment and
    (*, f) the field in every segment.  Three broadcast anti joins.
    """
    exact = small(ignores.select(F.col("segment").alias("_i1s"), F.col("field").alias("_i1f")), n_rules)
    seg = small(ignores.filter(F.col("field") == "*").select(F.col("segment").alias("_i2s")), n_rules)
    fld = small(ignores.filter(F.col("segment") == "*").select(F.col("field").alias("_i3f")), n_rules)
    return (df.join(exact, (F.col(seg_col) == F.col("_i1s")) & (F.col(field_col) == F.col("_i1f")), "left_anti")
              .join(seg, F.col(seg_col) == F.col("_i2s"), "left_anti")
              .join(fld, F.col(field_col) == F.col("_i3f"), "left_anti"))


# ------------------------------------------------------------------ qualifiers

def effective_qualifiers(book: RuleBook, profile_qualifiers: dict[str, str | None]) -> dict[str, str | None]:
    """Tier qualifiers overlaid universal < transaction < partner < profile.

    An explicit ``None`` means "align by position".  Configuration, merged on
    the driver; it becomes a broadcast table in the X12 comparison.
    """
    by_tier = sorted(book.aligned, key=lambda x: TIER_RANK[x[0]])
    return {segment: element for _, segment, element in by_tier} | profile_qualifiers


# ------------------------------------------------------------------ crosswalk

def seed_crosswalk(rules: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Crosswalk rows from rules that are not (*, *), insert-if-absent.

    The crosswalk key is (segment, field) (T7 keeps conditional rules intact).
    """
    merged = merge_tiers(rules).filter(~((F.col("segment") == "*") & (F.col("field") == "*")))
    seeds = merged.select("segment", "field", "severity", "ignore_case", "numeric",
                          "amount_variance", F.lit("seed").alias("origin"))
    if existing is None:
        return seeds
    return existing.unionByName(seeds.join(existing.select("segment", "field"),
                                           ["segment", "field"], "left_anti"),
                                allowMissingColumns=True)


def crosswalk_latest(log: DataFrame) -> DataFrame:
    """C20 upsert: the crosswalk is an append log, the latest row per key wins."""
    return (log.groupBy("profile", "segment", "field")
               .agg(F.max_by(F.struct(*[c for c in log.columns if c not in ("profile", "segment", "field")]),
                             "updated_seq").alias("r"))
               .select("profile", "segment", "field", "r.*"))


# ------------------------------------------------------------------ rules from a schema

def rules_from_schema(columns: DataFrame) -> DataFrame:
    """Default rules for a flat layout given as (name, type).

    Numeric types compare numerically; names containing "Description" are
    soft and case-insensitive; everything else is a plain hard rule, as is what no rule
    names: the last row is the default ``(*, *)``.
    """
    is_num = F.lower("type").isin("integer", "int", "float", "double", "decimal", "long", "bigint")
    is_desc = F.col("name").contains("Description")
    rules = columns.select(
        F.lit("*").alias("segment"),
        F.col("name").alias("field"),
        F.when(is_desc, "soft").otherwise("hard").alias("severity"),
        is_desc.alias("ignore_case"),
        is_num.alias("numeric"))
    default = columns.sparkSession.createDataFrame([("*", "*", "hard", False, False)], rules.schema)
    return rules.unionByName(default)
